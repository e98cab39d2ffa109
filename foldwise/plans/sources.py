"""Queries on scans, sources and sinks; what is written goes to a folder of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import columns as fc
from foldwise.operators import metrics as mt
from foldwise.operators import resample as rs
from foldwise.plans.registry import query, table
from foldwise.sources import relational_text as rt
from foldwise.sources import store
from foldwise.sources import tables as tb
from foldwise.sources.store import new_path


@query("src_table", "select count(*) as n_rows, (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)) as n_repeated, 'id' as row_id_kind from orders")
def _(spark, d):
    orders = tb.with_roles(table(spark, d, "orders"), {"o_orderkey": "id", "o_custkey": "group"})
    kind = tb.columns_of(orders, kinds=["id"]) and "id"
    repeated = tb.repeated_ids(orders, "o_orderkey").agg(F.count("*").alias("n_repeated"))
    return orders.agg(F.count("*").alias("n_rows")).crossJoin(repeated).select("n_rows", "n_repeated", F.lit(kind).alias("row_id_kind"))  # one row each


VIOLATIONS = """select 'orphan' as violation, l_orderkey as bag, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) group by 2
union all select 'empty', o_orderkey, 0 from orders where o_orderkey not in (select l_orderkey from lineitem)"""


@query("src_bag_tables", f"with v as ({VIOLATIONS}) select (select count(*) from orders) as n_bags, (select count(*) from lineitem) as n_instances, (select count(*) from v where violation = 'orphan') as n_orphans")
def _(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    bad = tb.bag_violations(orders, lines, "o_orderkey", "l_orderkey").agg(F.count_if(F.col("violation") == "orphan").alias("n_orphans"))
    return orders.agg(F.count("*").alias("n_bags")).crossJoin(lines.agg(F.count("*").alias("n_instances"))).crossJoin(bad)  # one row each


@query("prd_bag_integrity", VIOLATIONS)
def _(spark, d):
    return tb.bag_violations(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


HEADER = """@relation orders
@attribute o_orderkey integer
@attribute bag relational
  @attribute l_quantity numeric
  @attribute l_extendedprice real
  @attribute l_returnflag {A,N,R}
@end bag
@attribute class {F,O,P}
@data"""


def nested_text(spark, d):
    """Orders as records, with lineitems as lines of a quoted field; every other order has escaped newlines."""
    line = F.concat_ws(",", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), F.when(F.col("l_returnflag") == "A", "?").otherwise(F.col("l_returnflag")))
    bags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = table(spark, d, "orders").join(bags, F.col("o_orderkey") == F.col("l_orderkey"))
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("\n", "lines")).otherwise(F.concat_ws("\\n", "lines"))
    return joined.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), body, F.lit('",'), F.col("o_orderstatus")).alias("value"))


RELATIONAL = "select l_orderkey as o_orderkey, o_orderstatus as class, count(*) as n, sum(l_quantity) as quantity, round(sum(l_extendedprice), 2) as price, count(nullif(l_returnflag, 'A')) as n_flags from lineitem join orders on l_orderkey = o_orderkey group by 1, 2"


def _summed(bags, instances):
    sums = instances.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("l_returnflag").alias("n_flags"))
    return bags.join(sums, "o_orderkey")


@query("src_relational_text", RELATIONAL)
def _(spark, d):
    return _summed(*rt.parse_records(nested_text(spark, d), rt.parse_header(HEADER)))


@query("src_relational_files", RELATIONAL)
def _(spark, d):
    path = new_path(spark, "relational")
    nested_text(spark, d).write.text(path)
    return _summed(*rt.read_relational_text(spark, path, rt.parse_header(HEADER)))


@query("src_relational_roles", "select 'o_orderkey' as bag_id, 'class' as target, case when count(distinct o_orderstatus) = 2 then 'binary' else 'multiclass' end as task_type, count(distinct o_orderstatus) as n_classes from orders where o_orderkey in (select l_orderkey from lineitem)")
def _(spark, d):
    header = rt.parse_header(HEADER)
    bag_id, target = header.roles()
    bags, _ = rt.parse_records(nested_text(spark, d), header)
    return tb.task_type(bags, target, True).select(F.lit(bag_id).alias("bag_id"), F.lit(target).alias("target"), "task_type", F.col("n_distinct").alias("n_classes"))


@query("src_flatten_bags", "select o_orderkey, q as l_quantity from (select l_orderkey as o_orderkey, l_quantity as q from lineitem)")
def _(spark, d):
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("bag"))
    return nested.select(F.col("l_orderkey").alias("o_orderkey"), F.posexplode("bag").alias("position", "x")).select("o_orderkey", "x.l_quantity")


JOINED = "j as (select doc_id, n_chars, lang, quality, toxic from documents left join labels using (doc_id))"


def joined(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")


@query("src_import_schema", f"with {JOINED} " + " union all ".join(f"select '{c}' as name, '{k}' as kind, count(*) filter ({c} is null) > 0 as missing_values from j" for c, k in (("doc_id", "id"), ("n_chars", "numeric"), ("lang", "categorical"), ("quality", "binary"), ("toxic", "binary"))))
def _(spark, d):
    tagged = tb.with_missing_tags(tb.with_roles(joined(spark, d), {"doc_id": "id", "quality": "binary", "toxic": "binary"}))
    rows = [(f.name, f.metadata["kind"], "missing_values" in f.metadata["tags"]) for f in tagged.schema.fields]
    return spark.createDataFrame(rows, "name string, kind string, missing_values boolean")


@query("src_import_splits", """select printf('repeat_%02d_fold_%02d_sample_%02d', r, f, 0) as resample_id, o_orderkey, case when fold = f then 'test' else 'train' end as role from (
select r, o_orderkey, ntile(3) over (partition by r order by md5(r || ':' || o_orderkey), o_orderkey) - 1 as fold from orders, (select unnest(range(2)) as r)), (select unnest(range(3)) as f)""")
def _(spark, d):
    orders = table(spark, d, "orders")
    folds = [rs.kfold(orders, "o_orderkey", 3, seed=r).withColumn("repeat", F.lit(r)) for r in range(2)]
    published = folds[0].unionByName(folds[1]).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return published.select(fc.resample_id(F.col("repeat"), F.col("f"), F.lit(0)).alias("resample_id"), "o_orderkey", F.when(F.col("fold") == F.col("f"), "test").otherwise("train").alias("role"))


@query("src_task_inference", "select case when count(distinct quality) = 2 then 'binary' else 'multiclass' end as task_type, case when count(distinct quality) = 2 then 'binary' else 'categorical' end as target_kind, count(distinct quality) as n_distinct from labels")
def _(spark, d):
    return tb.task_type(table(spark, d, "labels"), "quality", True)


@query("src_no_missing_guard", "select count(*) as n from customer")
def _(spark, d):
    return tb.refuse_missing(table(spark, d, "customer")).agg(F.count("*").alias("n"))


@query("src_case", """select 'price' as case_name, printf('fold_%02d', f) as resample_id, case when fold = f then 'test' else 'train' end as role, count(*) as n from (select ntile(3) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from orders), (select unnest(range(3)) as f) group by all
union all select 'quality', printf('fold_%02d', f), case when fold = f then 'test' else 'train' end, count(*) from (select ntile(3) over (order by md5('1:' || doc_id), doc_id) - 1 as fold from labels), (select unnest(range(3)) as f) group by all""")
def _(spark, d):
    cases = {"price": (table(spark, d, "orders"), "o_orderkey"), "quality": (table(spark, d, "labels"), "doc_id")}
    parts = [rs.fold_roles(rs.kfold(t, k, 3, seed=1), k, 3).select(F.lit(n).alias("case_name"), "resample_id", "role") for n, (t, k) in cases.items()]
    return parts[0].unionByName(parts[1]).groupBy("case_name", "resample_id", "role").agg(F.count("*").alias("n"))


@query("src_verify_files", """select o_orderkey % 5 as file, case o_orderkey % 5 when 0 then 'missing' when 1 then 'sha256' when 2 then 'length' end as problem, count(*) as n_rows
from orders group by 1, 2""")
def _(spark, d):
    path = new_path(spark, "orders")
    # a file for each remainder of the key
    orders = table(spark, d, "orders").withColumn("part", (F.col("o_orderkey") % 5).cast("int"))
    for i in range(5):
        orders.filter(F.col("part") == i).coalesce(1).write.parquet(f"{path}/part={i}")
    parts, wanted = orders.groupBy("part").agg(F.count("*").alias("n_rows")), None
    for i in range(5):
        one = store.manifest(spark, f"{path}/part={i}").filter("file like '%.parquet'").limit(1).select(
            F.lit(i).alias("part"), (F.lit("gone") if i == 0 else F.concat(F.lit(f"part={i}/"), "file")).alias("file"), (F.col("length") + F.lit(i == 2).cast("int")).alias("length"),
            F.lit("other").alias("sha256") if i == 1 else "sha256")
        wanted = one if wanted is None else wanted.unionByName(one)
    checked = store.verified(spark, path, wanted.drop("part")).join(wanted.select("file", "part"), "file").join(parts, "part")
    return checked.select(F.col("part").cast("long").alias("file"), "problem", "n_rows")


def _runs(spark, d):
    from foldwise.plans.reports import GROUPS, runs
    from foldwise.operators import reports as rp

    found = rp.aggregate_runs(runs(spark, d), GROUPS)
    return found.select("dataset_name", "method", "n_runs", "n_success", F.round("primary_metric_mean", 4).alias("primary_metric_mean"))


SAVED = """select o_orderpriority as dataset_name, o_orderstatus as method, count(distinct strftime(o_orderdate, '%Y%m')) as n_runs from orders group by 1, 2"""


@query("snk_run_summary", SAVED)
def _(spark, d):
    path = new_path(spark, "summary")
    store.save_summary(_runs(spark, d), csv=f"{path}/csv", json=f"{path}/json", markdown=f"{path}/md")
    return store.load_summary(spark, f"{path}/json", "json").select("dataset_name", "method", "n_runs")


@query("src_run_summary", SAVED.replace("count(distinct strftime(o_orderdate, '%Y%m'))", "count(distinct strftime(o_orderdate, '%Y%m'))::varchar"))
def _(spark, d):
    path = new_path(spark, "summary")
    store.save_summary(_runs(spark, d), csv=path)
    return store.load_summary(spark, path).select("dataset_name", "method", "n_runs")


def _predictions(spark, d):
    from foldwise.plans.metrics import binary

    return binary(spark, d).withColumnsRenamed({"run_key": "case_name"}).withColumns({"method": F.lit("length"), "resample_id": F.lit("fold_00"), "seed": F.lit(0)})


@query("snk_predictions", "select source as case_name, doc_id as sample_id, quality as y_true from labels join documents using (doc_id) where source in ('src1', 'src2')")
def _(spark, d):
    path = new_path(spark, "predictions")
    store.save_predictions(_predictions(spark, d), path)
    return store.load_predictions(spark, path, case_name="src1").unionByName(store.load_predictions(spark, path, case_name="src2")).select("case_name", "sample_id", "y_true")


@query("mt_recompute", """with b as (select source as case_name, quality as y, case when floor(n_chars / 50.0::double) / (floor(n_chars / 50.0::double) + 40) >= 0.5 then 1 else 0 end as label from documents join labels using (doc_id))
select case_name, round(avg((label = y)::integer), 6) as accuracy, true as same from b group by 1""")
def _(spark, d):
    path = new_path(spark, "predictions")
    given = _predictions(spark, d)
    store.save_predictions(given, path)
    before = mt.metrics_of(given, ["case_name"], ["accuracy"]).withColumnRenamed("accuracy", "was")
    again = mt.metrics_of(store.load_predictions(spark, path), ["case_name"], ["accuracy"])
    return again.join(before, "case_name").select("case_name", F.round("accuracy", 6).alias("accuracy"), (F.abs(F.col("was") - F.col("accuracy")) < 1e-12).alias("same"))


@query("snk_run_evidence", "select o_orderpriority || '/' || o_orderstatus as path, count(*) as n_months from (select distinct o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y%m') from orders) group by 1")
def _(spark, d):
    from foldwise.plans.reports import runs

    path = new_path(spark, "evidence")
    store.save_evidence(store.run_evidence(runs(spark, d).withColumnRenamed("dataset_name", "case_name")), path)
    saved = spark.read.text(path).select(F.from_json("value", "case_name string, method string").alias("r"))
    return saved.groupBy(F.concat_ws("/", "r.case_name", "r.method").alias("path")).agg(F.count("*").alias("n_months"))


@query("snk_case_evidence", """with folds as (select printf('fold_%02d', f) as resample_id, o_orderkey, case when fold = f then 'test' else 'train' end as role from (select o_orderkey, ntile(5) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from orders), (select unnest(range(5)) as f)),
placed as (select *, (row_number() over (partition by resample_id, role order by o_orderkey) - 1) // 1000 as part from folds),
runs as (select resample_id, role, part, count(*) as n, sha256('[' || string_agg(o_orderkey::varchar, ',' order by o_orderkey) || ']') as digest from placed group by 1, 2, 3)
select resample_id, role, sum(n)::bigint as n, sha256(string_agg(digest, ',' order by part)) as keys_sha256 from runs group by 1, 2""")
def _(spark, d):
    return store.case_evidence(rs.fold_roles(rs.kfold(table(spark, d, "orders"), "o_orderkey", 5, seed=1), "o_orderkey", 5), "o_orderkey", size=1000)


@query("snk_case_record", """with folds as (select printf('fold_%02d', f) as resample_id, o_orderkey, case when fold = f then 'test' else 'train' end as role from (select o_orderkey, ntile(3) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from orders), (select unnest(range(3)) as f)),
placed as (select *, (row_number() over (partition by resample_id, role order by o_orderkey) - 1) // 1000 as part from folds),
runs as (select resample_id, role, part, count(*) as n, sha256('[' || string_agg(o_orderkey::varchar, ',' order by o_orderkey) || ']') as digest from placed group by 1, 2, 3),
splits as (select resample_id, role, sum(n)::bigint as n, sha256(string_agg(digest, ',' order by part)) as keys from runs group by 1, 2)
select (select count(*) from orders) as n_rows, 'o_orderkey o_totalprice' as columns, 'id numeric' as kinds, 'o_totalprice' as target, string_agg(resample_id || ' ' || role || ' ' || n || ' ' || keys, ',' order by resample_id, role) as splits from splits""")
def _(spark, d):
    orders = tb.with_roles(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"o_orderkey": "id"})
    folds = rs.fold_roles(rs.kfold(orders, "o_orderkey", 3, seed=1), "o_orderkey", 3)
    path = new_path(spark, "case")
    store.save_case(store.case_record("price", orders, tb.Task("regression", [], "o_totalprice"), folds, "o_orderkey", size=1000), path)
    kept = spark.read.text(path).select(F.from_json("value", "fixed string, rows long, splits array<struct<resample_id string, role string, n long, keys_sha256 string>>").alias("r")).select("r.*")
    fixed = kept.withColumn("f", F.from_json("fixed", "columns array<string>, schema array<struct<kind string>>, task struct<target string>"))
    text = F.transform("splits", lambda s: F.concat_ws(" ", s["resample_id"], s["role"], s["n"].cast("string"), s["keys_sha256"]))
    return fixed.select(F.col("rows").alias("n_rows"), F.array_join("f.columns", " ").alias("columns"), F.array_join("f.schema.kind", " ").alias("kinds"), F.col("f.task.target").alias("target"), F.array_join(text, ",").alias("splits"))


@query("snk_params_long", "select event_id, k as name, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) as k from events)")
def _(spark, d):
    return store.flattened(table(spark, d, "events"), "event_id", "props")


@query("snk_metric_history", "select user_id % 5 as run, event_type as split, strftime(ts, '%Y-%m-%d') as step, event_type || '/' || m as metric, round(case when m = 'loss' then avg(value) else max(value) end, 8) as value from events, (select unnest(['loss', 'peak']) as m) group by user_id % 5, event_type, strftime(ts, '%Y-%m-%d'), m")
def _(spark, d):
    wide = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("split"), F.date_format("ts", "yyyy-MM-dd").alias("step")).agg(F.round(F.avg("value"), 8).alias("loss"), F.round(F.max("value"), 8).alias("peak"))
    path = new_path(spark, "history")
    store.append_history(store.metric_history(wide, "run", "split", "step", ["loss", "peak"]), path)
    return spark.read.parquet(path)
