"""Queries on preprocessing: documents with and without labels, and orders; training rows are the first half of a shuffled order."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import preprocess as pp
from foldwise.operators import resample as rs
from foldwise.operators import statistics as st
from foldwise.plans.registry import query, table
from foldwise.sources.store import stored

HALF = "ntile(2) over (order by md5('1:' || {key}), {key}) = 1"
DOCS = f"""docs as (select doc_id, n_chars::double as n_chars, lang, case when quality is null then null else source end as source, quality::double as quality,
 case when toxic = 1 then n_chars::double else 0 end as zeros, {HALF.format(key='doc_id')} as train from documents left join labels using (doc_id))"""


def halves(frame, key):
    """The frame with ``train``: whether a row is of the first of two shuffled blocks."""
    return frame.join(rs.kfold(frame.select(key), key, 2, seed=1).select(key, (F.col("fold") == 0).alias("train")), key)


def docs(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    made = joined.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang", F.when(F.col("quality").isNotNull(), F.col("source")).alias("source"), F.col("quality").cast("double").alias("quality"),
                         F.when(F.col("toxic") == 1, F.col("n_chars").cast("double")).otherwise(0.0).alias("zeros"))
    return stored(halves(made, "doc_id"), "docs")


def _train(frame):
    return frame.filter("train")


def _r(frame, *names, digits=6):
    return frame.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in frame.columns])


@query("pp_impute_median", f"with {DOCS}, m as (select quantile_cont(quality, 0.5) as q from docs where train) select doc_id, coalesce(quality, q) as quality from docs, m")
def _(spark, d):
    found = docs(spark, d)
    q = st.widened(st.quantiles(_train(found), {"quality": 0.5}), ["quality"], [], "__fill").withColumnRenamed("quality__fill", "q")
    return found.crossJoin(F.broadcast(q)).select("doc_id", F.coalesce("quality", "q").alias("quality"))  # one row of statistics


@query("pp_impute_mode", f"with {DOCS}, m as (select source as q from docs where train and source is not null group by 1 order by count(*) desc, source limit 1) select doc_id, coalesce(source, q) as source from docs, m")
def _(spark, d):
    found = docs(spark, d)
    return found.crossJoin(F.broadcast(pp.modes(_train(found), "source"))).select("doc_id", F.coalesce("source", "source__mode").alias("source"))  # one row of statistics


@query("pp_standardize", f"with {DOCS}, m as (select avg(n_chars) as a, stddev_pop(n_chars) as s from docs where train) select doc_id, round((n_chars - a) / case when s = 0 then 1 else s end, 6) as n_chars from docs, m")
def _(spark, d):
    found = docs(spark, d)
    return _r(pp.linear_policy(_train(found), [pp.Feature("n_chars", "numeric")])(found.select("doc_id", "n_chars")), "n_chars")


@query("pp_maxabs", f"with {DOCS}, m as (select max(abs(zeros)) as s from docs where train) select doc_id, round(zeros / s, 6) as zeros from docs, m")
def _(spark, d):
    found = docs(spark, d)
    return _r(pp.linear_policy(_train(found), [pp.Feature("zeros", "numeric", {"zero_inflated"})])(found.select("doc_id", "zeros")), "zeros")


#: Newton's steps from exponent 1 over x (b: the logarithm's argument), then mean and deviation of the transformed rows.
POWER = """newton as (select 0 as i, 1.0::double as p union all
 select i + 1, p - (s - n * c / v) / (-n * ((v1 + c2) / v - 2 * (c / v) * (c / v))) from (
  select i, p, count(*) as n, sum(l) as s, var_pop(t) as v, covar_pop(t, t1) as c, var_pop(t1) as v1, covar_pop(t, t2) as c2 from (
   select *, (e * l * l - 2 * t1) / p as t2 from (select *, (e * l - t) / p as t1 from (select *, (e - 1) / p as t from (
    select i, p, ln({b}) as l, exp(p * ln({b})) as e from newton, x where i < 12)))) group by i, p)),
best as (select p, avg((exp(p * ln({b})) - 1) / p) as a, stddev_pop((exp(p * ln({b})) - 1) / p) as s from newton, x where i = 12 group by p)"""
TURN = "(exp(p * ln({b})) - 1) / p"
YEO, BOX = TURN.format(b="1 + x"), TURN.format(b="x")


@query("pp_yeo_johnson", f"with recursive {DOCS}, x as (select n_chars as x from docs where train), {POWER.format(b='1 + x')} select doc_id, round(p, 6) as power, round(({YEO} - a) / s, 5) + 0.0::double as n_chars from (select doc_id, n_chars as x from docs), best")
def _(spark, d):
    found = docs(spark, d)
    p = pp.fitted_powers(_train(found), "n_chars")
    t = pp.standardized(pp.yeo_johnson(F.col("n_chars"), F.col("n_chars__power")), F.col("n_chars__mean"), F.col("n_chars__std"))
    return found.crossJoin(F.broadcast(p)).select("doc_id", F.round("n_chars__power", 6).alias("power"), F.round(t, 5).alias("n_chars"))  # one row of statistics


@query("pp_box_cox", f"with recursive x as (select o_totalprice as x from orders qualify {HALF.format(key='o_orderkey')}), {POWER.format(b='x')} select o_orderkey, round(p, 6) as power, round(({BOX} - a) / s, 5) + 0.0::double as o_totalprice from (select o_orderkey, o_totalprice as x from orders), best")
def _(spark, d):
    orders = stored(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "orders")
    p = pp.fitted_powers(_train(halves(orders, "o_orderkey")), "o_totalprice", "box-cox")
    t = pp.standardized(pp.box_cox(F.col("o_totalprice"), F.col("o_totalprice__power")), F.col("o_totalprice__mean"), F.col("o_totalprice__std"))
    return orders.crossJoin(F.broadcast(p)).select("o_orderkey", F.round("o_totalprice__power", 6).alias("power"), F.round(t, 5).alias("o_totalprice"))  # one row of statistics


@query("pp_one_hot", "select o_orderkey, " + ", ".join(f"""(o_orderstatus = '{c}')::integer as "o_orderstatus_{c}\"""" for c in "FOP") + " from orders")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return pp.one_hot(orders, _train(halves(orders, "o_orderkey")), "o_orderstatus").drop("o_orderstatus")


@query("pp_infrequent_one_hot", f"""with kept as (select p_brand from (select p_brand, {HALF.format(key='p_partkey')} as train from part) where train group by 1 order by count(*) desc, p_brand limit 4),
named as (select p_partkey, coalesce(kept.p_brand, 'infrequent') as category from part left join kept using (p_brand)) select category, count(*) as n from named group by 1""")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    wide = pp.one_hot(parts, _train(halves(parts, "p_partkey")), "p_brand", most=5)
    columns = [c for c in wide.columns if c.startswith("p_brand_")]
    sums = wide.agg(*[F.sum(c).alias(c.removeprefix("p_brand_")) for c in columns])
    return sums.unpivot([], sums.columns, "category", "n")


@query("op_topk_categories", "select p_brand, count(*) as n from part group by 1 order by count(*) desc, p_brand limit 4")
def _(spark, d):
    return pp.frequent_categories(table(spark, d, "part"), "p_brand", most=5)


@query("pp_ordinal", f"with {DOCS}, m as (select source, dense_rank() over (order by source) - 1 as i from (select distinct source from docs where train and source > 'src12')) select doc_id, coalesce(i, -1)::integer as source__index from docs left join m using (source)")
def _(spark, d):
    found = docs(spark, d)
    return pp.ordinal(found, _train(found).filter("source > 'src12'"), "source").select("doc_id", F.col("source__index").cast("int").alias("source__index"))


@query("op_sort_classes", "select distinct o_orderstatus from orders order by 1")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderstatus").distinct().orderBy("o_orderstatus")


@query("prj_label_encode", "select o_orderkey, (dense_rank() over (order by o_orderstatus) - 1)::integer as label from orders")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return pp.ordinal(orders, orders, "o_orderstatus").select("o_orderkey", F.col("o_orderstatus__index").cast("int").alias("label"))


FEATURES = [pp.Feature("n_chars", "numeric", {"skewed"}), pp.Feature("quality", "numeric", {"missing_values"}), pp.Feature("zeros", "numeric", {"zero_inflated"}), pp.Feature("lang", "categorical"), pp.Feature("source", "categorical", {"missing_values", "high_cardinality"})]


#: The linear policy's columns: categories of ``source`` beyond the five places share the last.
LINEAR = f"""x as (select n_chars as x from docs where train), {POWER.format(b='1 + x')},
q as (select quantile_cont(quality, 0.5) as q, max(abs(zeros)) as z, mode_ from docs, (select source as mode_ from docs where train and source is not null group by 1 order by count(*) desc, source limit 1) where train group by mode_),
s as (select avg(coalesce(quality, q)) as qa, stddev_pop(coalesce(quality, q)) as qs from docs, q where train),
kept as (select source, row_number() over (order by source) - 1 as i from (select source from (select coalesce(source, mode_) as source from docs, q where train) group by 1 order by count(*) desc, source limit 4)),
langs as (select lang, row_number() over (order by lang) - 1 as i from (select distinct lang from docs where train)),
made as (select doc_id, round(({YEO} - a) / s, 5) + 0.0::double as n_chars, round((coalesce(quality, q) - qa) / case when qs = 0 then 1 else qs end, 5) as quality, round(zeros / z, 5) as zeros, langs.i as lang_place, coalesce(kept.i, 4) as source_place
 from (select *, n_chars as x, coalesce(source, (select mode_ from q)) as full_source from docs) as f join langs using (lang) left join kept on kept.source = full_source, best, q, s)"""
OPTIONS = {"high_cardinality_max_categories": 5}


@query("pp_linear_policy", f"""with recursive {DOCS}, {LINEAR}
select doc_id, n_chars, quality, zeros, (lang_place = 0)::integer as lang_de, (lang_place = 1)::integer as lang_en, (source_place = 4)::integer as source_infrequent, list_position(list_transform(range(5), lambda i: (i = source_place)::integer), 1) - 1 as source_place from made""")
def _(spark, d):
    found = docs(spark, d)
    fitted = pp.linear_policy(_train(found), FEATURES, OPTIONS)
    wide = [c for c in fitted.outputs() if c.startswith("source_")]
    out = _r(fitted(found), "n_chars", "quality", "zeros", digits=5)
    return out.select("doc_id", "n_chars", "quality", "zeros", "lang_de", "lang_en", "source_infrequent", (F.array_position(F.array(*wide), 1) - 1).alias("source_place"))


@query("pp_tree_policy", f"""with {DOCS}, q as (select quantile_cont(quality, 0.5) as q from docs where train), l as (select lang, dense_rank() over (order by lang) - 1 as i from (select distinct lang from docs where train))
select doc_id, n_chars, coalesce(quality, q) as quality, i::integer as lang__index from docs left join l using (lang), q""")
def _(spark, d):
    found = docs(spark, d)
    out = pp.tree_policy(_train(found), [pp.Feature("n_chars", "numeric"), pp.Feature("quality", "numeric", {"missing_values"}), pp.Feature("lang", "categorical")])(found)
    return out.select("doc_id", "n_chars", "quality", F.col("lang__index").cast("int").alias("lang__index"))


@query("pp_instance_scale", f"""with m as (select avg(l_quantity) as a, stddev_pop(l_quantity) as s from lineitem join (select o_orderkey, {HALF.format(key='o_orderkey')} as train from orders) on l_orderkey = o_orderkey where train)
select l_orderkey, round(sum((l_quantity - a) / s), 5) as l_quantity from lineitem, m group by 1""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    bags = _train(halves(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"))
    scaled = pp.linear_policy(lines.join(bags, "l_orderkey", "left_semi"), [pp.Feature("l_quantity", "numeric")])(lines)
    return scaled.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 5).alias("l_quantity"))


#: Three decimals of a number that has five, halves away from zero as decimals (a double times 1,000 may miss a half).
THREE = "round(v::decimal(18, 5), 3)::decimal(18, 3)::varchar"


@query("pp_assemble", f"""with recursive {DOCS}, {LINEAR}
select doc_id, array_to_string(list_concat(list_transform([n_chars, quality, zeros], lambda v: {THREE}), list_transform(range(4), lambda i: (i = lang_place)::integer::varchar), list_transform(range(5), lambda i: (i = source_place)::integer::varchar)), ' ') as features from made""")
def _(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = docs(spark, d)
    fitted = pp.linear_policy(_train(found), FEATURES, OPTIONS)
    rounded = _r(fitted(found), "n_chars", "quality", "zeros", digits=5)
    entries = vector_to_array("features")
    text = F.transform(entries, lambda v, i: F.when(i < 3, F.format_string("%.3f", F.round(v, 3) + 0.0)).otherwise(v.cast("int").cast("string")))
    return VectorAssembler(inputCols=fitted.outputs(), outputCol="features").transform(rounded).select("doc_id", F.array_join(text, " ").alias("features"))


FOLDS = """folds as materialized (select doc_id, lang, source, n_chars, ntile(3) over (order by md5('1:' || doc_id), doc_id) - 1 as fold from documents),
roles as (select printf('fold_%02d', f) as resample_id, fold = f as test, doc_id, lang, source, n_chars from folds, (select unnest(range(3)) as f))"""


def _fold_rows(spark, d):
    made = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return stored(rs.fold_roles(rs.kfold(made, "doc_id", 3, seed=1), "doc_id", 3).join(made, "doc_id"), "fold-rows")


CATEGORIES = [pp.Feature("n_chars", "numeric"), pp.Feature("lang", "categorical"), pp.Feature("source", "categorical", {"high_cardinality"})]


@query("pp_one_hot_per_resample", f"""with {FOLDS},
kept as (select resample_id, source, row_number() over (partition by resample_id order by source) - 1 as i from (
 select *, row_number() over (partition by resample_id order by n desc, source) as r from (select resample_id, source, count(*) as n from roles where not test group by 1, 2)) where r <= 4),
langs as (select resample_id, lang, row_number() over (partition by resample_id order by lang) - 1 as i from (select distinct resample_id, lang from roles where not test)),
k as (select resample_id, count(*) as k from langs group by 1)
select r.resample_id, doc_id, case when langs.i is null then '' else (1 + langs.i)::varchar || ' ' end || (1 + k + coalesce(kept.i, 4)) as places, 1 + k + 5 as size
from roles r join k on k.resample_id = r.resample_id left join langs on langs.resample_id = r.resample_id and langs.lang = r.lang left join kept on kept.resample_id = r.resample_id and kept.source = r.source""")
def _(spark, d):
    rows = _fold_rows(spark, d)
    fitted = pp.linear_policy(rows.filter("role <> 'test'"), CATEGORIES, OPTIONS, by=["resample_id"])
    out = fitted(rows).withColumn("v", fitted.vector())
    # the first entry is the number
    places = F.transform(F.slice("v.indices", 2, 9), lambda i: i.cast("string"))
    return out.select("resample_id", "doc_id", F.array_join(places, " ").alias("places"), "v.size")


@query("pp_ordinal_per_resample", f"""with {FOLDS}, s as (select resample_id, source, dense_rank() over (partition by resample_id order by source) - 1 as i from (select distinct resample_id, source from roles where not test)),
langs as (select resample_id, lang, dense_rank() over (partition by resample_id order by lang) - 1 as i from (select distinct resample_id, lang from roles where not test))
select r.resample_id, doc_id, coalesce(langs.i, -1)::integer as lang__index, coalesce(s.i, -1)::integer as source__index
from roles r left join langs on langs.resample_id = r.resample_id and langs.lang = r.lang left join s on s.resample_id = r.resample_id and s.source = r.source""")
def _(spark, d):
    return pp.resample_policy(_fold_rows(spark, d), CATEGORIES, policy="tree_default").select("resample_id", "doc_id", "lang__index", "source__index")


@query("pp_impute_most_frequent", f"with {DOCS}, m as (select quality as q from docs where train and quality is not null group by 1 order by count(*) desc, quality limit 1) select doc_id, coalesce(quality, q) as quality from docs, m")
def _(spark, d):
    found = docs(spark, d)
    return pp.tree_policy(_train(found), [FEATURES[1]], {"numeric_impute": "most_frequent"})(found).select("doc_id", "quality")


@query("pp_per_resample", """with folds as materialized (select o_orderkey, o_totalprice, case when o_orderpriority <> '1-URGENT' then date_part('day', o_orderdate)::double end as day, case when o_orderstatus = 'P' then o_totalprice else 0 end as part,
  ntile(5) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from orders),
roles as (select printf('fold_%02d', f) as resample_id, fold = f as test, o_orderkey, o_totalprice, day, part from folds, (select unnest(range(5)) as f)),
fills as (select resample_id, quantile_cont(day, 0.5) as q from roles where not test group by 1),
stats as (select resample_id, avg(o_totalprice) as a, stddev_pop(o_totalprice) as s, avg(coalesce(day, q)) as da, stddev_pop(coalesce(day, q)) as ds, max(abs(part)) as m from roles join fills using (resample_id) where not test group by 1)
select resample_id, o_orderkey, round((o_totalprice - a) / s, 5) as o_totalprice, round((coalesce(day, q) - da) / ds, 5) as day, round(part / m, 5) as part from roles join stats using (resample_id) join fills using (resample_id)""")
def _(spark, d):
    day = F.when(F.col("o_orderpriority") != "1-URGENT", F.dayofmonth("o_orderdate").cast("double"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", day.alias("day"), F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0).alias("part"))
    others = ["o_totalprice", "day", "part"]
    roles = stored(rs.fold_roles(rs.kfold(orders, "o_orderkey", 5, 1, *others), "o_orderkey", 5, *others), "roles")
    out = pp.resample_policy(roles, [pp.Feature("o_totalprice", "numeric"), pp.Feature("day", "numeric", {"missing_values"}), pp.Feature("part", "numeric", {"zero_inflated"})])
    return _r(out, "o_totalprice", "day", "part", digits=5).select("resample_id", "o_orderkey", "o_totalprice", "day", "part")


@query("ud_policy", "select o_orderkey, round(ln(1 + o_totalprice), 6) as o_totalprice from orders")
def _(spark, d):
    if "log_all" not in pp.POLICIES:
        pp.register_policy("log_all", lambda train, features, options=None: lambda frame: frame.withColumns({f.name: F.log1p(f.name) for f in features}))
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return _r(pp.POLICIES["log_all"](orders, [pp.Feature("o_totalprice", "numeric")])(orders), "o_totalprice")
