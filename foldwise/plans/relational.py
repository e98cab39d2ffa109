"""Queries on projections, filters and checks of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import resample as rs
from foldwise.operators.resample import ranked
from foldwise.plans.registry import query, table
from foldwise.sources import tables as tb

TASK = tb.Task("regression", ["o_orderstatus", "o_orderpriority"], "o_totalprice", groups=["o_custkey"])


@query("prj_source", "select o_orderstatus, o_orderpriority from orders")
def _(spark, d):
    return TASK.sources(table(spark, d, "orders"))


@query("prj_target", "select o_totalprice from orders")
def _(spark, d):
    return TASK.targets(table(spark, d, "orders"))


@query("prj_select_by_kind_tag", "select l_quantity, l_tax from lineitem")
def _(spark, d):
    lines = tb.with_roles(table(spark, d, "lineitem"), {"l_orderkey": "group", "l_partkey": "id", "l_suppkey": "id", "l_linenumber": "id"}, {"l_extendedprice": ["skewed"], "l_discount": ["zero_inflated"], "l_quantity": ["bounded"]})
    return lines.select(*tb.columns_of(lines, kinds=["numeric"], exclude=["skewed", "zero_inflated"]))


PROFILED = {"c_custkey": "numeric", "c_name": "categorical", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "categorical"}


@query("prj_schema_profile", " union all ".join(f"""select '{c}' as "column", '{k}' as kind, count(*) filter ({c} is null) as n_null, count(distinct {c}) as n_distinct from customer""" for c, k in PROFILED.items()))
def _(spark, d):
    return tb.profile(table(spark, d, "customer").select(*PROFILED))


@query("ag_missing_profile", "with j as (select doc_id, quality, toxic from documents left join labels using (doc_id)) " + " union all ".join(f"""select '{c}' as "column", count(*) filter ({c} is null) as n_null, count(distinct {c}) as n_distinct from j""" for c in ("doc_id", "quality", "toxic")))
def _(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return tb.profile(joined).select("column", "n_null", "n_distinct")


@query("flt_rows_by_key", "select draw, o_orderkey, o_totalprice from orders join (select o_orderkey, unnest(range(1 + (o_orderkey % 3)::integer)) as draw from orders) using (o_orderkey)")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    keys = orders.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)).alias("draw"))
    return keys.join(orders, "o_orderkey").select("draw", "o_orderkey", "o_totalprice")


@query("prj_sample_ids", "select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as sample_id from conversations")
def _(spark, d):
    return ranked(table(spark, d, "conversations").select("conv_id", "turn"), "turn", within=["conv_id"]).select("conv_id", "turn", F.col("position").alias("sample_id"))


@query("prd_dataset_integrity", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"))
    return tb.repeated_ids(lines, "id").select("id.l_orderkey", "id.l_linenumber", "n")


@query("prd_dataset_violations", """select 'missing_from_schema' as violation, 'l_tax' as name, 1::bigint as n union all select 'extra_in_schema', 'l_comment', 1
union all select 'duplicate_column', 'l_discount', 2 union all select 'row_id_repeated', 'l_orderkey', sum(n)::bigint from (select count(*) as n from lineitem group by l_orderkey having count(*) > 1) having sum(n) > 0""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_tax", "l_discount", F.col("l_discount"))
    return tb.dataset_violations(lines, {"l_orderkey": "id", "l_discount": "numeric", "l_comment": "text"}, "l_orderkey")


@query("prd_missing_audit", "with j as (select quality, toxic from documents left join labels using (doc_id)) select 'quality' as name from j where quality is null group by 1 union all select 'toxic' from j where toxic is null group by 1")
def _(spark, d):
    from foldwise.operators.preprocess import Feature, untagged_missing

    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    found = untagged_missing(joined, [Feature(c, "numeric") for c in ("n_chars", "quality", "toxic")])
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("prd_complete_target", "select count(*) as n_incomplete from documents left join labels using (doc_id) where quality is null")
def _(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.filter("quality is null").agg(F.count("*").alias("n_incomplete"))


@query("prd_unseen_class", """
with dealt as (select p_brand || ' ' || p_type as class, ntile(5) over (order by md5('1:' || p_partkey), p_partkey) - 1 as fold from part),
spread as (select class, min(fold) as low, max(fold) as high from dealt group by 1)
select printf('fold_%02d', low) as resample_id, class from spread where low = high""")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("class"))
    dealt = rs.kfold(parts, "p_partkey", 5, seed=1).join(parts, "p_partkey")
    # a class of one fold is tested there and trained nowhere
    return dealt.groupBy("class").agg(F.min("fold").alias("low"), F.max("fold").alias("high")).filter("low = high").select(
        F.format_string("fold_%02d", "low").alias("resample_id"), "class")
