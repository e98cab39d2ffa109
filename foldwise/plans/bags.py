"""Queries on bags: bags are orders (or users) and instances are lineitems (or events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import columns as fc
from foldwise.operators import bags as bg
from foldwise.plans.registry import query, table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def _r(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _lines(spark, d):
    return table(spark, d, "lineitem")


@query("ag_bag_summary", "select o_orderkey, count(l_orderkey) as bag_size, " + ", ".join(
    f"round({f}({c}), 8) as {c}__{n}" for c in COLUMNS for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    + " from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def _(spark, d):
    found = bg.bag_summary(table(spark, d, "orders").select("o_orderkey"), _lines(spark, d), "o_orderkey", "l_orderkey", COLUMNS)
    return _r(found, *[c for c in found.columns if "__" in c], digits=8)


@query("jn_bag_features", """select o.*, n.bag_size, n.l_tax__mean from orders o left join
(select o_orderkey, count(l_orderkey) as bag_size, round(avg(l_tax), 6) as l_tax__mean from orders left join lineitem on l_orderkey = o_orderkey group by 1) n using (o_orderkey)""")
def _(spark, d):
    return _r(bg.bag_summary(table(spark, d, "orders"), _lines(spark, d), "o_orderkey", "l_orderkey", ["l_tax"], ["mean"]), "l_tax__mean")


@query("ag_bag_size", "select o_orderkey, count(l_orderkey) as bag_size from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def _(spark, d):
    return bg.bag_summary(table(spark, d, "orders").select("o_orderkey"), _lines(spark, d), "o_orderkey", "l_orderkey", [], [])


@query("flt_bag_instances", "select l_linenumber, l_quantity, l_extendedprice from lineitem where l_orderkey = (select min(l_orderkey) from lineitem)")
def _(spark, d):
    first = _lines(spark, d).agg(F.min("l_orderkey").alias("l_orderkey"))
    return _lines(spark, d).join(F.broadcast(first), "l_orderkey").select("l_linenumber", "l_quantity", "l_extendedprice")  # one row


@query("ag_bag_centroid", "select l_orderkey, round(avg(l_quantity), 6) as l_quantity, round(avg(l_discount), 6) as l_discount from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1")
def _(spark, d):
    positive = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _r(_lines(spark, d).join(positive, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_discount").alias("l_discount")), "l_quantity", "l_discount")


@query("jn_weak_labels", "select l_orderkey, l_linenumber, l_quantity, o_orderstatus as label from lineitem join orders on l_orderkey = o_orderkey")
def _(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("label"))
    return _lines(spark, d).join(labels, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity", "label")


def _scored(spark, d):
    p = (F.col("l_quantity") / 50.0)
    return _lines(spark, d).select("l_orderkey", (p * 0.5).alias("p0"), (F.lit(1.0) - p).alias("p1"), (p * 0.5).alias("p2"))


POOLED = """with s as (select l_orderkey, l_quantity / 50.0::double * 0.5::double as p0, 1.0::double - l_quantity / 50.0::double as p1, l_quantity / 50.0::double * 0.5::double as p2 from lineitem),
p as (select l_orderkey, {f}(p0) as a, {f}(p1) as b, {f}(p2) as c from s group by 1),
t as (select l_orderkey, a / (a + b + c) as a, b / (a + b + c) as b, c / (a + b + c) as c from p)
select l_orderkey, round(a, 6) as p0, round(b, 6) as p1, round(c, 6) as p2,
case when a >= greatest(a, b, c) - 1e-12::double then 0 when b >= greatest(a, b, c) - 1e-12::double then 1 else 2 end::integer as label from t"""


def _pooled(spark, d, how):
    found = bg.pooled_probabilities(_scored(spark, d), "l_orderkey", ["p0", "p1", "p2"], how)
    return found.select("l_orderkey", *[F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(3)], "label")


@query("ag_instance_pool", POOLED.format(f="max"))
def _(spark, d):
    return _pooled(spark, d, "max")


@query("ag_instance_pool_mean", POOLED.format(f="avg"))
def _(spark, d):
    return _pooled(spark, d, "mean")


@query("ag_max_score_pool", "select l_orderkey, max(l_extendedprice * (1 - l_discount)) as score from lineitem group by 1")
def _(spark, d):
    return _lines(spark, d).groupBy("l_orderkey").agg(F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"))


@query("ag_masked_vector_pool", """
select label, entry, round(avg(value), 6) as value from (select label, unnest(embedding)::double as value, unnest(range(len(embedding)))::integer as entry from embeddings where vec_id % 3 <> 0) group by 1, 2""")
def _(spark, d):
    found = bg.pooled_vectors(table(spark, d, "embeddings"), "label", "embedding", mask=F.col("vec_id") % 3 != 0)
    return found.select("label", F.posexplode("embedding").alias("entry", "value")).withColumn("value", F.round("value", 6))


@query("ag_attention_pool", """
with m as (select *, l_quantity / 10.0::double as s, max(l_quantity / 10.0::double) over (partition by l_orderkey) as t from lineitem)
select l_orderkey, round(sum(exp(s - t) * l_extendedprice) / sum(exp(s - t)), 4) as l_extendedprice, round(sum(exp(s - t) * l_tax) / sum(exp(s - t)), 6) as l_tax from m group by 1""")
def _(spark, d):
    scored = _lines(spark, d).withColumn("s", F.col("l_quantity") / 10.0)
    found = bg.attention_pool(scored, "l_orderkey", "s", ["l_extendedprice", "l_tax"])
    return _r(_r(found, "l_extendedprice", digits=4), "l_tax")


@query("wn_attention_weights", """
with m as (select *, exp(value / 10.0::double - max(value / 10.0::double) over (partition by user_id)) as w from events)
select event_id, user_id, round(w / sum(w) over (partition by user_id), 8) as weight from m""")
def _(spark, d):
    scored = table(spark, d, "events").select("event_id", "user_id", (F.col("value") / 10.0).alias("s"))
    return _r(bg.attention_weights(scored, "user_id", "s").select("event_id", "user_id", "weight"), "weight", digits=8)


@query("ag_ensemble_mean", """
with p as (select event_id, avg(1 / (1 + exp(-(value / 20.0::double - m)))) as p from events, (select unnest([0, 1, 2]) as m) group by 1)
select event_id, round(p, 6) as probability, case when p >= 0.5 then 1 else 0 end as label from p""")
def _(spark, d):
    members = table(spark, d, "events").select("event_id", "value", F.explode(F.array(*map(F.lit, range(3)))).alias("m"))
    found = members.groupBy("event_id").agg(F.avg(fc.sigmoid(F.col("value") / 20.0 - F.col("m"))).alias("p"))
    return found.select("event_id", F.round("p", 6).alias("probability"), F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("label"))


@query("ag_bag_entropy", "select user_id, round(0.5 * ln(2 * pi() * exp(1) * var_pop(value)), 6) as entropy from events group by 1 having var_pop(value) > 0")
def _(spark, d):
    found = table(spark, d, "events").groupBy("user_id").agg(F.var_pop("value").alias("v"), fc.sample_variance_entropy(F.col("value")).alias("entropy"))
    return _r(found.filter("v > 0").select("user_id", "entropy"), "entropy")


@query("ag_bag_mutual_info", "select l_suppkey, round(-0.5 * ln(1 - power(corr(l_quantity, l_extendedprice), 2)), 6) as mutual_information from lineitem group by 1 having count(*) > 3")
def _(spark, d):
    found = _lines(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("n"), fc.gaussian_mutual_information(F.col("l_quantity"), F.col("l_extendedprice")).alias("mutual_information"))
    return _r(found.filter("n > 3").select("l_suppkey", "mutual_information"), "mutual_information")


@query("ag_bag_total_correlation", """
with m as (select l_suppkey, var_pop(l_quantity) as a, var_pop(l_extendedprice) as b, var_pop(l_discount) as c, covar_pop(l_quantity, l_extendedprice) as ab, covar_pop(l_quantity, l_discount) as ac, covar_pop(l_extendedprice, l_discount) as bc
  from lineitem group by 1), t as (select *, a * b * c + 2 * ab * ac * bc - a * bc * bc - b * ac * ac - c * ab * ab as det from m)
select l_suppkey, case when det > 0 then round(0.5 * (ln(a) + ln(b) + ln(c) - ln(det)), 5) end as total_correlation from t""")
def _(spark, d):
    return _r(bg.total_correlation(_lines(spark, d), "l_suppkey", COLUMNS), "total_correlation", digits=5)


KEYED = "(select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as k from lineitem)"


@query("wn_witness", """
select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r = 1""")
def _(spark, d):
    return bg.witnesses(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("jn_witnesses", """
select event_id, user_id, value from events where user_id % 2 = 0 union all
select event_id, user_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events where user_id % 2 = 1) where r = 1""")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    chosen = bg.witnesses(events.filter("user_id % 2 = 1"), "user_id", "value", "event_id").select("event_id")
    return events.filter("user_id % 2 = 0").unionByName(events.join(chosen, "event_id", "left_semi"))


@query("wn_bag_offsets", """
select o_orderkey, sum(n) over (order by o_orderkey)::bigint - n as start, sum(n) over (order by o_orderkey)::bigint as stop
from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1)""")
def _(spark, d):
    sizes = bg.bag_summary(table(spark, d, "orders").select("o_orderkey"), _lines(spark, d), "o_orderkey", "l_orderkey", [], [])
    return bg.offsets(sizes, "o_orderkey", "bag_size")


@query("flt_select_bags", """
with draws as (select row_number() over (order by o_orderkey) - 1 as draw_no, o_orderkey from orders),
twice as (select draw_no * 2 + c as draw_no, o_orderkey from draws, (select unnest([0, 1]) as c))
select draw_no, o_orderkey, count(l_orderkey) as n, (sum(count(l_orderkey)) over (order by draw_no))::bigint - count(l_orderkey) as start
from twice left join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def _(spark, d):
    from foldwise.operators.resample import ranked

    chosen = ranked(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    draws = chosen.select("o_orderkey", F.explode(F.array(F.col("position") * 2, F.col("position") * 2 + 1)).alias("draw_no"))
    sizes = _lines(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    counted = draws.join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("draw_no", "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.join(bg.offsets(counted, "draw_no", "n"), "draw_no").select("draw_no", "o_orderkey", "n", "start")


@query("wn_normalized_rank", "select p_partkey, round(percent_rank() over (partition by p_brand order by p_retailprice), 8) as rank01 from part")
def _(spark, d):
    from pyspark.sql import Window as W

    ranks = F.percent_rank().over(W.partitionBy("p_brand").orderBy("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", F.round(ranks, 8).alias("rank01"))


@query("ud_statistic", "select user_id, count(*) as bag_size, round(max(value) - min(value), 6) as value__spread from events group by 1")
def _(spark, d):
    if "spread" not in bg.STATISTICS:
        bg.register_statistic("spread", lambda c: F.max(c) - F.min(c))
    events = table(spark, d, "events")
    users = events.select("user_id").distinct()
    return _r(bg.bag_summary(users, events.withColumnRenamed("user_id", "u"), "user_id", "u", ["value"], ["spread"]), "value__spread")
