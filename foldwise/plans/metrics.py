"""Queries on predictions: two classes from labels by document length, ten from embeddings, values from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import columns as fc
from foldwise.operators import metrics as mt
from foldwise.plans.registry import query, table


def binary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    joined = table(spark, d, "labels").join(docs, "doc_id")
    score = F.floor(F.col("n_chars") / 50) / (F.floor(F.col("n_chars") / 50) + 40.0)
    return joined.select(F.col("source").alias("run_key"), F.col("doc_id").alias("sample_id"), F.col("quality").alias("y_true"), score.alias("score"),
                         F.when(score >= 0.5, 1).otherwise(0).alias("label"), F.array(1 - score, score).alias("probabilities"), (F.col("doc_id") % 3 + 1).cast("double").alias("weight"))


BINARY = """b as (select source as run_key, doc_id as sample_id, quality as y_true, s as score, case when s >= 0.5 then 1 else 0 end as label, (doc_id % 3 + 1)::double as weight
from (select *, floor(n_chars / 50.0::double) / (floor(n_chars / 50.0::double) + 40) as s from documents) join labels using (doc_id))"""


def multiclass(spark, d):
    # logit c: four times the sum of the entries at c, c + 10, c + 20, ...
    places = F.array(*[F.when(F.size("embedding") > c, F.sequence(F.lit(c), F.size("embedding") - 1, F.lit(10))).otherwise(F.array().cast("array<int>")) for c in range(10)])
    v = F.when(F.col("embedding").isNotNull(), F.transform(places, lambda at: 4 * F.aggregate(at, F.lit(0.0), lambda a, i: a + F.col("embedding")[i].cast("double"))))
    return table(spark, d, "embeddings").select(F.lit("all").alias("run_key"), F.col("vec_id").alias("sample_id"), F.col("label").alias("y_true"), v.alias("logits")).withColumn(
        "decision", fc.multiclass_decision(F.col("logits"))).select("run_key", "sample_id", "y_true", "decision.label", "decision.probabilities", "logits")


MULTI = """x as (select vec_id as sample_id, label as y_true, unnest(range(len(embedding))) % 10 as c, unnest(embedding)::double as v from embeddings),
e as (select sample_id, y_true, c, exp(4 * sum(v)) as w from x group by 1, 2, 3),
m as (select sample_id, y_true, c, w / sum(w) over (partition by sample_id) as p from e)"""


def regression(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    value = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("value"))
    return orders.join(value, "o_orderstatus").select(F.col("o_orderpriority").alias("run_key"), F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("y_true"), "value")


REGRESSION = "r as (select o_orderpriority as run_key, o_orderkey as sample_id, o_totalprice as y_true, avg(o_totalprice) over (partition by o_orderstatus) as value from orders)"


def _one(frame, name, digits=6):
    return frame.select("run_key", F.round(name, digits).alias(name))


@query("mt_accuracy", f"with {BINARY} select run_key, round(avg((label = y_true)::integer), 6) as accuracy from b group by 1")
def _(spark, d):
    return _one(mt.metrics_of(binary(spark, d), ["run_key"], ["accuracy"]), "accuracy")


AUC = """ranks as (select *, rank() over (partition by run_key order by score) + (count(*) over (partition by run_key, score) - 1) / 2.0::double as r from b),
auc as (select run_key, sum(case when y_true = 1 then r else 0 end) as s, sum(y_true) as p, count(*) - sum(y_true) as n from ranks group by 1)"""


@query("mt_roc_auc_binary", f"with {BINARY}, {AUC} select run_key, case when p > 0 and n > 0 then round((s - p * (p + 1) / 2.0::double) / (p::double * n), 6) end as roc_auc from auc")
def _(spark, d):
    return _one(mt.metrics_of(binary(spark, d), ["run_key"], ["roc_auc"]), "roc_auc")


AREAS = """steps as (select c, p, sum(weight * (y_true = c)::integer) as pos, sum(weight * (y_true <> c)::integer) as neg from {table} group by 1, 2),
below as (select *, coalesce(sum(neg) over (partition by c order by p rows between unbounded preceding and 1 preceding), 0) as b from steps),
areas as (select c, sum(pos * (b + neg / 2.0::double)) / (sum(pos)::double * sum(neg)) as area, sum(pos) as size from below group by 1 having sum(pos) > 0 and sum(neg) > 0)"""


@query("mt_roc_auc_ovr", f"with {MULTI}, t as (select *, 1.0::double as weight from m), {AREAS.format(table='t')} select 'all' as run_key, round(avg(area), 6) as roc_auc from areas")
def _(spark, d):
    return _one(mt.metrics_of(multiclass(spark, d), ["run_key"], ["roc_auc"]), "roc_auc")


@query("mt_roc_auc_weighted", f"""with {BINARY}, t as (select run_key as c, s_ as p, y_true, weight from (select *, score as s_ from b)),
steps as (select c, p, sum(weight * (y_true = 1)::integer) as pos, sum(weight * (y_true <> 1)::integer) as neg from t group by 1, 2),
below as (select *, coalesce(sum(neg) over (partition by c order by p rows between unbounded preceding and 1 preceding), 0) as b from steps)
select c as run_key, case when sum(pos) > 0 and sum(neg) > 0 then round(sum(pos * (b + neg / 2.0::double)) / (sum(pos)::double * sum(neg)), 6) end as roc_auc from below group by 1""")
def _(spark, d):
    return _one(mt.metrics_of(binary(spark, d), ["run_key"], ["roc_auc"], weight="weight"), "roc_auc")


@query("mt_roc_auc_by_class_size", f"""with {MULTI}, t as (select *, (sample_id % 3 + 1)::double as weight from m), {AREAS.format(table='t')}
select 'all' as run_key, round(sum(area * size) / sum(size), 6) as roc_auc from areas""")
def _(spark, d):
    weighted = multiclass(spark, d).withColumn("weight", (F.col("sample_id") % 3 + 1).cast("double"))
    return _one(mt.metrics_of(weighted, ["run_key"], ["roc_auc"], weight="weight", options={"roc_auc": {"average": "weighted"}}), "roc_auc")


@query("mt_log_loss", f"with {MULTI} select 'all' as run_key, round(-avg(ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) as log_loss from m where c = y_true")
def _(spark, d):
    return _one(mt.metrics_of(multiclass(spark, d), ["run_key"], ["log_loss"]), "log_loss")


@query("mt_mse", f"with {REGRESSION} select run_key, round(avg(power(y_true - value, 2)), 0) as mse from r group by 1")
def _(spark, d):
    return _one(mt.metrics_of(regression(spark, d), ["run_key"], ["mse"]), "mse", 0)


@query("mt_rmse", f"with {REGRESSION} select run_key, round(sqrt(avg(power(y_true - value, 2))), 4) as rmse from r group by 1")
def _(spark, d):
    return _one(mt.metrics_of(regression(spark, d), ["run_key"], ["rmse"]), "rmse", 4)


@query("mt_mae", f"with {REGRESSION} select run_key, round(avg(abs(y_true - value)), 4) as mae from r group by 1")
def _(spark, d):
    return _one(mt.metrics_of(regression(spark, d), ["run_key"], ["mae"]), "mae", 4)


@query("mt_requested_only", f"""with {BINARY}, {AUC}
select run_key, round(accuracy, 6) as accuracy, case when p > 0 and n > 0 then round((s - p * (p + 1) / 2.0::double) / (p::double * n), 6) end as roc_auc
from auc join (select run_key, avg((label = y_true)::integer) as accuracy from b group by 1) using (run_key)""")
def _(spark, d):
    found = mt.metrics_of(binary(spark, d), ["run_key"], ["accuracy", "roc_auc"])
    return found.select("run_key", F.round("accuracy", 6).alias("accuracy"), F.round("roc_auc", 6).alias("roc_auc"))


@query("mt_requested_of_several_classes", f"""with {MULTI}, t as (select *, 1.0::double as weight from m), {AREAS.format(table='t')},
top as (select sample_id, y_true, c, row_number() over (partition by sample_id order by p desc, c) as r from m)
select 'all' as run_key, (select round(avg((c = y_true)::integer), 6) from top where r = 1) as accuracy, (select round(avg(area), 6) from areas) as roc_auc""")
def _(spark, d):
    found = mt.metrics_of(multiclass(spark, d), ["run_key"], ["accuracy", "roc_auc"])
    return found.select("run_key", F.round("accuracy", 6).alias("accuracy"), F.round("roc_auc", 6).alias("roc_auc"))


@query("mt_weighted", f"""with {BINARY}, steps as (select run_key, score, sum(weight * (y_true = 1)::integer) as pos, sum(weight * (y_true <> 1)::integer) as neg from b group by 1, 2),
below as (select *, coalesce(sum(neg) over (partition by run_key order by score rows between unbounded preceding and 1 preceding), 0) as under from steps),
areas as (select run_key, case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (under + neg / 2.0::double)) / (sum(pos)::double * sum(neg)) end as area from below group by 1)
select run_key, round(sum(weight * (label = y_true)::integer) / sum(weight), 6) as accuracy, round(any_value(area), 6) as roc_auc from b join areas using (run_key) group by 1""")
def _(spark, d):
    found = mt.metrics_of(binary(spark, d), ["run_key"], ["accuracy", "roc_auc"], weight="weight")
    return found.select("run_key", F.round("accuracy", 6).alias("accuracy"), F.round("roc_auc", 6).alias("roc_auc"))


@query("ud_metric", f"with {REGRESSION} select run_key, round(max(abs(y_true - value)), 4) as worst from r group by 1")
def _(spark, d):
    if "worst" not in mt.METRICS:
        mt.register_metric("worst", lambda w: F.max(F.abs(F.col("y_true") - F.col("value"))), "value", greater_is_better=False)
    return _one(mt.metrics_of(regression(spark, d), ["run_key"], ["worst"]), "worst", 4)


@query("ag_epoch_metrics", """
select user_id % 5 as run, strftime(ts, '%Y-%m-%d') as epoch, count(*) as n, round(avg(value), 9) as loss, round(sqrt(avg(power(value - user_id, 2))), 9) as rmse, round(avg(abs(value - user_id)), 9) as mae
from events group by 1, 2""")
def _(spark, d):
    batch = table(spark, d, "events").select((F.col("user_id") % 5).alias("run"), F.date_format("ts", "yyyy-MM-dd").alias("epoch"), F.col("user_id").cast("double").alias("y_true"), "value")
    return batch.groupBy("run", "epoch").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("loss"), F.round(mt.rmse(), 9).alias("rmse"), F.round(mt.mae(), 9).alias("mae"))


@query("prj_binary_decision", """
select event_id, round(1 - p, 8) as p0, round(p, 8) as p1, case when p >= 0.5 then 1 else 0 end as label from (select event_id, 1 / (1 + exp(-(value - 20) / 10.0::double)) as p from events)""")
def _(spark, d):
    found = table(spark, d, "events").select("event_id", fc.binary_decision((F.col("value") - 20) / 10.0).alias("x"))
    return found.select("event_id", F.round(F.col("x.probabilities")[0], 8).alias("p0"), F.round(F.col("x.probabilities")[1], 8).alias("p1"), "x.label")


@query("prj_multiclass_decision", f"""with {MULTI} select sample_id, c::integer as label, round(p, 6) as probability from (select *, row_number() over (partition by sample_id order by p desc, c) as r from m) where r = 1""")
def _(spark, d):
    return multiclass(spark, d).select("sample_id", "label", F.round(F.array_max("probabilities"), 6).alias("probability"))


@query("prj_margin_decision", "select event_id, case when value - 20 >= 0 then 1 else 0 end as label from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") - 20 >= 0, 1).otherwise(0).alias("label"))


@query("jn_prediction_truth", f"""with {BINARY} select count(*) as n_both, count(*) filter (quality is null) as n_only_predicted, (select count(*) from labels) - count(*) as n_only_true from b left join labels on sample_id = doc_id""")
def _(spark, d):
    predicted = binary(spark, d).select("sample_id", F.lit(1).alias("p"))
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.lit(1).alias("t"))
    both = predicted.join(truth, "sample_id", "full_outer")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("n_both"), F.count_if(F.col("t").isNull()).alias("n_only_predicted"), F.count_if(F.col("p").isNull()).alias("n_only_true"))
