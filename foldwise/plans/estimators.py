"""Queries on methods: which baseline predicts order values, and Spark ML estimators on documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import bags as bg
from foldwise.operators import estimators as es
from foldwise.operators import metrics as mt
from foldwise.operators import refit as rf
from foldwise.operators import reports as rp
from foldwise.operators import resample as rs
from foldwise.operators import study as st
from foldwise.plans.registry import query, table
from foldwise.sources.store import new_path, stored
from foldwise.sources.tables import Task


def order_rows(spark, d, k=5):
    """Orders with the number of their lines, for each fold and role."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sized = bg.bag_summary(orders, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", [], [])
    dealt = rs.kfold(orders.select("o_orderkey"), "o_orderkey", k, seed=1).join(sized, "o_orderkey")
    return rs.fold_roles(dealt, "o_orderkey", k, *[c for c in sized.columns if c != "o_orderkey"])


ROWS = """n as (select o_orderkey, o_totalprice, o_orderstatus, count(l_orderkey) as bag_size from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2, 3),
f as (select *, ntile(5) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from n),
rows_ as (select printf('fold_%02d', k) as resample_id, case when fold = k then 'test' else 'train' end as role, o_orderkey, o_totalprice, o_orderstatus, bag_size from f, (select unnest(range(5)) as k))"""
FITS = """mean_ as (select resample_id, avg(o_totalprice) as v from rows_ where role = 'train' group by 1),
line_ as (select resample_id, regr_slope(o_totalprice, bag_size) as b, regr_intercept(o_totalprice, bag_size) as a from rows_ where role = 'train' group by 1),
predicted as (select 'mean' as method, resample_id, o_orderkey, o_totalprice as y, v from rows_ join mean_ using (resample_id) where role = 'test'
union all select 'line', resample_id, o_orderkey, o_totalprice, a + b * bag_size from rows_ join line_ using (resample_id) where role = 'test')"""


def _predicted(spark, d):
    both = es.mean_and_line(order_rows(spark, d), "bag_size", "o_totalprice")
    return both.select("method", "resample_id", "o_orderkey", F.col("o_totalprice").alias("y_true"), "value")


@query("flagship_baseline_ranking", f"""with {ROWS}, {FITS}, m as (select method, resample_id, sqrt(avg(power(y - v, 2))) as rmse, avg(abs(y - v)) as mae from predicted group by 1, 2),
s as (select method, count(*) as n_runs, avg(rmse) as rmse, stddev_samp(rmse) as std, avg(mae) as mae from m group by 1)
select method, n_runs, round(rmse, 4) as rmse_mean, round(std, 4) as rmse_std, round(mae, 4) as mae_mean, rank() over (order by round(rmse, 6))::double as overall_rank from s""")
def _(spark, d):
    found = mt.metrics_of(_predicted(spark, d), ["method", "resample_id"], ["rmse", "mae"])
    runs = found.select(F.lit("orders").alias("dataset_name"), F.lit("baselines").alias("study_name"), "method", "resample_id", F.lit("success").alias("status"),
                        F.col("rmse").alias("metric.rmse"), F.col("mae").alias("metric.mae"), F.lit("rmse").alias("primary_metric"), F.lit("false").alias("primary_metric_greater_is_better"))
    # a few rows for each method, which ranks read several times
    path = new_path(spark, "runs")
    runs.write.parquet(path)
    runs = spark.read.schema(runs.schema).parquet(path)
    ranked = rp.with_ranks(rp.aggregate_runs(runs, ["study_name", "dataset_name", "method"]).withColumn("primary_metric_mean", F.round("primary_metric_mean", 6)), rank_by=("study_name", "dataset_name"))
    return ranked.select("method", "n_runs", F.round("`metric.rmse.mean`", 4).alias("rmse_mean"), F.round("`metric.rmse.std`", 4).alias("rmse_std"), F.round("`metric.mae.mean`", 4).alias("mae_mean"), F.col("primary_metric_overall_rank").alias("overall_rank"))


@query("es_dummy_classifier", f"""with {ROWS}, c as (select resample_id, o_orderstatus, count(*) as n from rows_ where role = 'train' group by 1, 2),
t as (select resample_id, o_orderstatus as label, n / sum(n) over (partition by resample_id) as prior, row_number() over (partition by resample_id order by n desc, o_orderstatus) as r from c)
select rows_.resample_id, o_orderkey, label, round(prior, 8) as prior from rows_ join t on rows_.resample_id = t.resample_id and r = 1 where role = 'test'""")
def _(spark, d):
    return es.dummy_classifier(order_rows(spark, d), "o_orderstatus").select("resample_id", "o_orderkey", "label", F.round("prior", 8).alias("prior"))


@query("es_dummy_regressor", f"with {ROWS}, m as (select resample_id, avg(o_totalprice) as a, quantile_cont(o_totalprice, 0.5) as b from rows_ where role = 'train' group by 1) select resample_id, round(a, 4) as mean, round(b, 4) as median, count(*) as n from rows_ join m using (resample_id) where role = 'test' group by 1, 2, 3")
def _(spark, d):
    rows = order_rows(spark, d)
    mean = es.dummy_regressor(rows, "o_totalprice").groupBy("resample_id").agg(F.round(F.max("value"), 4).alias("mean"), F.count("*").alias("n"))
    median = es.dummy_regressor(rows, "o_totalprice", "median").groupBy("resample_id").agg(F.round(F.max("value"), 4).alias("median"))
    return mean.join(median, "resample_id")


@query("es_linear_regression", f"with {ROWS}, {FITS} select resample_id, o_orderkey, round(v, 3) as value from predicted where method = 'line'")
def _(spark, d):
    return es.line(order_rows(spark, d), "bag_size", "o_totalprice").select("resample_id", "o_orderkey", F.round("value", 3).alias("value"))


@query("es_ridge", f"""with {ROWS}, m as (select resample_id, avg(bag_size) as x, avg(o_totalprice) as y, covar_pop(bag_size, o_totalprice) / (var_pop(bag_size) + 100.0::double / count(*)) as b from rows_ where role = 'train' group by 1)
select resample_id, o_orderkey, round(y + b * (bag_size - x), 3) as value from rows_ join m using (resample_id) where role = 'test'""")
def _(spark, d):
    return es.line(order_rows(spark, d), "bag_size", "o_totalprice", alpha=100.0).select("resample_id", "o_orderkey", F.round("value", 3).alias("value"))


def _plane_rows(spark, d):
    """Orders with two features, for each fold and role."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.dayofmonth("o_orderdate").cast("double").alias("day"))
    sized = bg.bag_summary(orders, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", [], [])
    path = new_path(spark, "plane")
    rs.fold_roles(rs.kfold(orders.select("o_orderkey"), "o_orderkey", 5, seed=1).join(sized, "o_orderkey"), "o_orderkey", 5, "o_totalprice", "day", "bag_size").write.parquet(path)
    return spark.read.parquet(path)


PLANE = """n as (select o_orderkey, o_totalprice, date_part('day', o_orderdate)::double as day, count(l_orderkey)::double as bag_size from orders left join lineitem on l_orderkey = o_orderkey group by all),
f as (select *, ntile(5) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from n),
rows_ as materialized (select printf('fold_%02d', k) as resample_id, case when fold = k then 'test' else 'train' end as role, f.* from f, (select unnest(range(5)) as k))"""


def _plane_sql(alpha):
    return f"""with {PLANE}, m as (select resample_id, avg(bag_size) as a, avg(day) as b, avg(o_totalprice) as y, var_pop(bag_size) + {alpha} / count(*) as aa, var_pop(day) + {alpha} / count(*) as bb,
 covar_pop(bag_size, day) as ab, covar_pop(bag_size, o_totalprice) as ay, covar_pop(day, o_totalprice) as by_ from rows_ where role = 'train' group by 1)
select resample_id, o_orderkey, round(y + (ay * bb - by_ * ab) / (aa * bb - ab * ab) * (bag_size - a) + (by_ * aa - ay * ab) / (aa * bb - ab * ab) * (day - b), 2) as value
from rows_ join m using (resample_id) where role = 'test'"""


for _name, _alpha in (("es_linear_regression_of_two", 0.0), ("es_ridge_of_two", 500.0)):
    query(_name, _plane_sql(_alpha))(lambda spark, d, alpha=_alpha: es.linear(_plane_rows(spark, d), ["bag_size", "day"], "o_totalprice", alpha).select("resample_id", "o_orderkey", F.round("value", 2).alias("value")))


@query("es_logistic_of_all_folds", f"""with recursive {PLANE}, t as materialized (select resample_id, bag_size as x, (o_totalprice > 150000)::integer as y from rows_ where role = 'train'),
newton as (select distinct resample_id, 0 as i, 0.0::double as a, 0.0::double as b from t union all
 select resample_id, i + 1, a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab), b - (gb * haa - ga * hab) / (haa * hbb - hab * hab) from (
  select resample_id, i, a, b, sum(p - y) as ga, sum((p - y) * x) + b as gb, sum(p * (1 - p)) as haa, sum(p * (1 - p) * x) as hab, sum(p * (1 - p) * x * x) + 1 as hbb
  from (select n.*, x, y, 1 / (1 + exp(-(a + b * x))) as p from newton n join t using (resample_id) where i < 12) group by resample_id, i, a, b))
select resample_id, o_orderkey, round(1 / (1 + exp(-(a + b * bag_size))), 6) as probability, (a + b * bag_size >= 0)::integer as label from rows_ join newton using (resample_id) where role = 'test' and i = 12""")
def _(spark, d):
    rows = _plane_rows(spark, d).withColumn("dear", (F.col("o_totalprice") > 150000).cast("int"))
    found = es.logistic(rows, ["bag_size"], "dear")
    return found.select("resample_id", "o_orderkey", F.round(F.col("probabilities")[1], 6).alias("probability"), "label")


def _documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).cast("double").alias("pipes"),
                                               F.size(F.array_distinct(F.split("text", " "))).cast("double").alias("words"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("english"))
    return docs.join(table(spark, d, "labels"), "doc_id")


QUALITY = Task("binary", ["n_chars", "pipes", "words", "english"], "quality")


def _held_out(spark, rows, key):
    """Train and test rows of a hold-out split, which puts a third of the keys into the test; stored, as fits read them many times."""
    split = rows.join(rs.holdout(rows.select(key).distinct(), key, 1 / 3, seed=1).select(key, "role"), key)
    path = new_path(spark, "split")
    split.write.parquet(path)
    split = spark.read.schema(split.schema).parquet(path)
    return tuple(split.filter(F.col("role") == role).drop("role") for role in ("train", "test"))


def _model_query(kind, params=None, task=QUALITY):
    def run(spark, d):
        train, test = _held_out(spark, es.with_features(_documents(spark, d), task.source), "doc_id")
        return es.predict(es.fit(train, task, kind, params), test, task, "doc_id")

    return run


for _name, _kind in (("es_logistic_regression", "logistic_regression"), ("es_random_forest", "random_forest"), ("es_gradient_boosting", "gradient_boosting"), ("es_hist_boosting", "boosted_trees"), ("es_mlp_classifier", "simple_mlp"), ("es_predict", "logistic_regression")):
    query(_name)(_model_query(_kind))


@query("es_ridge_model", """with t as (select count(*) as n, avg(l_quantity) as x, avg(l_extendedprice) as y, covar_pop(l_quantity, l_extendedprice) as c, var_pop(l_quantity) as v from lineitem)
select round(c / (v + 50.0::double / n), 3) as slope, round(y - x * c / (v + 50.0::double / n), 2) as intercept from t""")
def _(spark, d):
    task = Task("regression", ["l_quantity"], "l_extendedprice")
    model = es.fit(es.with_features(table(spark, d, "lineitem"), task.source), task, "ridge", {"alpha": 50.0})
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double").select(F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("es_sample_weight")
def _(spark, d):
    rows = es.with_features(_documents(spark, d), QUALITY.source).withColumn("w", F.when(F.col("quality") == 0, 5.0).otherwise(1.0))
    task = Task("binary", QUALITY.source, "quality", weight="w")
    train, test = _held_out(spark, rows, "doc_id")
    return es.predict(es.fit(train, task, "logistic_regression"), test, task, "doc_id")


def _bags(spark, d):
    """Bags are orders, dear ones positive."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") > 250000).cast("int").alias("label"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000).toDF("l_orderkey", "l_linenumber", "q", "p")
    return lines.join(orders, "l_orderkey")


@query("es_bag_feature_model")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 250000).cast("int").alias("label"))
    summary = bg.bag_summary(orders, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ["l_quantity", "l_extendedprice"], ["mean", "max"]).fillna(0.0)
    task = Task("binary", [c for c in summary.columns if "__" in c or c == "bag_size"], "label")
    train, test = _held_out(spark, es.with_features(summary, task.source), "o_orderkey")
    return es.predict(es.fit(train, task, "logistic_regression"), test, task, "o_orderkey")


@query("es_instance_pooling")
def _(spark, d):
    train, test = _held_out(spark, es.with_features(_bags(spark, d), ["q", "p"]), "l_orderkey")
    return es.instance_pooling(train, test, Task("binary", ["q", "p"], "label"), "l_orderkey")


@query("es_mi_svm")
def _(spark, d):
    lines = _bags(spark, d).drop("label").withColumn("k", F.xxhash64("l_orderkey", "l_linenumber", "q", "p"))
    # an order is positive where one of its lines is dear, which is what the method assumes of bags
    dear = lines.groupBy("l_orderkey").agg((F.max("p") > 0.6).cast("int").alias("label"))
    train, test = _held_out(spark, lines.join(dear, "l_orderkey"), "l_orderkey")
    model, rounds, ended = es.mi_svm(train, "l_orderkey", "k", ["q", "p"], "label")
    return model.bags(test, "l_orderkey").withColumnRenamed("l_orderkey", "sample_id").withColumns({"rounds": F.lit(rounds), "ended": F.lit(ended)})


def _rings(spark, d):
    """Lines by deviation from the middle of quantity and discount; an order is positive where one of its lines is near the middle of both."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("k"), ((F.col("l_quantity") - 25.5) / 12).cast("double").alias("q"), ((F.col("l_discount") - 0.05) / 0.025).cast("double").alias("s"))
    inside = lines.groupBy("l_orderkey").agg((F.min(F.col("q") * F.col("q") + F.col("s") * F.col("s")) < 0.4).cast("int").alias("label"))
    return lines.join(inside, "l_orderkey")


@query("es_mi_svm_kernel")
def _(spark, d):
    train, test = _held_out(spark, _rings(spark, d), "l_orderkey")
    model, rounds, ended = es.mi_svm(train, "l_orderkey", "k", ["q", "s"], "label", params={"kernel": "rbf", "C": 10.0})
    truth = test.groupBy("l_orderkey").agg(F.max("label").alias("y_true"))
    return model.bags(test, "l_orderkey").join(truth, "l_orderkey").withColumns({"rounds": F.lit(rounds), "ended": F.lit(ended)})


BAG_STUDY = {"svm": st.Method("mi_svm", {"C": 10.0, "max_iterations": 3}), "pool": st.Method("instance_pooling")}


@query("rn_run_study_of_bags", """with b as (select l_orderkey, (min(pow((l_quantity - 25.5) / 12, 2) + pow((l_discount - 0.05) / 0.025, 2)) < 0.4)::integer as label from lineitem group by 1),
f as (select *, ntile(2) over (order by md5('1:' || l_orderkey), l_orderkey) - 1 as fold from b)
select 'rings:' || m || ':' || printf('fold_%02d', fold) || ':seed-0' as run_key, 'success' as status, count(*) as n_bags, sum(label)::bigint as n_positive from f, (select unnest(['svm', 'pool']) as m) group by m, fold""")
def _(spark, d):
    rows = stored(es.with_features(_rings(spark, d), ["q", "s"]), "rings")
    bags = rows.select("l_orderkey").distinct()
    folds = rs.fold_roles(stored(rs.kfold(bags, "l_orderkey", 2, seed=1), "folds"), "l_orderkey", 2)
    path = new_path(spark, "study")
    found = st.run_study("rings", rows, Task("binary", ["q", "s"], "label"), folds, "l_orderkey", BAG_STUDY, ["accuracy", "roc_auc"], path, instance="k")
    counts = st.stored_predictions(found, path).groupBy("run_key").agg(F.count("*").alias("n_bags"), F.sum("y_true").alias("n_positive"))
    return found.select("run_key", "status", "error").join(counts, "run_key", "left").drop("error")


def _study(spark, d, kinds):
    rows = es.with_features(_documents(spark, d), QUALITY.source)
    folds = rs.fold_roles(rs.kfold(rows, "doc_id", 2, seed=1), "doc_id", 2)
    return st.run_study("quality", rows, QUALITY, folds, "doc_id", {k: (k, {}) for k in kinds}, ["accuracy"], new_path(spark, "study"))


@query("rn_run_study")
def _(spark, d):
    return _study(spark, d, ["logistic_regression", "random_forest"]).select("run_key", "status", "metrics")


@query("rn_failed_rows", """select 'quality:' || m || ':' || printf('fold_%02d', f) || ':seed-0' as run_key, case m when 'logistic_regression' then 'success' else 'failed' end as status,
case m when 'linear_regression' then 'ValueError' end as error_type, case m when 'linear_regression' then 'linear_regression needs values' end as error, case m when 'logistic_regression' then n end as n_rows
from (select unnest(['logistic_regression', 'linear_regression']) as m), (select fold as f, count(*) as n from (select ntile(2) over (order by md5('1:' || doc_id), doc_id) - 1 as fold from labels join documents using (doc_id)) group by 1)""")
def _(spark, d):
    rows = es.with_features(_documents(spark, d), QUALITY.source)
    folds = rs.fold_roles(rs.kfold(rows, "doc_id", 2, seed=1), "doc_id", 2)
    path = new_path(spark, "study")
    found = st.run_study("quality", rows, QUALITY, folds, "doc_id", {k: (k, {}) for k in ("logistic_regression", "linear_regression")}, ["accuracy"], path)
    counts = st.stored_predictions(found, path).groupBy("run_key").agg(F.count("*").alias("n_rows"))
    return found.select("run_key", "status", "error_type", "error").join(counts, "run_key", "left")


def _raw_study(spark, d, methods, path):
    """Raw columns of labelled documents through each method's policy, on three folds."""
    from foldwise.operators.preprocess import Feature

    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    folds = rs.fold_roles(rs.kfold(docs, "doc_id", 3, seed=1), "doc_id", 3)
    features = [Feature("n_chars", "numeric", {"skewed"}), Feature("lang", "categorical"), Feature("source", "categorical", {"high_cardinality"})]
    task = Task("binary", [f.name for f in features], "quality")
    return st.run_study("raw", docs, task, folds, "doc_id", methods, ["accuracy"], path, features=features)


RAW_METHODS = {"dummy": st.Method("dummy_classifier"), "logistic": st.Method("logistic_at_once", options={"high_cardinality_max_categories": 5}), "forest": st.Method("random_forest")}


@query("rn_run_study_of_raw_columns")
def _(spark, d):
    return _raw_study(spark, d, RAW_METHODS, new_path(spark, "study")).select("run_key", "status", "error", "policy", "metrics")


@query("rn_study_goes_on", """with f as (select doc_id, quality, ntile(3) over (order by md5('1:' || doc_id), doc_id) - 1 as fold from documents join labels using (doc_id)),
c as (select k, quality, count(*) as n from f, (select unnest(range(3)) as k) where fold <> k group by 1, 2),
top as (select k, quality as label from (select *, row_number() over (partition by k order by n desc, quality) as r from c) where r = 1)
select 'raw:' || m || ':' || printf('fold_%02d', fold) || ':seed-0' as run_key, 'success' as status, count(*) as n_rows, case m when 'dummy' then round(avg((label = quality)::integer), 6) end as accuracy
from f join top on k = fold, (select unnest(['dummy', 'forest', 'logistic']) as m) group by m, fold""")
def _(spark, d):
    path = new_path(spark, "study")
    _raw_study(spark, d, {"dummy": RAW_METHODS["dummy"]}, path)
    # the second call finds the first one's runs done
    found = _raw_study(spark, d, RAW_METHODS, path)
    counts = st.stored_predictions(found, path).groupBy("run_key").agg(F.count("*").alias("n_rows"))
    accuracy = F.when(F.col("method") == "dummy", F.round(F.col("metrics")["accuracy"], 6))
    return found.join(counts, "run_key").select("run_key", "status", "n_rows", accuracy.alias("accuracy"))


@query("rn_refit")
def _(spark, d):
    path = new_path(spark, "refit")
    rf.refit(_documents(spark, d), QUALITY, "logistic_regression", path)
    return spark.read.schema("file string, length long, sha256 string").json(f"{path}/manifest")


@query("rn_load_refit")
def _(spark, d):
    path = new_path(spark, "refit")
    docs = _documents(spark, d)
    rf.refit(docs, QUALITY, "logistic_regression", path)
    model, task = rf.load_refit(spark, path)
    return rf.predict_refit(model, task, docs.drop("quality"), "doc_id")


def _raw_refit(spark, d):
    """Documents with raw columns, refitted with the linear policy, and the refit as it is loaded again."""
    from foldwise.plans import preprocessing as raw

    docs = raw.docs(spark, d).withColumn("target", (F.col("zeros") > 0).cast("int"))
    task, path = Task("binary", ["n_chars", "quality", "lang", "source"], "target"), new_path(spark, "refit")
    features = [f for f in raw.FEATURES if f.name in task.source]
    rf.refit(docs.filter("train"), task, "logistic_regression", path, features=features, options=raw.OPTIONS)
    return docs, *rf.load_refit(spark, path)


def _prepared_sql():
    from foldwise.plans import preprocessing as raw

    return f"""with recursive {raw.DOCS}, {raw.LINEAR} select doc_id, n_chars, quality, (lang_place = 0)::integer as lang_de, (source_place = 4)::integer as source_infrequent from made"""


@query("rn_load_refit_prepared", _prepared_sql())
def _(spark, d):
    docs, model, _ = _raw_refit(spark, d)
    return model.prepared(docs).select("doc_id", F.round("n_chars", 5).alias("n_chars"), F.round("quality", 5).alias("quality"), "lang_de", "source_infrequent")


@query("rn_load_refit_raw")
def _(spark, d):
    docs, model, task = _raw_refit(spark, d)
    return rf.predict_refit(model, task, docs.drop("target"), "doc_id")


@query("ud_estimator")
def _(spark, d):
    if "plain_forest" not in es.ESTIMATORS:
        es.register_estimator("plain_forest", lambda train, task, params: es.random_forest(train, task, {"n_estimators": 5, **params}))
    return _model_query("plain_forest")(spark, d)
