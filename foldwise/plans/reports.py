"""Queries on runs: a run summarises the orders of a month by priority (dataset) and order status (method)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import columns as fc
from foldwise.operators import reports as rp
from foldwise.plans.registry import query, table

GROUPS = ["dataset_name", "method"]


def runs(spark, d):
    """metric.rmse is a run's spread of prices, metric.accuracy the share of dear orders; runs of few orders failed."""
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset_name"), F.col("o_orderstatus").alias("method"), F.date_format("o_orderdate", "yyyyMM").alias("resample_id"), "o_totalprice", "o_custkey")
    found = orders.groupBy("dataset_name", "method", "resample_id").agg(
        F.count("*").alias("n"), F.stddev_samp("o_totalprice").alias("rmse"), F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("accuracy"), F.min("o_custkey").alias("tag"))
    return found.select(
        "dataset_name", "method", "resample_id", F.lit("main").alias("study_name"),
        F.when(F.col("n") >= 2, "success").otherwise("failed").alias("status"),
        F.when(F.col("n") >= 2, F.round("rmse", 4)).otherwise(float("nan")).alias("metric.rmse"), F.col("accuracy").alias("metric.accuracy"),
        (F.col("n") / 10.0).alias("fit_time"), F.lit("rmse").alias("primary_metric"), F.lit("False").alias("primary_metric_greater_is_better"),
        F.col("method").alias("metadata.model"), F.col("tag").cast("string").alias("metadata.tag"), F.lit("").alias("metadata.note"), F.substring("resample_id", 1, 4).alias("metadata.factor.year"))


RUNS = """runs as (select o_orderpriority as dataset_name, o_orderstatus as method, strftime(o_orderdate, '%Y%m') as resample_id, count(*) as n,
  round(stddev_samp(o_totalprice), 4) as rmse, avg((o_totalprice > 250000)::integer) as accuracy, min(o_custkey)::varchar as tag, count(*) / 10.0::double as fit_time,
  case when count(*) >= 2 then 'success' else 'failed' end as status from orders group by 1, 2, 3)"""


def stats(name, expr):
    q = lambda p: f"quantile_cont({expr}, {p})"
    return ", ".join(f'round({x}, 6) as "{name}.{k}"' for k, x in (("mean", f"avg({expr})"), ("std", f"stddev_samp({expr})"), ("min", f"min({expr})"), ("q25", q(0.25)), ("median", q(0.5)), ("q75", q(0.75)), ("max", f"max({expr})"),
        ("iqr", f"{q(0.75)} - {q(0.25)}"))) + f', count({expr}) as "{name}.count"'


RMSE = "case when n >= 2 then rmse end"
SUMMARY = f"""select dataset_name, method, count(*) as n_runs, count(*) filter (status = 'success') as n_success, count(*) filter (status <> 'success') as n_failed,
 {stats('metric.rmse', RMSE)}, {stats('metric.accuracy', 'accuracy')}, {stats('fit_time', 'fit_time')} from runs group by 1, 2"""


def _summary(spark, d, **options):
    return rp.aggregate_runs(runs(spark, d), GROUPS, **options)


def _round(frame, digits=6):
    return frame.select(*[F.round(rp.named(c), digits).alias(c) if k == "double" else rp.named(c) for c, k in frame.dtypes])


@query("ag_run_summary", f"with {RUNS} {SUMMARY}")
def _(spark, d):
    found = _round(_summary(spark, d))
    return found.select(*[rp.named(c) for c in found.columns if c in GROUPS or c.startswith("n_") or c.startswith("fit_time") or c.startswith("metric.")])


@query("ag_one_value", f"""with {RUNS} select dataset_name, case when count(distinct nullif(method, '')) = 1 then min(nullif(method, '')) end as method, case when count(distinct nullif(tag, '')) = 1 then min(nullif(tag, '')) end as tag from runs group by 1""")
def _(spark, d):
    return runs(spark, d).groupBy("dataset_name").agg(rp.one_value(F.col("method")).alias("method"), rp.one_value(rp.named("metadata.tag")).alias("tag"))


@query("ag_drop_empty_metadata", f"""with {RUNS} select * from (select dataset_name, method, n_runs, unnest(['metadata.model', 'metadata.tag', 'metadata.factor.year']) as name, unnest([model, tag, year]) as value from (
select dataset_name, method, count(*) as n_runs, method as model, case when count(distinct tag) = 1 then min(tag) end as tag, case when count(distinct substr(resample_id, 1, 4)) = 1 then min(substr(resample_id, 1, 4)) end as year from runs group by 1, 2)) qualify count(value) over (partition by name) > 0""")
def _(spark, d):
    found = rp.without_empty_metadata(_summary(spark, d))
    kept = sorted(c for c in found.columns if c.startswith("metadata."))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), rp.named(c).alias("value")) for c in kept]))
    return found.select(*GROUPS, "n_runs", cells.alias("c")).select(*GROUPS, "n_runs", "c.name", "c.value")


@query("ag_primary_stats", f"""with {RUNS} select dataset_name, method, 'rmse' as primary_metric_name, count({RMSE}) as primary_metric_count, round(avg({RMSE}), 6) as primary_metric_mean, round(stddev_samp({RMSE}), 6) as primary_metric_std,
round(quantile_cont({RMSE}, 0.75) - quantile_cont({RMSE}, 0.25), 6) as primary_metric_iqr from runs group by 1, 2""")
def _(spark, d):
    return _round(_summary(spark, d).select(*GROUPS, "primary_metric_name", *[f"primary_metric_{s}" for s in ("count", "mean", "std", "iqr")]))


@query("ag_factor_grouping", f"""with {RUNS} select dataset_name, method, substr(resample_id, 1, 4) as "metadata.factor.year", count(*) as n_runs, round(avg(accuracy), 6) as "metric.accuracy.mean" from runs group by 1, 2, 3""")
def _(spark, d):
    return _round(_summary(spark, d, factors=True).select(*GROUPS, "`metadata.factor.year`", "n_runs", "`metric.accuracy.mean`"))


RANKS = f"""summary as (select dataset_name, method, 'main' as study_name, count(*) as n_runs, count(*) filter (status = 'success') as n_success, count({RMSE}) as c, round(avg({RMSE}), 6) as score from runs where dataset_name <> '5-LOW' or method <> 'P' group by 1, 2),
ranked as (select *, case when ok then rank() over (partition by study_name, dataset_name, ok order by score) end as r from (select *, n_success = n_runs and c = n_success and score is not null as ok from summary)),
cells as (select study_name, count(distinct dataset_name) as k from ranked group by 1),
per as (select study_name, method, count(r) as rank_count, avg(r) as mean_rank from ranked where r is not null group by 1, 2),
overall as (select *, rank_count / k::double as coverage, case when rank_count = k then rank() over (partition by study_name, rank_count = k order by mean_rank) end as overall_rank from per join cells using (study_name))"""


def _ranked(spark, d):
    found = _round(rp.aggregate_runs(runs(spark, d).filter("dataset_name <> '5-LOW' or method <> 'P'"), ["study_name", *GROUPS]))
    return rp.with_ranks(found, rank_by=("study_name", "dataset_name"))


@query("wn_case_rank", f"with {RUNS}, {RANKS} select dataset_name, method, score as primary_metric_mean, r::double as primary_metric_rank_by_dataset from ranked")
def _(spark, d):
    return _ranked(spark, d).select(*GROUPS, "primary_metric_mean", "primary_metric_rank_by_dataset")


@query("wn_overall_rank", f"with {RUNS}, {RANKS} select method, mean_rank as primary_metric_mean_rank, overall_rank::double as primary_metric_overall_rank from overall")
def _(spark, d):
    return _ranked(spark, d).filter("primary_metric_mean_rank is not null").select("method", "primary_metric_mean_rank", "primary_metric_overall_rank").distinct()


@query("ag_rank_coverage", f"with {RUNS}, {RANKS} select method, rank_count as primary_metric_rank_count, round(coverage, 6) as primary_metric_rank_coverage from overall")
def _(spark, d):
    return _ranked(spark, d).filter("primary_metric_rank_count is not null").select("method", "primary_metric_rank_count", F.round("primary_metric_rank_coverage", 6).alias("primary_metric_rank_coverage")).distinct()


@query("jn_rank_merge", f"with {RUNS}, {RANKS} select ranked.dataset_name, ranked.method, rank_count as primary_metric_rank_count, overall_rank::double as primary_metric_overall_rank from ranked left join overall on ranked.study_name is not distinct from overall.study_name and ranked.method is not distinct from overall.method")
def _(spark, d):
    return _ranked(spark, d).select(*GROUPS, "primary_metric_rank_count", "primary_metric_overall_rank")


@query("rn_aggregate_report", f"with {RUNS}, {RANKS} select dataset_name, ranked.method, n_runs, n_success, n_runs - n_success as n_failed, score as primary_metric_mean, r::double as primary_metric_rank_by_dataset, mean_rank as primary_metric_mean_rank, overall_rank::double as primary_metric_overall_rank from ranked left join overall on ranked.method = overall.method")
def _(spark, d):
    return _ranked(spark, d).select(*GROUPS, "n_runs", "n_success", "n_failed", "primary_metric_mean", "primary_metric_rank_by_dataset", "primary_metric_mean_rank", "primary_metric_overall_rank")


@query("rn_select_best", f"with {RUNS}, {RANKS} select study_name, method, mean_rank as primary_metric_mean_rank from overall where overall_rank = 1")
def _(spark, d):
    return _ranked(spark, d).filter("primary_metric_overall_rank = 1").select("study_name", "method", "primary_metric_mean_rank").distinct()


@query("so_distinct", f"with {RUNS} select distinct dataset_name, method from runs")
def _(spark, d):
    return runs(spark, d).dropDuplicates(GROUPS).select(*GROUPS)


def records(spark, d):
    """Runs as records with maps."""
    found = runs(spark, d)
    return found.select("dataset_name", "method", "resample_id", "status", "fit_time", F.create_map(F.lit("rmse"), rp.named("metric.rmse"), F.lit("accuracy"), rp.named("metric.accuracy")).alias("metrics"),
                        F.create_map(F.lit("tag"), rp.named("metadata.tag"), F.lit("model"), rp.named("metadata.model")).alias("metadata"))


@query("rn_results_table", f"""with {RUNS} select dataset_name, method, resample_id, status, fit_time, accuracy as "metric.accuracy", {RMSE} as "metric.rmse", method as "metadata.model", tag as "metadata.tag" from runs""")
def _(spark, d):
    found = rp.run_rows(records(spark, d))
    return found.withColumn("metric.rmse", fc.finite(rp.named("metric.rmse")))


@query("rn_run_key", f"with {RUNS} select dataset_name || ':' || method || ':' || resample_id || ':seed-7' as run_key from runs")
def _(spark, d):
    return runs(spark, d).select(fc.run_key(F.col("dataset_name"), F.col("method"), F.col("resample_id"), F.lit(7)).alias("run_key"))


@query("rn_metric_direction", f"with {RUNS}, d(metric, up) as (values ('accuracy', true), ('rmse', false)) select run, metric, up as greater_is_better from (select dataset_name || ':' || method || ':' || resample_id as run, case when n % 2 = 0 then 'rmse' else 'accuracy' end as metric from runs) join d using (metric)")
def _(spark, d):
    from foldwise.operators.metrics import GREATER_IS_BETTER

    directions = spark.createDataFrame(list(GREATER_IS_BETTER.items()), "metric string, greater_is_better boolean")
    found = runs(spark, d).select(F.concat_ws(":", "dataset_name", "method", "resample_id").alias("run"), F.when(F.round(F.col("fit_time") * 10) % 2 == 0, "rmse").otherwise("accuracy").alias("metric"))
    return found.join(F.broadcast(directions), "metric")  # the metrics there are


@query("rn_metadata_merge", f"with {RUNS} select dataset_name, method, resample_id, method as model, 'plan' as origin, tag from runs")
def _(spark, d):
    case = F.create_map(F.lit("model"), F.lit("none"), F.lit("tag"), rp.named("metadata.tag"))
    method = F.create_map(F.lit("model"), F.col("method"), F.lit("origin"), F.lit("method"))
    plan = F.create_map(F.lit("origin"), F.lit("plan"))
    merged = runs(spark, d).withColumn("m", rp.merged_metadata(case, method, plan))
    return merged.select("dataset_name", "method", "resample_id", *[F.col("m")[k].alias(k) for k in ("model", "origin", "tag")])


@query("prj_source_lineage", "select p_partkey, coalesce(nullif(p_brand, ''), 'part') as source, p_type as detail from part")
def _(spark, d):
    details = F.create_map(F.lit("source"), F.nullif("p_brand", F.lit("")), F.lit("detail"), F.col("p_type"))
    merged = rp.merged_metadata(F.create_map(F.lit("source"), F.lit("part")), F.map_filter(details, lambda k, v: v.isNotNull()))
    return table(spark, d, "part").withColumn("m", merged).select("p_partkey", F.col("m")["source"].alias("source"), F.col("m")["detail"].alias("detail"))


@query("jn_plan_cross", """select c_mktsegment as case_name, m as method, printf('fold_%02d', f) as resample_id, s as seed, c_mktsegment || ':' || m || ':' || printf('fold_%02d', f) || ':seed-' || s as run_key
from (select distinct c_mktsegment from customer), (select unnest(['mean', 'ridge']) as m), (select unnest(range(3)) as f), (select unnest([0, 1]) as s)""")
def _(spark, d):
    # a plan is the product of its parts by definition: one row for each run
    cases = table(spark, d, "customer").select(F.col("c_mktsegment").alias("case_name")).distinct()
    plan = cases.select("case_name", F.explode(F.array(F.lit("mean"), F.lit("ridge"))).alias("method")).withColumn(
        "resample_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.format_string("fold_%02d", i)))).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    return plan.withColumn("run_key", fc.run_key(F.col("case_name"), F.col("method"), F.col("resample_id"), F.col("seed")))


@query("snk_markdown_lines", f"""with {RUNS} select '| ' || replace(dataset_name, '|', '\\|') || ' | ' || method || ' | ' || count(*) || ' |' as line from runs group by dataset_name, method""")
def _(spark, d):
    return rp.markdown_lines(_summary(spark, d).select(*GROUPS, "n_runs"))


HISTORY = "h as (select user_id, row_number() over (partition by user_id order by ts, event_id) as epoch, round(value, 2) as score from events)"


def history(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("epoch"), F.round("value", 2).alias("score"))


@query("wn_best_epoch", f"with {HISTORY} select user_id, epoch, score from (select *, row_number() over (partition by user_id order by score desc, epoch) as r from h) where r = 1")
def _(spark, d):
    return rp.best_epoch(history(spark, d), "user_id", "epoch", "score")


@query("wn_early_stop", f"""with {HISTORY}, b as (select *, case when score > coalesce(max(score) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding), -1e300) then 1 else 0 end as better from h),
g as (select *, sum(better) over (partition by user_id order by epoch) as blk from b), m as (select *, sum(1 - better) over (partition by user_id, blk order by epoch) as misses from g)
select user_id, min(epoch) filter (misses >= 5) as stop_epoch from m group by 1""")
def _(spark, d):
    return rp.early_stop(history(spark, d), "user_id", "epoch", "score", 5)


@query("wn_checkpoint_schedule", f"with {HISTORY} select user_id, epoch from (select user_id, epoch, row_number() over (partition by user_id order by epoch desc) as r from h where epoch > 3 and epoch % 4 = 0) where r <= 2")
def _(spark, d):
    return rp.kept_checkpoints(history(spark, d), "user_id", "epoch", 3, 4, 2)
