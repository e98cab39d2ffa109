"""Run summaries: one row for each run; aggregated for each group of runs, ranked in each comparison and over all.

A run has status, metrics ``metric.<name>``, times and ``metadata.<name>``. Column names with dots are quoted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.functions.columns import finite, markdown_value, true_false

#: Default grouping of the aggregate report and of its ranks.
GROUP_BY = ("study_name", "case_name", "dataset_name", "task_name", "method")
RANK_BY = ("study_name", "case_name", "dataset_name", "task_name")
OVERALL_BY = ("study_name",)
TIMES = ("fit_time", "predict_time")
#: The columns that come first in a table of runs.
FIRST = ("run_key", "study_name", "case_name", "dataset_name", "task_name", "task_type", "method", "resample_id", "seed", "status",
         "primary_metric", "primary_metric_greater_is_better", "fit_time", "predict_time", "error")


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def run_rows(records: DataFrame) -> DataFrame:
    """Flat rows from records with maps ``metrics`` and ``metadata``: the fixed columns, then each map's keys, sorted."""
    out = records
    plain = [c for c in FIRST if c in records.columns]
    wide = []
    for source, prefix in (("metrics", "metric"), ("metadata", "metadata")):
        keys = [r[0] for r in records.select(F.explode(F.map_keys(source))).distinct().orderBy(F.lit(1)).collect()]
        wide += [F.col(source)[k].alias(f"{prefix}.{k}") for k in sorted(keys)]
    return out.select(*plain, *wide)


def merged_metadata(*maps: Column) -> Column:
    """Maps merged; of equal keys the later map's value stays."""
    def two(a: Column, b: Column) -> Column:
        keep = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
        return F.map_concat(keep, b)

    empty = F.create_map().cast("map<string,string>")
    return reduce(two, [F.coalesce(m, empty) for m in maps])


def one_value(value: Column) -> Column:
    """The single non-empty value of a group, else null (an aggregate)."""
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.when(F.count_distinct(text) == 1, F.min(text))


def value_columns(runs: DataFrame, times: Sequence[str] = TIMES) -> list[str]:
    return [c for c in runs.columns if c.startswith("metric.") or c in times]


def statistics(name: str) -> list[Column]:
    """Eight statistics of a column; NaN, infinities and text that is no number are left out."""
    v = finite(named(name))
    q = lambda p: F.percentile(v, F.lit(p))
    made = {"count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "q25": q(0.25), "median": q(0.5), "q75": q(0.75), "max": F.max(v)}
    return [x.alias(f"{name}.{k}") for k, x in made.items()]


def aggregate_runs(runs: DataFrame, group_by: Sequence[str] = GROUP_BY, times: Sequence[str] = TIMES, factors: bool = False) -> DataFrame:
    """Counts, statistics of metrics and times, and metadata that is the same in all runs of a group."""
    groups = list(group_by)
    if factors:
        groups += [c for c in runs.columns if c.startswith("metadata.factor.") and c not in groups]
    for g in groups:
        if g not in runs.columns:
            runs = runs.withColumn(g, F.lit(""))
    values = value_columns(runs, times)
    metadata = [c for c in runs.columns if c.startswith("metadata.") and c not in groups]
    ones = {"task_type": "task_type", "primary_metric": "primary_metric_name", "primary_metric_greater_is_better": "primary_metric_greater_is_better"}
    found = runs.groupBy(*[named(g) for g in groups]).agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(~F.col("status").eqNullSafe("success")).alias("n_failed"),
        *[one_value(named(c)).alias(a) for c, a in ones.items() if c in runs.columns],
        *[one_value(named(c)).alias(c) for c in metadata],
        *[s for v in values for s in statistics(v)])
    found = found.withColumns({f"{v}.iqr": named(f"{v}.q75") - named(f"{v}.q25") for v in values}) if values else found
    return with_primary(found)


def without_empty_metadata(report: DataFrame) -> DataFrame:
    """Drop metadata columns that no group has a value of."""
    metadata = [c for c in report.columns if c.startswith("metadata.")]
    if not metadata:
        return report
    counts = report.agg(*[F.count(named(c)).alias(str(i)) for i, c in enumerate(metadata)]).first()
    return report.drop(*[c for i, c in enumerate(metadata) if not counts[i]])


def with_primary(report: DataFrame) -> DataFrame:
    """Each group's own primary metric's statistics under common names."""
    if "primary_metric_name" not in report.columns:
        return report
    metrics = sorted(c.removeprefix("metric.").removesuffix(".mean") for c in report.columns if c.startswith("metric.") and c.endswith(".mean"))
    if not metrics:
        return report
    return report.withColumns({f"primary_metric_{s}": F.coalesce(*[F.when(F.col("primary_metric_name") == m, named(f"metric.{m}.{s}")) for m in metrics]) for s in ("count", "mean", "std", "iqr")})


def complete() -> Column:
    """Groups that take part in ranks: all runs succeeded and have the primary metric."""
    return F.coalesce((F.col("n_runs") > 0) & (F.col("n_success") == F.col("n_runs")) & (F.col("primary_metric_count") == F.col("n_success")) &
                      F.col("primary_metric_mean").isNotNull() & true_false(F.col("primary_metric_greater_is_better")).isNotNull(), F.lit(False))


def with_ranks(report: DataFrame, rank_by: Sequence[str] = RANK_BY, overall_by: Sequence[str] = OVERALL_BY, method: str = "method") -> DataFrame:
    """Rank in each comparison, and each method's mean rank, coverage and overall rank; null keys are keys.

    A report without a primary metric stays as it is; key columns that it lacks are added as empty text.
    """
    if not {"primary_metric_mean", "primary_metric_count", "primary_metric_greater_is_better"} <= set(report.columns):
        return report
    report = report.withColumns({c: F.lit("") for c in (*overall_by, *rank_by, method) if c not in report.columns})
    up = true_false(F.col("primary_metric_greater_is_better"))
    score = F.when(up, -F.col("primary_metric_mean")).otherwise(F.col("primary_metric_mean"))
    cell = W.partitionBy(*[named(c) for c in rank_by], up, complete()).orderBy(score)
    ranked = report.withColumn("primary_metric_rank_by_dataset", F.when(complete(), F.rank().over(cell)).cast("double"))
    return ranked_over_all(ranked, rank_by, overall_by, method)


def ranked_over_all(ranked: DataFrame, rank_by: Sequence[str], overall_by: Sequence[str], method: str) -> DataFrame:
    cells = list(dict.fromkeys([*overall_by, *rank_by]))
    counts = ranked.select(*[named(c) for c in cells]).distinct().groupBy(*[named(c) for c in overall_by]).agg(F.count("*").alias("_cells"))
    per = ranked.filter("primary_metric_rank_by_dataset is not null").groupBy(*[named(c) for c in (*overall_by, method)]).agg(
        F.count("*").alias("primary_metric_rank_count"), F.avg("primary_metric_rank_by_dataset").alias("primary_metric_mean_rank"))
    per = null_safe_join(per, counts, overall_by).withColumn("primary_metric_rank_coverage", F.col("primary_metric_rank_count") / F.col("_cells"))
    full = F.col("primary_metric_rank_count") == F.col("_cells")
    order = W.partitionBy(*[named(c) for c in overall_by], full).orderBy("primary_metric_mean_rank")
    per = per.withColumn("primary_metric_overall_rank", F.when(full, F.rank().over(order)).cast("double")).drop("_cells")
    return null_safe_join(ranked, per, [*overall_by, method])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join in which null keys match."""
    other = right.select(*[named(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[named(c) for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [named(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)], F.lit(True))
    return left.join(other, on, "left").drop(*[f"_key_{i}" for i in range(len(keys))])


def markdown_lines(report: DataFrame) -> DataFrame:
    """One line of a Markdown table for each row; doubles with six significant digits."""
    def cell(name: str, kind: str) -> Column:
        # format_string takes null as the text null
        return F.when(named(name).isNull(), "").otherwise(F.format_string("%.6g", named(name)) if kind == "double" else markdown_value(named(name)))

    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, k) for c, k in report.dtypes]), F.lit(" |")).alias("line"))


def best_epoch(history: DataFrame, run: str, epoch: str, score: str, greater_is_better: bool = True) -> DataFrame:
    """The epoch of each run with the best score, the earliest on ties."""
    value = F.col(score) if greater_is_better else -F.col(score)
    return history.groupBy(run).agg(F.max_by(F.struct(epoch, score), F.struct(value, -F.col(epoch).cast("long"))).alias("_b")).select(run, "_b.*")


def early_stop(history: DataFrame, run: str, epoch: str, score: str, patience: int) -> DataFrame:
    """The first epoch of each run after which ``patience`` epochs in a row brought no better score; null: never."""
    order = W.partitionBy(run).orderBy(epoch)
    best = F.max(score).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = history.withColumn("_better", (F.coalesce(best < F.col(score), F.lit(True))).cast("int"))
    blocks = marked.withColumn("_block", F.sum("_better").over(order.rowsBetween(W.unboundedPreceding, 0)))
    misses = blocks.withColumn("_misses", F.sum(1 - F.col("_better")).over(W.partitionBy(run, "_block").orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)))
    return misses.groupBy(run).agg(F.min(F.when(F.col("_misses") >= patience, F.col(epoch))).alias("stop_epoch"))


def kept_checkpoints(history: DataFrame, run: str, epoch: str, delay: int, every: int, last: int) -> DataFrame:
    """Epochs after a delay, each so many, of which the last few are kept."""
    order = W.partitionBy(run).orderBy(F.col(epoch).desc())
    return history.select(run, epoch).distinct().filter((F.col(epoch) > delay) & (F.col(epoch) % every == 0)).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= last).drop("_n")
