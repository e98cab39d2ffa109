"""Metrics over a table of predictions: group columns, y_true and the fields that a metric needs.

Fields: label (accuracy), probabilities (log_loss, roc_auc), score (roc_auc), value (mse, rmse, mae); weight if asked for.
All metrics but roc_auc are aggregates of one groupBy over all runs.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.functions.columns import place, same
from foldwise.sources.store import stored

EPSILON = 2.220446049250313e-16


def mean(value: Column, weight: Column | None) -> Column:
    return F.avg(value) if weight is None else F.sum(weight * value) / F.sum(weight)


def accuracy(weight: Column | None = None, normalize: bool = True) -> Column:
    hit = F.col("label").eqNullSafe(F.col("y_true")).cast("double")
    if normalize:
        return mean(hit, weight)
    return F.sum(hit if weight is None else hit * weight)


def log_loss(weight: Column | None = None) -> Column:
    """y_true is the position of the class among the sorted classes."""
    p = F.greatest(F.least(F.col("probabilities")[F.col("y_true").cast("int")], F.lit(1 - EPSILON)), F.lit(EPSILON))
    return mean(-F.log(p), weight)


def mse(weight: Column | None = None) -> Column:
    return mean((F.col("y_true") - F.col("value")) * (F.col("y_true") - F.col("value")), weight)


def rmse(weight: Column | None = None) -> Column:
    return F.sqrt(mse(weight))


def mae(weight: Column | None = None) -> Column:
    return mean(F.abs(F.col("y_true") - F.col("value")), weight)


#: Name -> aggregate; register further ones with register_metric.
METRICS: dict[str, Callable[..., Column]] = {"accuracy": accuracy, "log_loss": log_loss, "mse": mse, "rmse": rmse, "mae": mae}
#: Which fields a metric reads, and its direction.
FIELDS = {"accuracy": "label", "log_loss": "probabilities", "mse": "value", "rmse": "value", "mae": "value", "roc_auc": "score"}
GREATER_IS_BETTER = {"accuracy": True, "roc_auc": True, "log_loss": False, "mse": False, "rmse": False, "mae": False}


def register_metric(name: str, function: Callable[..., Column], field: str, greater_is_better: bool) -> None:
    """Make an aggregate available to metrics_of."""
    if name in METRICS or name == "roc_auc":
        raise ValueError(f"metric {name} exists already")
    METRICS[name], FIELDS[name], GREATER_IS_BETTER[name] = function, field, greater_is_better


#: Ranges of scores that a group's windows are cut into.
RANGES = 256


def roc_auc(predictions: DataFrame, by: Sequence[str], score: str = "score", positive: Column | None = None, name: str = "roc_auc", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve of each group; ties count half; null where a class is missing.

    Equal scores are counted (or their weights summed) together first, and written, as they are read twice. A group's scores are cut
    into ranges at approximate quantiles; windows run inside ranges only, and what lies below a range comes from sums by range.
    """
    by = list(by)
    good = F.coalesce(F.col("y_true") == 1 if positive is None else positive, F.lit(False))
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("double")
    steps = stored(predictions.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_score")).agg(
        F.sum(F.when(good, one).otherwise(0)).alias("_p"), F.sum(F.when(good, 0).otherwise(one)).alias("_n")), "roc-steps")
    renamed = [F.col(c).alias(f"_{c}") for c in by]
    fractions = [i / RANGES for i in range(1, RANGES)]
    # a row for each group, written so that Spark knows its size
    cuts = stored(steps.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("_score", fractions, 10 * RANGES))).alias("_cuts")).select(*renamed, "_cuts"), "roc-cuts")
    ranged = steps.join(cuts, same(by, "_")).withColumn("_range", place(F.col("_score"), F.col("_cuts"), RANGES)).select(*by, "_range", "_score", "_p", "_n")
    inside = F.sum("_n").over(W.partitionBy(*by, "_range").orderBy("_score").rowsBetween(W.unboundedPreceding, -1))
    counted = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    won = F.col("_p") * (F.col("_inside") + F.col("_n") / 2.0)
    # a row for each group and range from here on
    sums = counted.withColumn("_won", won).groupBy(*by, "_range").agg(F.sum("_won").alias("_won"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    whole = sums.withColumn("_won", F.col("_won") + F.col("_p") * F.coalesce(earlier, F.lit(0)))
    total = whole.groupBy(*by).agg(F.sum("_won").alias("_won"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return total.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_won") / (F.col("_p").cast("double") * F.col("_n"))).alias(name))


def roc_auc_ovr(predictions: DataFrame, by: Sequence[str], name: str = "roc_auc", weight: str | None = None, average: str = "macro") -> DataFrame:
    """The mean over the classes of each one's area against all others; ``average`` weighted: by the classes' rows (or weights).

    Of two classes only the second counts, whose area is that of both; which rows have two is told by the arrays' length.
    """
    by, kept = list(by), [weight] if weight else []
    # the arrays themselves don't go along with their entries
    each = predictions.select(*by, "y_true", *kept, F.size("probabilities").alias("_size"), F.posexplode("probabilities").alias("_class", "_probability"))
    each = each.filter((F.col("_size") > 2) | ((F.col("_size") == 2) & (F.col("_class") == 1)))
    areas = roc_auc(each, [*by, "_class"], "_probability", F.col("y_true") == F.col("_class"), "_auc", weight)
    if average == "macro":
        return areas.groupBy(*by).agg(F.avg("_auc").alias(name))
    one = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sizes = predictions.groupBy(*by, F.col("y_true").cast("int").alias("_true")).agg(F.sum(one).alias("_size")).select(*[F.col(c).alias(f"_{c}") for c in by], "_true", "_size")
    sized = areas.join(sizes, same(by, "_") & (F.col("_class") == F.col("_true")))
    return sized.groupBy(*by).agg((F.sum(F.col("_auc") * F.col("_size")) / F.sum(F.when(F.col("_auc").isNotNull(), F.col("_size")))).alias(name))


def areas_of(predictions: DataFrame, by: Sequence[str], weight: str | None = None, average: str = "macro", multi_class: str = "ovr") -> DataFrame:
    """roc_auc from probabilities, where there are any, else from scores."""
    if multi_class != "ovr" or average not in ("macro", "weighted"):
        raise ValueError(f"roc_auc of several classes is one against all others, macro or weighted, not {multi_class} and {average}")
    if "probabilities" not in predictions.columns:
        return roc_auc(predictions, by, weight=weight)
    return roc_auc_ovr(predictions, by, weight=weight, average=average)


def metrics_of(predictions: DataFrame, by: Sequence[str], names: Sequence[str], weight: str | None = None, options: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """The requested metrics of every group, as columns; a metric without its field, or an option that it doesn't know, is an error.

    ``weight``: a column of weights, which all metrics but registered ones that don't take any use. ``options``: further arguments by metric.
    """
    by, options = list(by), options or {}
    for name in names:
        if name not in METRICS and name != "roc_auc":
            raise KeyError(f"unknown metric {name}; known: {sorted([*METRICS, 'roc_auc'])}")
        if FIELDS[name] not in predictions.columns and not (name == "roc_auc" and "probabilities" in predictions.columns):
            raise ValueError(f"{name} needs the field {FIELDS[name]}")
    for name in options:
        known = set(inspect.signature(areas_of if name == "roc_auc" else METRICS[name]).parameters) - {"predictions", "by", "weight"}
        if name not in names or set(options[name]) - known:
            raise ValueError(f"{name} doesn't take the options {sorted(set(options[name]) - known) or 'without being asked for'}")
    plain = [n for n in names if n != "roc_auc"]
    parts = []
    if plain:
        w = None if weight is None else F.col(weight)
        parts.append(predictions.groupBy(*by).agg(*[METRICS[n](w, **options.get(n, {})).alias(n) for n in plain]))
    if "roc_auc" in names:
        areas = areas_of(predictions, by, weight, **options.get("roc_auc", {}))
        if not plain:
            return areas
        parts.append(areas.select(*[F.col(c).alias(f"_{c}") for c in by], "roc_auc"))
    return reduce(lambda a, b: a.join(b, same(by, "_"), "left"), parts).select(*by, *names)
