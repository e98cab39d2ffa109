"""Bags of instances: summaries, pooling and statistics for each bag, as one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.functions.columns import place

#: Named bag statistics; register further ones here.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}

#: Difference of probabilities that is no difference.
TIE = 1e-12


def register_statistic(name: str, function: Callable[[Column], Column]) -> None:
    """Make an aggregate of a column available to bag_summary."""
    if name in STATISTICS:
        raise ValueError(f"statistic {name} exists already")
    STATISTICS[name] = function


def bag_summary(bags: DataFrame, instances: DataFrame, bag_id: str, instance_bag: str, columns: Sequence[str], statistics: Sequence[str] = ("mean", "std", "min", "max")) -> DataFrame:
    """One row for each bag: bag_size and ``column__statistic``; empty bags have size 0 and nulls; nulls and NaN are skipped.

    Instances are aggregated before the join, so that a row for each bag is all that is joined.
    """
    unknown = set(statistics) - set(STATISTICS)
    if unknown:
        raise KeyError(f"unknown statistics {sorted(unknown)}; known: {sorted(STATISTICS)}")
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    names = [f"{c}__{s}" for c in columns for s in statistics]
    clash = set(names) & set(bags.columns)
    if clash:
        raise ValueError(f"bags have columns {sorted(clash)} already")
    found = instances.groupBy(F.col(instance_bag).alias("_bag")).agg(
        F.count("*").alias("bag_size"), *[STATISTICS[s](clean[c]).alias(f"{c}__{s}") for c in columns for s in statistics])
    return bags.join(found, F.col(bag_id) == F.col("_bag"), "left").drop("_bag").withColumn("bag_size", F.coalesce("bag_size", F.lit(0)))


def pooled_probabilities(instances: DataFrame, bag: str, probabilities: Sequence[str], how: str = "max") -> DataFrame:
    """Class probabilities of each bag: the instances' maxima or means, scaled to the sum 1; the label is the first largest.

    Probabilities that are TIE apart or less are equally large, as sums of doubles depend on their order.
    """
    pool = {"max": F.max, "mean": F.avg}[how]
    found = instances.groupBy(bag).agg(*[pool(c).alias(c) for c in probabilities])
    total = sum((F.col(c) for c in probabilities), F.lit(0.0))
    scaled = found.select(bag, F.array(*[F.col(c) / total for c in probabilities]).alias("probabilities"))
    most = F.array_max("probabilities")
    first = F.array_position(F.transform("probabilities", lambda p: p >= most - TIE), True) - 1
    return scaled.withColumn("label", F.when(most.isNotNull(), first).cast("int"))


def pooled_vectors(instances: DataFrame, bag: str, vector: str, mask: Column | None = None, how: str = "mean") -> DataFrame:
    """Sum or mean of the vectors of each bag, entry by entry; masked instances don't count."""
    pool = {"mean": F.avg, "sum": F.sum}[how]
    kept = instances if mask is None else instances.filter(mask)
    entries = kept.select(bag, F.posexplode(vector).alias("entry", "value")).groupBy(bag, "entry").agg(pool(F.col("value").cast("double")).alias("value"))
    return entries.groupBy(bag).agg(F.sort_array(F.collect_list(F.struct("entry", "value"))).alias("e")).select(bag, F.transform("e", lambda e: e["value"]).alias(vector))


def attention_weights(instances: DataFrame, bag: str, score: str) -> DataFrame:
    """The instances with ``weight``: the softmax of a score within the bag."""
    within = W.partitionBy(bag)
    raw = F.exp(F.col(score) - F.max(score).over(within))
    return instances.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(within)).drop("_raw")


def attention_pool(instances: DataFrame, bag: str, score: str, columns: Sequence[str]) -> DataFrame:
    """Weighted mean of columns by the softmax of a score within the bag, from aggregates alone."""
    most = instances.groupBy(bag).agg(F.max(score).alias("_most"))
    w = F.exp(F.col(score) - F.col("_most"))
    return instances.join(most, bag).groupBy(bag).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns])


def witnesses(instances: DataFrame, bag: str, score: str, key: str) -> DataFrame:
    """The highest-scoring instance of each bag, the first by key on ties."""
    best = F.max_by(F.struct(*instances.columns), F.struct(F.col(score), -F.col(key)))
    return instances.groupBy(bag).agg(best.alias("_best")).select("_best.*")


def total_correlation(instances: DataFrame, bag: str, columns: Sequence[str]) -> DataFrame:
    """Total correlation of each bag's columns, taken as jointly normal: half of (sum of log variances - log determinant).

    The determinant is the product of the pivots of the covariances, taken column by column; null where one isn't positive.
    """
    columns, k = list(columns), len(columns)
    if k < 2:
        raise ValueError("two columns or more")
    found = instances.groupBy(bag).agg(*[F.covar_pop(columns[i], columns[j]).alias(f"_c_{i}_{j}") for i in range(k) for j in range(i + 1)])
    variances = sum((F.log(f"_c_{i}_{i}") for i in range(k)), F.lit(0.0))
    for j in range(k):
        below = [F.col(f"_l_{j}_{m}") * F.col(f"_l_{j}_{m}") * F.col(f"_d_{m}") for m in range(j)]
        found = found.withColumn(f"_d_{j}", F.col(f"_c_{j}_{j}") - sum(below, F.lit(0.0)))
        found = found.withColumns({f"_l_{i}_{j}": (F.col(f"_c_{i}_{j}") - sum((F.col(f"_l_{i}_{m}") * F.col(f"_l_{j}_{m}") * F.col(f"_d_{m}") for m in range(j)), F.lit(0.0)))
                                   / F.nullif(f"_d_{j}", F.lit(0.0)) for i in range(j + 1, k)})
    fine = reduce(lambda a, b: a & b, [F.col(f"_d_{j}") > 0 for j in range(k)])
    return found.select(bag, F.when(fine, 0.5 * (variances - sum((F.log(f"_d_{j}") for j in range(k)), F.lit(0.0)))).alias("total_correlation"))


def offsets(sizes: DataFrame, bag: str, size: str) -> DataFrame:
    """Where each bag's instances start and end when bags follow in the order of their ids."""
    from foldwise.operators.resample import range_cuts

    cuts = range_cuts(sizes, bag, sizes.count())
    ranged = sizes.withColumn("_range", place(F.col(bag), F.array(*map(F.lit, cuts)), len(cuts)) if cuts else F.lit(0))
    parts = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    before = parts.select("_range", (F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))
    stop = F.sum(size).over(W.partitionBy("_range").orderBy(bag).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_stop", stop).join(before, "_range").select(
        bag, (F.col("_before") + F.col("_stop") - F.col(size)).alias("start"), (F.col("_before") + F.col("_stop")).alias("stop"))
