"""Splits as tables of assignments: resample_id, key, role and, for draws with replacement, multiplicity.

The order of a shuffled split is that of an MD5 of seed and key; so rows are placed by ranges of the MD5's first digits and
numbered within them, and no window runs over a whole table. The order of an unshuffled split is that of the key, of any type
that can be ordered, placed by ranges between keys of a sample. The number of ranges grows with the rows. Rows with a null key are rows
like others: first in an unshuffled order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.functions.columns import place, same, shuffle_key

#: Rows that a range holds in the mean; most ranges; sampled keys for each range.
ROWS, MOST, SAMPLED = 1_000_000, 4096, 16


def range_cuts(frame: DataFrame, key: str, n: int, rows: int = ROWS) -> list:
    """Ascending keys that cut the order into ranges of about ``rows`` of the n rows: from a sample that is bounded by MOST x SAMPLED keys."""
    ranges = min(MOST, -(-n // rows))
    if ranges <= 1:
        return []
    sample = frame.select(F.col(key).alias("_key")).filter("_key is not null").orderBy(F.xxhash64("_key"), "_key").limit(ranges * SAMPLED).sort("_key").collect()
    return list(dict.fromkeys(sample[len(sample) * i // ranges][0] for i in range(1, ranges)))


def ranked(frame: DataFrame, key: str, seed: str | int | None = None, within: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """The frame with ``position`` (from 0) and ``n_rows`` in the order of the split, within each group of ``within``."""
    within, n = list(within), frame.count()
    if seed is not None:
        digits = max(1, math.ceil(math.log(max(1, n / rows), 16)))
        order = F.coalesce(shuffle_key(F.col(key), seed), F.md5(F.lit(f"{seed}:")))
        ranged = frame.withColumn("_range", F.substring(order, 1, digits))
    else:
        cuts = range_cuts(frame, key, n, rows)
        above = place(F.col(key), F.array(*map(F.lit, cuts)), len(cuts)) if cuts else F.lit(0)
        order, ranged = F.col(key), frame.withColumn("_range", above)
    groups = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    counts = ranged.groupBy(*within, "_range").agg(F.count("*").alias("_count"))
    places = counts.select(
        *[F.col(c).alias(f"_{c}") for c in within], F.col("_range").alias("_place"),
        (F.sum("_count").over(groups.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_count")).alias("_before"),
        F.sum("_count").over(groups).alias("n_rows"))
    on = (F.col("_range") == F.col("_place")) & same(within, "_")
    number = F.row_number().over(W.partitionBy(*within, "_range").orderBy("_order", key)) - 1
    # sort keys are made where rows have arrived, so that they aren't sent
    return ranged.repartition(*within, "_range").withColumn("_order", order).withColumn("_number", number).join(places, on).withColumn("position", F.col("_before") + F.col("_number")).drop(
        "_order", "_range", "_number", "_place", "_before", *[f"_{c}" for c in within])


def block(position: Column, n_rows: Column, k: int) -> Column:
    """Number of the block of k contiguous ones; the first n mod k hold one row more."""
    small, more = F.floor(n_rows / k), n_rows % k
    return F.when(position < more * (small + 1), F.floor(position / (small + 1))).otherwise(
        more + F.floor((position - more * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")


def holdout(frame: DataFrame, key: str, test_size: float, seed: int | None = None, repeat: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """One split; the last rows of the order are the test rows."""
    share_of(test_size)
    rows = ranked(frame, key, None if seed is None else f"{seed}:{repeat}" if repeat else seed, within)
    tests = F.ceil(F.lit(test_size) * F.col("n_rows"))
    return rows.select(F.lit(f"repeat_{repeat:02d}").alias("resample_id"), key, F.when(F.col("position") >= F.col("n_rows") - tests, "test").otherwise("train").alias("role"))


def class_quotas(frame: DataFrame, label: str, size: float, by: Sequence[str] = ()) -> DataFrame:
    """In each group of ``by``, how many rows of each class make ceil(size * n) rows, by largest remainders; ties go to the smaller class."""
    counts = frame.groupBy(*by, label).agg(F.count("*").alias("n_class"))
    total = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    exact = counts.withColumn("_n", F.sum("n_class").over(total)).withColumn("_want", F.ceil(F.lit(size) * F.col("_n"))).withColumn(
        "_exact", F.col("n_class") * F.col("_want") / F.col("_n"))
    floors = exact.withColumn("_floor", F.floor("_exact"))
    rank = F.row_number().over(total.orderBy((F.col("_floor") - F.col("_exact")), label))
    return floors.withColumn("_left", F.col("_want") - F.sum("_floor").over(total)).withColumn("_rank", rank).select(
        *by, F.col(label).alias("_label"), (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quota"))


def stratified_holdout(frame: DataFrame, key: str, label: str, test_size: float, seed: int, repeat: int = 0) -> DataFrame:
    """One split with the classes in proportion."""
    share_of(test_size)
    rows = ranked(frame, key, f"{seed}:{repeat}" if repeat else seed, [label])
    quotas = class_quotas(frame, label, test_size)
    return rows.join(quotas, F.col(label).eqNullSafe(F.col("_label"))).select(
        F.lit(f"repeat_{repeat:02d}").alias("resample_id"), key, F.when(F.col("position") >= F.col("n_rows") - F.col("quota"), "test").otherwise("train").alias("role"))


def fold_roles(folds: DataFrame, key: str, k: int, *others: str) -> DataFrame:
    """Every row's role in every fold, from the fold in which it is tested; ``others``: further columns to keep."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_f")
    return folds.select(key, "fold", *others, fold).select(
        F.format_string("fold_%02d", "_f").alias("resample_id"), key, *others, F.when(F.col("fold") == F.col("_f"), "test").otherwise("train").alias("role"))


def folds_of(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 2:
        raise ValueError(f"folds are two or more, not {k}")
    return k


def share_of(size: float) -> float:
    if not isinstance(size, (int, float)) or isinstance(size, bool) or not 0 < size < 1:
        raise ValueError(f"a part of the rows is more than 0 and less than 1, not {size}")
    return float(size)


def kfold(frame: DataFrame, key: str, k: int, seed: int | None = None, *others: str) -> DataFrame:
    """key and the fold that tests it: contiguous blocks of the order; ``others``: further columns to keep."""
    folds_of(k)
    return ranked(frame.select(key, *others), key, seed).select(key, *others, block(F.col("position"), F.col("n_rows"), k).alias("fold"))


def stratified_kfold(frame: DataFrame, key: str, label: str, k: int, seed: int | None = None) -> DataFrame:
    """key and fold; each fold gets of a class what a deal of the rows sorted by class would give it."""
    folds_of(k)
    counts = frame.groupBy(label).agg(F.count("*").alias("_n")).select(
        F.col(label).alias("_label"), "_n", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy(label).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_from"))
    quotas = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "_quota", F.floor((F.col("_from") + F.col("_n") - 1 - F.col("fold")) / k) - F.floor((F.col("_from") - 1 - F.col("fold")) / k))
    last = F.sum("_quota").over(W.partitionBy("_label").orderBy("fold").rowsBetween(W.unboundedPreceding, 0))
    ranges = quotas.withColumn("_to", last).groupBy("_label").agg(F.sort_array(F.collect_list("_to")).alias("_ends"))
    return ranked(frame, key, seed, [label]).join(ranges, F.col(label).eqNullSafe(F.col("_label"))).select(
        key, F.size(F.filter("_ends", lambda e: e <= F.col("position"))).alias("fold"))


def group_kfold(frame: DataFrame, key: str, groups: Sequence[str], k: int) -> DataFrame:
    """key and fold with whole groups in folds, the largest group to the lightest fold.

    Groups of one size are alike for the balance, so the driver deals sizes (few) and not groups: it counts how many
    groups of each size a fold gets, and groups of a size follow in the order of their names.
    """
    groups, k = list(groups), folds_of(k)
    name = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    named = frame.select(key, name.alias("_group"))
    sizes = named.groupBy("_group").agg(F.count("*").alias("_size"))
    loads, rows = [0] * k, []
    for size, n in sorted((tuple(r) for r in sizes.groupBy("_size").count().collect()), reverse=True):
        got, left = [0] * k, n
        while left:
            low = min(loads)
            light = [i for i in range(k) if loads[i] == low]
            higher = [x for x in loads if x > low]
            even = min(max(1, (min(higher) - low) // size) if higher else left, left // len(light))
            for i in light if even else light[:left]:
                got[i] += even or 1
                loads[i] += (even or 1) * size
            left -= even * len(light) if even else left
        ends = [sum(got[: i + 1]) for i in range(k)]
        rows.append((size, ends))
    if not rows:
        return named.select(key, F.lit(0).alias("fold"))
    table = frame.sparkSession.createDataFrame(rows, "_s long, _ends array<long>")
    placed = ranked(sizes, "_group", "groups", ["_size"]).join(table, F.col("_size") == F.col("_s")).select(
        F.col("_group").alias("_g"), F.size(F.filter("_ends", lambda e: e <= F.col("position"))).alias("fold"))
    return named.join(placed, F.col("_group") == F.col("_g")).select(key, "fold")


def _redrawn(n: int, start: str) -> str:
    """What a sample of few rows hashes with its places, so that a row is left out."""
    if n == 1:
        raise ValueError("a bootstrap of one row leaves none out")
    turn, text = 0, start
    while n and len({int(hashlib.md5(f"{text}:{i}".encode()).hexdigest()[:15], 16) % n for i in range(n)}) == n:
        turn += 1
        text = f"{start}:again-{turn}"
    return text


def bootstrap(frame: DataFrame, key: str, samples: int, seed: int) -> DataFrame:
    """n draws with replacement for each sample (train, with multiplicity); rows never drawn are the test rows.

    A sample that leaves no row out is drawn again. Of over 32 rows that never comes up (32! / 32^32 is 2e-13).
    """
    from foldwise.sources.store import stored

    placed = stored(ranked(frame.select(key), key).select(key, "position", "n_rows"), "places")
    start = F.concat_ws(":", F.lit(str(seed)), F.col("sample"))
    n = frame.limit(33).count()
    for s in range(samples if n <= 32 else 0):
        again = _redrawn(n, f"{seed}:{s}")
        start = F.when(F.col("sample") == s, again).otherwise(start)
    ids = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    # the j-th draw is made where row j is: n draws for n rows, wherever they lie
    number = F.conv(F.substring(F.md5(F.concat_ws(":", start, F.col("position"))), 1, 15), 16, 10).cast("long")
    draws = placed.select("position", "n_rows", ids).select("sample", (number % F.col("n_rows")).alias("position")).groupBy("sample", "position").agg(F.count("*").alias("multiplicity"))
    every = placed.select(key, "position", ids)
    return every.join(draws, ["sample", "position"], "left").select(
        F.format_string("sample_%02d", "sample").alias("resample_id"), key,
        F.when(F.col("multiplicity").isNull(), "test").otherwise("train").alias("role"), F.coalesce("multiplicity", F.lit(1)).alias("multiplicity"))


def with_validation(assignment: DataFrame, key: str, valid_size: float, seed: int, label: str | None = None) -> DataFrame:
    """Carve the last rows of each resample's train rows into a validation role; by classes in proportion where the
    assignment carries a label."""
    share_of(valid_size)
    train = assignment.filter("role = 'train'")
    if label is None:
        rows = ranked(train.select("resample_id", key), key, seed, ["resample_id"]).withColumn("quota", F.ceil(F.lit(valid_size) * F.col("n_rows")))
    else:
        quotas = class_quotas(train, label, valid_size, ["resample_id"])
        rows = ranked(train, key, seed, ["resample_id", label]).join(quotas.withColumnRenamed("resample_id", "_r"), (F.col("resample_id") == F.col("_r")) & F.col(label).eqNullSafe(F.col("_label")))
    cut = rows.select("resample_id", key, F.when(F.col("position") >= F.col("n_rows") - F.col("quota"), "valid").otherwise("train").alias("role"))
    return cut.unionByName(assignment.filter("role <> 'train'").select("resample_id", key, "role"))


def with_group_validation(assignment: DataFrame, key: str, group: str, valid_size: float, seed: int) -> DataFrame:
    """As with_validation, by whole groups; the assignment carries the group column."""
    share_of(valid_size)
    train = assignment.filter("role = 'train'")
    groups = ranked(train.select("resample_id", group).distinct(), group, seed, ["resample_id"])
    valid = groups.filter(F.col("position") < F.ceil(F.lit(valid_size) * F.col("n_rows"))).select("resample_id", group, F.lit(True).alias("_valid"))
    return train.join(valid.select("resample_id", F.col(group).alias("_group"), "_valid").withColumnRenamed("resample_id", "_resample_id"),
                      same(["resample_id"], "_") & F.col(group).eqNullSafe(F.col("_group")), "left").drop("_resample_id", "_group").withColumn("role", F.when(F.col("_valid"), "valid").otherwise("train")).drop("_valid").unionByName(
        assignment.filter("role <> 'train'"))


def split_rows(frame: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """Each resample's rows with their role; rows drawn several times come several times."""
    joined = assignment.join(frame, key)
    if "multiplicity" in assignment.columns:
        joined = joined.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("multiplicity").cast("int")))).drop("_draw")
    return joined
