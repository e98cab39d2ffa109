"""Support vector machines in the primal, linear or by random waves in place of a kernel, and their multi-instance form.

Equal rows are counted together once a fit, and their partitions are as many as the different rows need. Where one does, its task
goes through all steps. Else a step adds up slopes and second derivatives of each partition by numpy, (features + 2)^2 / 2 numbers.
The driver gets these, or, where they are many, tasks add up those of several partitions and it gets a row for each of the square root of their number.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators import bags as bg
from foldwise.sources.store import stored

#: Parts of a step of which one is taken, the whole step first.
PARTS = 0.5 ** np.arange(20)
#: Half widths of the round corner that stands in for the hinge's kink: a first fit goes through all, later ones take the last.
CORNERS = (1.0, 0.3, 0.1)
#: Features, after waves, that a fit may have.
MOST_COLUMNS = 1_024
#: Rows that a partition of a fit, or of witnesses, holds.
ROWS = 20_000
#: Numbers that a step's partitions send to the driver at most; of more, tasks add up those of several partitions.
SENT = 1_000_000


@dataclass(frozen=True)
class Waves:
    """Features as they are (without turns), or cosines and sines of random projections.

    The products of two rows' waves come near exp(-gamma |x - y|^2), the closer the more projections there are.
    """

    turns: np.ndarray | None = None

    @staticmethod
    def drawn(width: int, gamma: float, projections: int, seed: int) -> Waves:
        return Waves(np.random.default_rng(seed).normal(size=(projections, width)) * math.sqrt(2 * gamma))

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.turns is None:
            return x
        angles = x @ self.turns.T
        return np.hstack([np.cos(angles), np.sin(angles)]) / math.sqrt(len(self.turns))

    def columns(self, width: int) -> int:
        return width if self.turns is None else 2 * len(self.turns)


@dataclass(frozen=True)
class MarginModel:
    """Weights of waves: the intercept first. Margins of 0 and more are the positive class."""

    features: tuple[str, ...]
    waves: Waves
    weights: np.ndarray

    @property
    def intercept(self) -> float:
        return float(self.weights[0])

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.weights[1:])

    def margin(self, x: Column) -> Column:
        """The margin of an array of features. Equal rows have equal margins, whatever batch they come in: by 12 decimals."""
        waves, weights = self.waves, self.weights
        if waves.turns is None:
            terms = F.zip_with(x, F.lit(weights[1:].tolist()), lambda a, b: a * b)
            return F.round(F.aggregate(terms, F.lit(float(weights[0])), lambda a, b: a + b), 12)

        @F.pandas_udf("double")
        def margins(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="float64")
            return pd.Series(waves.of(np.stack(values.to_numpy())) @ weights[1:] + weights[0])

        return F.round(margins(x), 12)

    def scored(self, frame: DataFrame, score: str = "score") -> DataFrame:
        return frame.withColumn(score, self.margin(numbers(frame, self.features)))

    def bags(self, instances: DataFrame, bag: str) -> DataFrame:
        """A row for each bag: its highest margin and the label that goes with it."""
        scores = self.scored(instances).groupBy(bag).agg(F.max("score").alias("score"))
        return scores.withColumn("label", (F.col("score") >= 0).cast("int"))

    def to_json(self) -> str:
        turns = None if self.waves.turns is None else self.waves.turns.tolist()
        return json.dumps({"features": list(self.features), "turns": turns, "weights": self.weights.tolist()})

    @staticmethod
    def from_json(text: str) -> MarginModel:
        kept = json.loads(text)
        turns = None if kept["turns"] is None else np.array(kept["turns"])
        return MarginModel(tuple(kept["features"]), Waves(turns), np.array(kept["weights"]))


def numbers(frame: DataFrame, features: Sequence[str]) -> Column:
    """The features as one array: of number columns, or a single column that is a vector or an array already. A missing one is an error."""
    kinds = dict(frame.dtypes)
    if len(features) == 1 and kinds[features[0]] in ("vector", "array<double>"):
        only = F.col(features[0])
        array = vector_to_array(only) if kinds[features[0]] == "vector" else only
    else:
        array = F.array(*[F.col(c).cast("double") for c in features])
    sound = array.isNotNull() & ~F.exists(array, lambda v: v.isNull() | F.isnan(v))
    return F.when(sound, array).otherwise(F.raise_error(F.lit("a feature is missing in a row")).cast("array<double>"))


def corner(margins: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and bend of rows by label times margin: a hinge whose kink is a parabola between 1 - half and 1 + half."""
    short = 1 + half - margins
    inside = (short >= 0) & (short <= 2 * half)
    loss = np.where(short <= 0, 0.0, np.where(inside, short * short / (4 * half), 1 - margins))
    slope = np.where(short <= 0, 0.0, np.where(inside, -short / (2 * half), -1.0))
    return loss, slope, inside / (2 * half)


def partitions(n: int) -> int:
    """How many partitions hold ``n`` rows."""
    return -(-n // ROWS) or 1


def counted_rows(rows: DataFrame) -> DataFrame:
    """Different rows of _x and _y with _w, how many there are of each (or the sum of their _w)."""
    weight = F.sum("_w") if "_w" in rows.columns else F.count("*")
    return rows.groupBy("_x", "_y").agg(weight.cast("double").alias("_w"))


def added_up(batches):
    """One row, the sum of all rows of numbers."""
    total = None
    for batch in batches:
        if batch.num_rows:
            sums = batch.column("_sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(0)
            total = sums if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_pydict({"_sums": pa.array([total], pa.list_(pa.float64()))})


def blocks_of(batches, waves: Waves):
    """Of each batch of rows of _x, _y and _w: a column of ones and the features after waves, signs and weights."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = np.where(batch.column("_y").to_numpy(zero_copy_only=False) > 0, 1.0, -1.0)
            yield np.hstack([np.ones((len(x), 1)), waves.of(x)]), y, batch.column("_w").to_numpy(zero_copy_only=False)


def block_sums(blocks, at: np.ndarray, move: np.ndarray, half: float) -> np.ndarray:
    """Over blocks: losses at each part of the way from ``at`` by ``move``, and slopes and bends (their lower half) at its end, in one array."""
    k = len(at)
    low = np.tril_indices(k)
    total = np.zeros(len(PARTS) + k + len(low[0]))
    for full, y, w in blocks:
        here, further = y * (full @ at), y * (full @ move)
        losses = [w @ corner(here + part * further, half)[0] for part in PARTS]
        _, slope, bend = corner(here + further, half)
        bends = (full * (w * bend)[:, None]).T @ full
        total += np.concatenate([losses, full.T @ (w * slope * y), bends[low]])
    return total


def step_sums(rows: DataFrame, parts: int, made: Callable, size: int) -> np.ndarray:
    """One Spark job over rows of _x, _y and _w in ``parts`` partitions: the sum of what ``made`` gives for each one's batches, an array of ``size``."""

    def of_partition(batches):
        yield pa.RecordBatch.from_pydict({"_sums": pa.array([made(batches)], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(of_partition, "_sums array<double>")
    if parts * size > SENT:
        fewer = math.isqrt(parts - 1) + 1
        sums = sums.select("_sums", (F.spark_partition_id() % fewer).alias("_to")).repartition(fewer, "_to").select("_sums").mapInArrow(added_up, "_sums array<double>")
    return sum(batch.column("_sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(0) for batch in sums.toArrow().to_batches() if batch.num_rows)


def fit_margin(rows: DataFrame, waves: Waves, width: int, penalty: float = 1.0, start: np.ndarray | None = None, steps: int = 50, close: float = 1e-8) -> np.ndarray:
    """Weights, the intercept first, that minimise half their squares (not the intercept's) plus ``penalty`` times the summed loss.

    ``rows`` have _x, _y and, if they count more than once, _w.
    Newton's steps: each gives the losses along the step before as well, so that a step which goes too far is cut to its best part and
    costs one step more. From ``start``, the weights of a fit of nearly the same rows, few are needed. Where the different rows
    fill one partition at most, its task goes through all steps; else each step is one Spark job.
    """
    k = waves.columns(width) + 1
    if k - 1 > MOST_COLUMNS:
        raise ValueError(f"at most {MOST_COLUMNS} features after waves, not {k - 1}")
    counted = counted_rows(rows)
    parts = partitions(counted.count())
    if parts == 1:

        def whole(batches):
            blocks = list(blocks_of(batches, waves))
            return newton(lambda *step: block_sums(blocks, *step), k, penalty, start, steps, close)

        return step_sums(counted.coalesce(1), 1, whole, k)
    # a partition is one block, which its steps find where it was made
    spread, size = counted.repartition(parts).persist(), len(PARTS) + k + k * (k + 1) // 2
    try:
        return newton(lambda *step: step_sums(spread, parts, lambda batches: block_sums(blocks_of(batches, waves), *step), size), k, penalty, start, steps, close)
    finally:
        spread.unpersist()


def newton(sums: Callable, k: int, penalty: float, start: np.ndarray | None, steps: int, close: float) -> np.ndarray:
    """The steps of fit_margin; ``sums`` gives block_sums over all rows."""
    at = np.zeros(k) if start is None else start.copy()
    ridge, low = np.diag([1e-10] + [1.0] * (k - 1)), np.tril_indices(k)
    for half in CORNERS if start is None else CORNERS[-1:]:
        move, known, again = np.zeros(k), math.inf, False
        for _ in range(steps):
            losses, slopes, lower = np.split(sums(at, move, half), [len(PARTS), len(PARTS) + k])
            ways = at[None, :] + PARTS[:, None] * move[None, :]
            values = penalty * losses + 0.5 * (ways[:, 1:] ** 2).sum(1)
            best = int(values.argmin()) if move.any() else 0
            if not again and values[best] >= known - 1e-12 * abs(known):
                break
            at, known, again = ways[best], float(values[best]), best > 0
            if again:
                # slopes are those of the whole step's end
                move = np.zeros(k)
                continue
            bends = np.zeros((k, k))
            bends[low] = lower
            bends += np.tril(bends, -1).T
            move = np.linalg.solve(penalty * bends + ridge, -(penalty * slopes + ridge @ at))
            if np.abs(move).max() <= close * max(1.0, np.abs(at).max()):
                break
    return at


def mi_svm(
    train: DataFrame, bag: str, key: str, features: Sequence[str], target: str, max_iterations: int = 50, params: Mapping | None = None,
) -> tuple[MarginModel, int, str]:
    """Multi-instance SVM: fit on all negative instances and one witness of each positive bag, choose witnesses anew.

    The first fit takes positive bags' means, every later one starts from the weights before. Returns the model, its rounds and
    how they ended: at a "fixed point" (the same witnesses as in the round before), in a "cycle" (as in an earlier one), or at the
    "limit", where the last witnesses are fitted once more. Ties of witnesses go to the smaller key.

    ``params``: C (1), kernel ("linear" or "rbf"), gamma ("scale": 1 / (features x variance of all entries), or a number), projections
    (64, each a cosine and a sine) and seed (0) of the waves that stand in for the kernel.
    """
    params = dict(params or {})
    unknown = set(params) - {"C", "kernel", "gamma", "projections", "seed"}
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    if max_iterations < 1:
        raise ValueError("one round at least")
    features, kernel = tuple(features), params.get("kernel", "linear")
    rows = train.select(bag, key, numbers(train, features).alias("_x"), F.col(target).alias("_y")).persist()
    facts = rows.agg(
        F.count_if(F.col("_y") == 1).alias("positive"), F.count_if(F.col("_y") == 0).alias("negative"), F.count("*").alias("n"), F.max(F.size("_x")).alias("width"),
        F.sum(F.aggregate("_x", F.lit(0.0), lambda a, b: a + b)).alias("s"), F.sum(F.aggregate("_x", F.lit(0.0), lambda a, b: a + b * b)).alias("q")).first()
    if not facts["positive"] or not facts["negative"] or facts["positive"] + facts["negative"] < facts["n"]:
        rows.unpersist()
        raise ValueError("positive and negative bags are needed, with targets 1 and 0")
    width, waves = facts["width"], Waves()
    if kernel == "rbf":
        entries = facts["n"] * width
        variance = facts["q"] / entries - (facts["s"] / entries) ** 2
        gamma = params.get("gamma", "scale")
        gamma = 1.0 / (width * variance) if gamma == "scale" and variance > 0 else 1.0 if gamma == "scale" else float(gamma)
        waves = Waves.drawn(width, gamma, int(params.get("projections", 64)), int(params.get("seed", 0)))
    elif kernel != "linear":
        rows.unpersist()
        raise ValueError(f"kernel {kernel} is neither linear nor rbf")
    negative, positive = stored(counted_rows(rows.filter("_y = 0").select("_x", "_y")), "negative-rows"), rows.filter("_y = 1")
    n_bags = positive.select(bag).distinct().count()
    means = positive.groupBy(bag).agg(F.array(*[F.avg(F.col("_x")[i]) for i in range(width)]).alias("_x"))
    chosen = means.select("_x", F.lit(1).alias("_y"), F.lit(1.0).alias("_w"))
    penalty, weights, seen, rounds, ended, last, best = float(params.get("C", 1.0)), None, [], 0, "limit", None, None
    for rounds in range(1, max_iterations + 1):
        weights = fit_margin(negative.unionByName(chosen), waves, width, penalty, weights)
        scored = positive.withColumn("_score", MarginModel(features, waves, weights).margin(F.col("_x")))
        last, best = best, bg.witnesses(scored, bag, "_score", key).coalesce(partitions(n_bags)).persist()
        mark = tuple(best.agg(F.count("*"), F.sum(F.xxhash64(bag, key).cast("decimal(38,0)"))).first())
        if last is not None:
            last.unpersist()
        if mark in seen:
            ended = "fixed point" if mark == seen[-1] else "cycle"
            break
        seen.append(mark)
        chosen = best.select("_x", F.lit(1).alias("_y"), F.lit(1.0).alias("_w"))
    if ended == "limit":
        weights = fit_margin(negative.unionByName(chosen), waves, width, penalty, weights)
    for frame in (rows, best):
        frame.unpersist()
    return MarginModel(features, waves, weights), rounds, ended
