"""Embedding whitening by shifted Cholesky QR.

A component c becomes the integer floor(64 c) + 1000000, so that counts and sums are exact, and a row is centred as
(n x - S) / n: an exact integer, divided once. Passes over the rows then sum Gram matrices: each is factored by Cholesky
(with a shift where it isn't surely positive), and the next pass sees the rows after triangular solves with all factors so
far, until the Gram matrix is a projector, which is the identity where no dimension depends on others. The product R of the
factors has the rows' singular values, so its SVD gives the components, without the squared condition of a covariance.

Only d x d numbers for each factor and d sums are on the driver and in tasks (d: the vectors' dimension); tasks' Gram
matrices are added by a shuffle on (row, column), not on the driver.

Vectors that are null, empty or hold null or non-finite entries are left out. Vectors of different dimension, and entries of
2^40 or more in size, are errors. Components that the data don't have (one row, constant or dependent dimensions) can't be
whitened and are left out, so one distinct vector gives no rows. Repeated rows count as often as they occur and null ids are
ids like others; ties of eigenvalues are in LAPACK's order. A deviation that no long can hold is null. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import stored

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this size have no exact integer here.
LARGEST = float(1 << 40)
#: Rows that one step of a task takes; passes after which an unsettled Gram matrix is taken as it is.
ROWS, PASSES = 4096, 12
#: Distance from a projector at which a Gram matrix counts as settled.
SETTLED = 1e-13
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """What is fitted: rows, sums of the integers, triangular factors, and the components (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    factors: list[np.ndarray]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def finite(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v: the vectors that count, as doubles."""
    v = F.col(column)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter(fine).select("vec_id", v.cast("array<double>").alias("v"))


def integers(flat: pa.Array, d: int) -> np.ndarray:
    values = flat.to_numpy(zero_copy_only=False)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError("entries of 2^40 or more in size have no exact integers here")
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, d) + OFFSET


def deviations(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their rows' n x - S, exact: as int64, or as Python's integers where those don't suffice."""
    d, total = len(sums), np.array(sums, object)
    small = n * (SCALE * LARGEST + OFFSET) < 2.0**62
    for whole in batches:
        for i in range(0, len(whole), ROWS):
            batch = whole.slice(i, ROWS)
            x = integers(batch.column("v").flatten(), d)
            if small or n * int(np.abs(x).max()) < 1 << 62:
                yield batch, n * x - total.astype(np.int64)
            else:
                yield batch, n * x.astype(object) - total


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q with Q @ factor = rows; factor is upper triangular."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def summed(rows: DataFrame, n: int, sums: list[int], width: int, made) -> np.ndarray:
    """Over all rows the sum of made(centred rows), a matrix of ``width`` columns; tasks' sums meet in a shuffle by place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, d in deviations(batches, n, sums):
            part = made((d / n).astype(float))
            total = part if total is None else total + part
        if total is not None:
            at = pa.array(np.arange(total.size, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([at, pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(width * width)
    # at most width * width rows come to the driver
    for r in rows.mapInArrow(task, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(width, width)


def through(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for factor in factors:
        rows = solved(rows, factor)
    return rows


def cholesky(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular factor of the matrix, shifted on the first pass and wherever it isn't positive."""
    d, size = len(gram), np.linalg.norm(gram, 2)
    # the bound for n rows, but no more than keeps small singular values apart from it; larger only where that doesn't do
    least = min(11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2, 1e-8) * size
    for shift in ([] if first else [0.0]) + [least * 100.0**i for i in range(6)]:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("the Gram matrix isn't finite")


def fitted(rows: DataFrame, passes: int = PASSES) -> Fit | None:
    """Counts, sums, factors and components; rows: v, vectors of one dimension (None without any)."""
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    n, d = shape["n"], shape["most"]
    if not n:
        return None
    if shape["least"] != d:
        raise ValueError(f"vectors of dimensions {shape['least']} to {d}")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                total = total + integers(batch.column("v").slice(i, ROWS).flatten(), d).sum(0, dtype=object)
        at = pa.array(np.arange(d, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([at, pa.array([str(t) for t in total])], ["at", "s"])

    parts = rows.select("v").mapInArrow(sums_of, "at long, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_place = {r["at"]: int(r["s"]) for r in parts.collect()}
    sums = [by_place[i] for i in range(d)]
    factors: list[np.ndarray] = []
    gram = summed(rows.select("v"), n, sums, d, lambda c: c.T @ c)
    trace, zero = float(np.trace(gram)) / n, not gram.any()
    r = np.eye(d)
    while not zero and len(factors) < passes:
        if factors and np.abs(gram @ gram - gram).max() < SETTLED * max(1, d / 64):
            break
        factors.append(cholesky(gram, n, not factors))
        r = factors[-1] @ r
        gram = summed(rows.select("v"), n, sums, d, lambda c, known=tuple(factors): (q := through(c, list(known))).T @ q)
    # what is left of the Gram matrix (the identity, or a projector) goes into R: rows' = r' gram r
    values, basis = np.linalg.eigh((gram + gram.T) / 2)
    _, sigma, right = np.linalg.svd((np.sqrt(np.clip(values, 0, None))[:, None] * basis.T) @ r)
    real = sigma > sigma[0] * d * np.finfo(float).eps if sigma[0] > 0 else np.zeros(d, bool)
    vectors = right[real].T
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Fit(n, sums, factors, vectors, sigma[real] ** 2 / n, trace)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding", fit: Fit | None = None) -> DataFrame:
    """A row for each vector and component, by falling eigenvalue. ``fit``: an earlier fit, applied instead of a new one."""
    rows = stored(finite(embeddings, column), "vectors")
    fit = fit or fitted(rows)
    if fit is None or not fit.values.size:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    k = min(components, fit.values.size)
    turn = fit.vectors[:, :k] / np.sqrt(fit.values[:k])
    n, sums = fit.n, fit.sums
    # whitened rows are centred by their own means before their products are summed
    means = np.diag(summed(rows.select("v"), n, sums, k, lambda c: np.diag((c @ turn).sum(0)))) / n
    spread = summed(rows.select("v"), n, sums, k, lambda c: (w := c @ turn - means).T @ w) / n
    error = float(np.abs(spread - np.eye(k)).max())
    explained = fit.values[:k] / fit.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, d in deviations(batches, n, sums):
            m = len(batch)
            if d.dtype != object and len(sums) * float(np.abs(d).max()) ** 2 < 2.0**62:
                deviation = pa.array((d * d).sum(1))
            else:
                exact = (d.astype(object) ** 2).sum(1)
                deviation = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 deviation.take(each), pa.array(((d / n).astype(float) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(project, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
