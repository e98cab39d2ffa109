"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, pairs of neighbours and pairs with one word between, hashed; each counts once. Spark
hashes the labelled texts in parallel; one task takes passes of FTRL-proximal over a sample of them that is bounded in rows
and in features, in an order by hash, with a rate for each coordinate and L1 sparsity. The few weights that aren't zero are what is sent
to executors: at most 2^bits of them, whatever the size of the corpus.

Null and empty texts have no features and score by the bias alone. Every row is scored by itself, so repeated rows and
ids repeat their result; other columns than doc_id and text are not read. Without labelled rows every score is 0. An
empty table gives an empty result. Of several rows under one labelled id one is learned from, that with the least features.
A text of any length is one row of one task at a time. Ties in the order by hash go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.llm.common import byte_classes, hashed_words, held_out, labelled_sample, mixed, text_batches, unwrapped, wrapped

#: The most labelled documents that are learned from, in one task.
SAMPLE_ROWS = 16_000
#: The most features that these have together; the sample ends before, in the order of its hash.
SAMPLE_FEATURES = 1 << 25
BITS, PASSES = 20, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 16.0, 0.1
LIMIT = 0.5
CLASSES = byte_classes(lower=True, letters=True)


def text_features(data: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a slice of texts and the row of each; a feature may come several times in a row."""
    h, _, _, first = hashed_words(data, ends, CLASSES)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts, rows = [mixed(h)], [row]
    for gap in (1, 2):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            parts.append(mixed(h[:-gap] * np.uint64(0x9FB21C651E98DF25) + h[gap:] + np.uint64(gap))[same])
            rows.append(row[gap:][same])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def ftrl(texts: list[np.ndarray], labels: np.ndarray, bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias after some passes over the rows' distinct features."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    rows = [np.append(x, bias) for x in texts]
    l1 = np.full((1 << bits) + 1, L1)
    l1[bias] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1[at], 0.0, -(zs - np.sign(zs) * l1[at]) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(passes):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange((1 << bits) + 1))
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def fitted(labels: DataFrame, documents: DataFrame, target: str = "toxic", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted coordinates, their weights, the bias."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches):
            found, row = text_features(data, ends)
            pairs = np.unique((row << BITS) + found)
            cuts = np.searchsorted(pairs >> BITS, np.arange(len(ends))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, lists = [], [], []
        for batch in batches:
            ids.append(batch.column("doc_id").to_numpy())
            marks.append(batch.column("label").to_numpy())
            flat, cuts = batch.column("features").flatten().to_numpy(), batch.column("features").offsets.to_numpy()
            lists += np.split(flat.copy(), (cuts - cuts[0])[1:-1]) if len(batch) else []
        if lists:
            order = np.lexsort([np.concatenate(ids), mixed(np.concatenate(ids).astype(np.uint64))])
            at, w, bias = ftrl([lists[i] for i in order], np.concatenate(marks).astype(float)[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(bias, w))], ["at", "weight"])

    sample = labelled_sample(labels, documents, target, rows).mapInArrow(hashed, "doc_id long, label int, features array<int>")
    one = sample.groupBy("doc_id", "label").agg(F.min("features").alias("features"))
    upto = F.sum(F.size("features")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    found = one.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_FEATURES).drop("upto").mapInArrow(learn, "at long, weight double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("weight").to_numpy()
    return (at[1:], w[1:], float(w[0])) if len(at) else (np.zeros(0, np.int64), np.zeros(0), -40.0)


def scored(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep=None) -> DataFrame:
    """doc_id and score of each row; with ``keep`` a score below it keeps the row, with its own columns only."""
    at, w, bias = model
    sent = documents.sparkSession.sparkContext.broadcast((at.astype(np.int64), w, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        known = np.full(1 << BITS, -1, np.int32)
        known[at] = np.arange(len(at))
        for batch, data, ends in text_batches(batches):
            found, row = text_features(data, ends)
            spot = known[found]
            hit = spot >= 0
            pairs = np.unique(row[hit] * (len(at) + 1) + spot[hit])
            total = np.bincount(pairs // (len(at) + 1), w[pairs % (len(at) + 1)] if len(at) else None, minlength=len(batch)) + bias
            p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            if keep is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])
            else:
                yield batch.filter(pa.array(p < keep))

    if keep is None:
        return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    rows = wrapped(documents)
    return rows.mapInArrow(score, rows.schema).select(*unwrapped(documents.columns))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(documents, fitted(labels, documents)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
