"""Substring dedup by super-k-mers.

Each window of 35 words has a minimiser, the least hash of its runs of 8 words. Consecutive windows with one minimiser
form a super-k-mer. A minimiser of one text only, where it comes but once, can have no repeated window; the others' super-
k-mers travel to the minimiser's bucket, each as one packed string with a weight that counts equal ones, and a bucket's
windows are sorted and counted as they are. Words covered by a window that starts anywhere else go.

Texts with equal words are one text with several copies: all their windows are repeated, and one of them stands for them in
the buckets. Buckets of very many different strings, as around a passage that a large part of all documents shares, are
not gathered in a task: their windows are counted by an ordinary aggregation of 128-bit digests, and a digest's places are
dealt out by a salt. Texts and strings are told apart by 128 bits. Windows of over a kilobyte are compared by their SHA-256.

Null and empty texts have no words, and texts under 35 words no windows: nothing of them is removed. Repeated rows count as
copies, and rows with null or repeated doc_id take part like others. Other columns than doc_id and text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import byte_classes, grams, hashed_words, stored, text_batches

WINDOW, SEED = 35, 8
#: Windows of a super-k-mer at most, and different strings of a bucket that a task gathers; more are counted by aggregation.
MOST_WINDOWS, MOST_STRINGS = 256, 1_000
#: Parts that the places of a window in large buckets are dealt to, and bytes of a window that is compared as it is.
SALTS, LONG_WINDOW = 64, 1024
KEY = ["content", "content2"]
CLASSES = byte_classes()


def minimisers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Super-k-mers of a slice of texts: row, first word in the row, number of windows, minimiser and how often it comes there; and words of each row."""
    h, _, _, first = hashed_words(data, ends, CLASSES)
    seeds = least = grams(h, SEED)
    size, want = 1, WINDOW - SEED + 1
    while size < want and len(least):
        step = min(size, want - size)
        least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
        size += step
    words = np.diff(first)
    windows = np.maximum(0, words - WINDOW + 1)
    row = np.repeat(np.arange(len(words)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    value = least[at + first[:-1][row]]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(row)))
    span = length + want - 1
    before = np.cumsum(span) - span
    spots = np.arange(span.sum()) + np.repeat(at[start] + first[:-1][row[start]] - before, span)
    times = np.add.reduceat(seeds[spots] == np.repeat(value[start], span), before, dtype=np.int64) if len(start) else length
    return row[start], at[start], length, value[start].view(np.int64), times, words


def content_key(words: bytes) -> tuple[str, int, int]:
    digest = hashlib.sha256(words)
    return digest.hexdigest(), *struct.unpack("<qq", digest.digest()[:16])


def content_keys(data: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Digest of the words and its first two 64-bit numbers, of each row of a slice."""
    keys = [content_key(b" ".join(data[a:b].tobytes().split())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(value))


def profiles(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, digest of the words, content key, distinct minimisers, and those that the text has several times."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches):
            row, _, _, value, times, words = minimisers(data, ends)
            order = np.lexsort([value, row])
            r, v, several = row[order], value[order], times[order] > 1
            same = np.zeros(len(r), bool)
            same[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
            again = same | several
            own = np.unique(np.stack([r[again], v[again]]), axis=1) if again.any() else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(words.astype(np.int64)), *content_keys(data, ends),
                _lists(r[~same], v[~same], len(batch)), _lists(own[0], own[1], len(batch))],
                ["doc_id", "n_words", "sha", *KEY, "seeds", "own"])

    return documents.select("doc_id", "text").mapInArrow(profile, "doc_id long, n_words long, sha string, content long, content2 long, seeds array<long>, own array<long>")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, content key and text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *content_keys(data, ends)[1:], batch.column("text")], ["doc_id", *KEY, "text"])

    return documents.select("doc_id", "text").mapInArrow(keys, "doc_id long, content long, content2 long, text string")


def super_kmers(texts: DataFrame) -> DataFrame:
    """Packed strings of the marked minimisers: seed, string key, content key, first word, packed; texts: content key, seeds, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches, 1 << 18):
            row, at, length, value, _, _ = minimisers(data, ends)
            contents, others, seeds = (batch.column(c).to_pylist() for c in (*KEY, "seeds"))
            cuts, rows = np.searchsorted(row, np.arange(len(batch) + 1)), []
            for i in range(len(batch)):
                marked = set(seeds[i])
                words = data[ends[i]: ends[i + 1]].tobytes().split()
                for j in range(cuts[i], cuts[i + 1]):
                    seed = int(value[j])
                    if seed in marked:
                        for lo in range(int(at[j]), int(at[j] + length[j]), MOST_WINDOWS):
                            packed = b" ".join(words[lo: min(lo + MOST_WINDOWS, int(at[j] + length[j])) + WINDOW - 1])
                            rows.append((seed, xxhash.xxh3_128_digest(packed), contents[i], others[i], lo, packed))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)],
                    ["seed", "string", *KEY, "at", "packed"])

    return texts.mapInArrow(cut, "seed long, string binary, content long, content2 long, at int, packed binary")


def windows_of(packed: bytes) -> list[bytes]:
    """The windows of a string; long ones as their digests, which are shorter than any window."""
    words = packed.split(b" ")
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    spans = ((starts[i], starts[i + WINDOW] - 1) for i in range(len(words) - WINDOW + 1))
    return [packed[a:b] if b - a <= LONG_WINDOW else hashlib.sha256(memoryview(packed)[a:b]).digest() for a, b in spans]


def repeated_windows(strings: DataFrame) -> DataFrame:
    """Numbers of the repeated windows of each string; strings: seed, string, packed, n, in buckets of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("seed", "string", "packed", "n")), strict=True)

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["seed", "string", "windows"])

        out = []
        for seed, bucket in groupby(rows(), key=lambda r: r[0]):
            spots = sorted((w, string, i, n) for _, string, packed, n in bucket for i, w in enumerate(windows_of(packed)))
            repeated: dict[bytes, list[int]] = {}
            for _, same in groupby(spots, key=lambda s: s[0]):
                same = list(same)
                if len(same) > 1 or same[0][3] > 1:
                    for _, string, i, _ in same:
                        repeated.setdefault(string, []).append(i)
            out += [(seed, string, windows) for string, windows in repeated.items()]
            if len(out) > 5_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return strings.repartition("seed").sortWithinPartitions("seed").mapInArrow(count, "seed long, string binary, windows array<int>")


def repeated_in_large(strings: DataFrame) -> DataFrame:
    """As repeated_windows, for buckets of any size: windows become digests that an aggregation counts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 1000):
                batch = whole.slice(k, 1000)
                rows = [(seed, string, i, xxhash.xxh3_128_digest(w), n) for seed, string, packed, n in zip(*(batch.column(c).to_pylist() for c in ("seed", "string", "packed", "n")), strict=True)
                        for i, w in enumerate(windows_of(packed))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()), strict=True)],
                                                 ["seed", "string", "window", "digest", "n"])

    spots = strings.mapInArrow(spread, "seed long, string binary, window int, digest binary, n long").withColumn("salt", F.pmod(F.hash("string"), F.lit(SALTS)))
    # the places of a common window travel by digest and salt; by digest alone there is a row for each salt
    parts = spots.groupBy("digest", "salt").agg(F.sum("n").alias("n"))
    often = parts.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest")
    marked = spots.join(parts.join(often, "digest").select("digest", "salt"), ["digest", "salt"])
    return marked.groupBy("seed", "string").agg(F.collect_list("window").alias("windows"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    rows = stored(profiles(documents), "profiles")
    contents = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    seeds = rows.select(F.explode("seeds").alias("seed"), *KEY)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in KEY for f in (F.min, F.max)]
    shared = seeds.groupBy("seed").agg(*ends).filter(" or ".join(f"min_{c} < max_{c}" for c in KEY)).select("seed")
    marked = seeds.join(shared, "seed").select(*KEY, "seed").union(rows.select(*KEY, F.explode("own").alias("seed")))
    flags = marked.groupBy(*KEY).agg(F.collect_set("seed").alias("seeds")).join(contents, KEY)

    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count():
        # an id doesn't name a text here: texts are found by id and content key, equal rows once
        own, known = keyed(documents).dropDuplicates(["doc_id", *KEY]).alias("own"), flags.alias("known")
        same = [F.col("own.doc_id").eqNullSafe(F.col("known.doc_id")), *[F.col(f"own.{c}") == F.col(f"known.{c}") for c in KEY]]
        texts = own.join(known, same).select(*[f"known.{c}" for c in KEY], "seeds", "copies", "text")
    else:
        texts = documents.select("doc_id", "text").join(flags, "doc_id").select(*KEY, "seeds", "copies", "text")
    texts = stored(texts, "marked-texts")
    spots = stored(super_kmers(texts.select(*KEY, "seeds", "text")), "super-kmers")
    strings = stored(spots.groupBy("seed", "string").agg(F.any_value("packed").alias("packed"), F.count("*").alias("n")), "strings")
    large = strings.groupBy("seed").agg(F.count("*").alias("strings")).filter(F.col("strings") > MOST_STRINGS).select("seed")
    found = repeated_windows(strings.join(large, "seed", "left_anti")).union(repeated_in_large(strings.join(large, "seed", "left_semi")))
    starts = spots.select("seed", "string", *KEY, "at").join(found, ["seed", "string"]).groupBy(*KEY).agg(
        F.flatten(F.collect_list(F.transform("windows", lambda w: w + F.col("at")))).alias("starts"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches):
            removed, shas = [], []
            for i, starts in enumerate(batch.column("starts").to_pylist()):
                words = data[ends[i]: ends[i + 1]].tobytes().split()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, np.array(starts) + WINDOW, -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone, strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], [*KEY, "removed", "kept"])

    cleaned = texts.filter("copies = 1").select(*KEY, "text").join(starts, KEY).mapInArrow(keep, "content long, content2 long, removed long, kept string")
    out = rows.select("doc_id", "n_words", "sha", *KEY).join(contents.select(*KEY, "copies"), KEY).join(cleaned, KEY, "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return out.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
