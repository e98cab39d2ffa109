"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of other characters than these six.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a Spark that runs in one process (as
    in tests) takes a folder of its own, and any other refuses."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="foldwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later jobs start there, whatever executor is lost."""
    path = new_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def wrapped(documents: DataFrame) -> DataFrame:
    """doc_id, text and document: all columns but text in one, so that columns of any name and type clash with nothing."""
    return documents.select("doc_id", "text", F.struct(*[named(c) for c in documents.columns if c != "text"]).alias("document"))


def unwrapped(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of the documents again, but for those that are changed."""
    every = {"text": F.col("text"), **changed}
    return [every[c].alias(c) if c in every else F.col("document").getField(c).alias(c) for c in columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def as_json(*columns: Column) -> Column:
    """Columns of any types as text, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(labels: DataFrame, documents: DataFrame, target: str, rows: int) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out fifth, chosen by a hash of doc_id.

    Repeated labels of one document count as their maximum; null labels and ids are left out. The chosen ids are
    broadcast: ``rows`` bounds their size. Where ids repeat there are more rows, of which the classifiers take one for each id.
    """
    chosen = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star steps: each node's neighbours are re-linked to its smallest one until only
    stars are left. Minima are partial aggregates and the joins are ordinary shuffle joins, which adaptive execution
    splits for a hot node; each round is written to the shared folder, so that lineage stays short.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = stored(links, "links"), None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct())
        seen = tuple(mark)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct()
        links = stored(small, "links")


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``most`` bytes of text (one row at least) with their UTF-8 bytes and row offsets; null counts as empty."""
    for batch in batches:
        texts = batch.column("text")
        if texts.null_count:
            texts = texts.fill_null("")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None and ends[-1] > 0 else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[ends[i]: ends[j]], ends[i: j + 1] - ends[i]
            i = j


ODD, GOLD = 0x9E3779B97F4A7C15 | 1, np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        size = max(1 << 21, n)
        for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_classes(lower: bool = False, letters: bool = False) -> np.ndarray:
    """What each byte counts as in a word; 0 ends words. ``letters``: other ASCII than letters and digits ends words too."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 1
    if lower:
        table[65:91] += 32
    if letters:
        table[[i for i in range(128) if not chr(i).isalnum()]] = 0
    else:
        table[[ord(c) for c in SPACES]] = 0
    return table


def hashed_words(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: 64-bit hashes of all words, their byte starts and ends, and each row's first word number (rows + 1)."""
    kinds = table[data]
    inside = np.empty(len(data) + 2, np.bool_)
    inside[0] = inside[-1] = False
    np.not_equal(kinds, 0, out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(kinds * up[: len(data)], dtype=np.uint64, out=total[1:])
    h = mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * GOLD)
    return h, start, stop, np.searchsorted(start, ends, "left")


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each word; the last k - 1 places of the slice are left out."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j: j + n]
    return mixed(out)
