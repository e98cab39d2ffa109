"""Mixing sources to target weights by blocks, multinomial draws and index permutations.

The words of each source are laid end to end and cut into blocks of a fixed number of words. Every output shard draws
how many of its slots each source gets (multinomial, seeded by the shard); what the draws together miss of a source's
number of blocks is moved from sources that drew too many. A source's k-th slot takes the block at place k of a
pseudorandom permutation of its blocks, and starts over after the last; blocks and documents are joined by index. No block
is taken more than twice, as no target is above twice its source's size.

Documents are laid out by a hash bucket and then by id, so that a source of any size is summed in many tasks; the buckets'
totals give each bucket its place. The driver gets one row for each source. Null texts have no words and are taken 0
times; null sources are a source of their own, the last. Identical rows each have a place of their own. Other columns
are not read. An empty table gives an empty result. Reruns give the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.llm.common import WORD_PATTERN, as_json, mixed, named, stored, unwrapped, wrapped

#: Words of a block, slots of an output shard, documents of a source and shards in a bucket of the running totals.
BLOCK, SLOTS, BUCKET = 64, 1024, 512
#: Slots that one task lays out.
TASK_SLOTS = 1 << 18
#: A word with the white space after it, the first one also with that before it.
SPACED = "(?:^[\\x20\\x09-\\x0D]+)?" + WORD_PATTERN + "[\\x20\\x09-\\x0D]*"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: ``share`` of all words by weight, none above ``most`` times its size, the excess reshared."""
    given = [w for w, _ in zip(cycle(weights), sizes)]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(given[i] for i in open_)
        full = [i for i in sorted(open_) if left * given[i] / total > most * sizes[i]]
        for i in full or sorted(open_):
            out[i] = most * sizes[i] if full else left * given[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def running_total(frame: DataFrame, group: str, bucket: str, order: list[str], value: str, name: str, levels: int = 2) -> DataFrame:
    """The sum of ``value`` over the rows before each row of its group, by bucket and then by order, as a column.

    Rows are summed within their bucket, buckets within wider ones and so on: with two levels below it, the window over a
    whole group has a row for so many of its rows as BUCKET to the power of three.
    """
    whole = frame.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
    if levels:
        wide = whole.withColumn("_wide", F.floor(F.col(bucket) / BUCKET))
        before = running_total(wide, group, "_wide", [bucket], "_total", "_earlier", levels - 1).select(group, bucket, F.col("_earlier").alias("_before"))
    else:
        before = whole.select(group, bucket, (F.sum("_total").over(W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")).alias("_before"))
    inner = F.sum(value).over(W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return frame.withColumn("_inner", inner).join(before, [group, bucket]).withColumn(name, F.col("_inner") + F.col("_before")).drop("_inner", "_before")


def permuted(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place k of a permutation of 0..n-1 that the seed names: a Feistel network, walked until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mixed(right * np.uint64(0x9E3779B97F4A7C15) + s + np.uint64(turn * 0x51ED27)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


class Plan:
    """What each source has and gives: sizes, targets, its numbers of blocks and of slots (arrays by source number)."""

    def __init__(self, sizes: list[int], block: int):
        self.sizes = np.array(sizes, np.int64)
        self.targets = np.array(targets(sizes))
        self.blocks = -(-self.sizes // block)
        self.slots = np.where(self.sizes > 0, np.round(self.targets * self.blocks / np.maximum(self.sizes, 1)), 0).astype(np.int64)


def other_columns(documents: DataFrame) -> Column:
    """A hash of all columns but the text."""
    return F.xxhash64(as_json(*[named(c) for c in documents.columns if c != "text"]))


def laid_out(documents: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Plan, DataFrame]:
    """Rows with source_no, size and start (words of the source before them), the plan, and the sources' table; tie and other
    (hashes of the text, and of all other columns) tell rows under one id apart, so that a row's place is its own."""
    spark = documents.sparkSession
    sized = stored(documents.select(
        "doc_id", "source", F.xxhash64("text").alias("tie"), other_columns(documents).alias("other"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = Plan([r["source_size"] for r in found], block)
    sources = spark.createDataFrame(pa.table({
        "source": pa.array([r["source"] for r in found], pa.string()), "source_no": pa.array(range(len(found)), pa.int32()),
        "source_size": pa.array(plan.sizes), "target": pa.array(plan.targets), "buckets": pa.array([1 + r["n"] // BUCKET for r in found], pa.int64())}))
    known = sized.join(sources.select(F.col("source").alias("s"), "source_no", "buckets"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bucketed = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.col("buckets"))).drop("buckets")
    placed = running_total(bucketed, "source_no", "bucket", ["doc_id", "tie", "other"], "size", "start")
    return stored(placed, "laid-out"), plan, sources


def drawn_slots(spark: SparkSession, plan: Plan, seed: int = 7, slots: int = SLOTS) -> DataFrame:
    """The mix: shard, source_no, block and turn (how often the block came before) of every slot."""
    total = int(plan.slots.sum())
    schema = "shard long, source_no int, n long"
    share = plan.slots / max(1, total)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, n = [], [], []
            for i in batch.column("id").to_pylist():
                counts = np.random.default_rng([seed, i]).multinomial(min(slots, total - i * slots), share)
                some = np.flatnonzero(counts)
                shard.append(np.full(len(some), i))
                source.append(some)
                n.append(counts[some])
            if shard:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard), pa.int64()), pa.array(np.concatenate(source), pa.int32()), pa.array(np.concatenate(n), pa.int64())], ["shard", "source_no", "n"])

    shards = -(-total // slots)
    counts = stored(spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4, -(-shards // 16)))).mapInArrow(draw, schema), "draws")
    got = np.zeros(len(plan.slots), np.int64)
    for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        got[r["source_no"]] = r["n"]
    excess, lack = np.maximum(0, got - plan.slots), np.maximum(0, plan.slots - got)
    excess_from, lack_to = np.cumsum(excess) - excess, np.cumsum(lack)
    first = running_total(counts.withColumn("bucket", F.floor(F.col("shard") / BUCKET)), "source_no", "bucket", ["shard"], "n", "first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                batch = whole.slice(i, 2000)
                n = batch.column("n").to_numpy()
                source = np.repeat(batch.column("source_no").to_numpy().astype(np.int64), n)
                ends = np.cumsum(n)
                k = np.arange(ends[-1]) - np.repeat(ends - n - batch.column("first").to_numpy(), n)
                over = np.flatnonzero(k >= plan.slots[source])
                spare = excess_from[source[over]] + k[over] - plan.slots[source[over]]
                source[over] = np.searchsorted(lack_to, spare, "right")
                k[over] = got[source[over]] + spare - (lack_to - lack)[source[over]]
                size = plan.blocks[source]
                block = permuted(k % size, size, mixed((source + 1).astype(np.uint64) * np.uint64(seed)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("shard").to_numpy(), n)), pa.array(source.astype(np.int32)), pa.array(block), pa.array((k // size).astype(np.int32))],
                    ["shard", "source_no", "block", "turn"])

    # by slots, as these rows are few and small: merged by their own size they would be one task's
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))
    return first.select("shard", "source_no", "n", "first").repartition(tasks, "shard").mapInArrow(place, "shard long, source_no int, block long, turn int")


def document_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every block that a document reaches into: its words there, from ``lo`` to ``hi`` of the document."""
    at = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    lo, hi = F.col("block") * block - F.col("start"), (F.col("block") + 1) * block - F.col("start")
    return placed.filter("size > 0").select("source_no", "start", "doc_id", "tie", "other", "size", at.alias("block")).select(
        "source_no", "block", "start", "doc_id", "tie", "other", F.greatest(lo, F.lit(0)).alias("lo"), F.least(hi, "size").alias("hi"))


def mix(documents: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row."""
    placed, plan, sources = laid_out(documents, block)
    times = drawn_slots(documents.sparkSession, plan, seed).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # the slots come from a small table of counts, by whose size they would be broadcast
    times = times.hint("merge")
    taken = document_blocks(placed, block).join(times, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("words"))
    rows = placed.join(sources.drop("source", "buckets"), "source_no").join(taken, ["source_no", "start"], "left")
    return rows.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mix as documents: a row for each document and turn with the words taken of it in that turn.

    White space stays as it is in the document: a word brings what follows it, and the first also what precedes it. The other
    columns, of any names and types, are the document's; n_chars, where there is one, is that of the new text. Rows under one
    id that differ in any column are mixed each for itself; rows equal in all columns count once for each of their copies.
    """
    placed, plan, _ = laid_out(documents, block)
    slots = drawn_slots(documents.sparkSession, plan, seed)
    row = ["doc_id", "tie", "other"]
    parts = document_blocks(placed, block).join(slots.hint("merge"), ["source_no", "block"]).groupBy("source_no", "start", *row, "turn").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
    takes = parts.groupBy(*row).agg(F.collect_list("parts").alias("takes")).withColumnsRenamed({c: f"of_{c}" for c in row})
    texts = wrapped(documents).withColumn("tie", F.xxhash64("text"))
    texts = texts.withColumn("other", F.xxhash64(as_json(*[F.col("document").getField(c).alias(c) for c in documents.columns if c != "text"])))
    if placed.groupBy(*row).count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(row)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in row]
    found = texts.join(takes, same[0] & same[1] & same[2])
    words = F.regexp_extract_all("text", F.lit(SPACED), F.lit(0))
    # below the explode, so that a text is cut into words once and not for each of its takes and parts
    found = found.select("document", "takes", words.alias("words")).select("document", "words", F.explode("takes").alias("take"))
    text = F.array_join(F.flatten(F.transform("take", lambda p: F.slice(F.col("words"), (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), "")
    out = found.select("document", text.alias("text"))
    changed = {"n_chars": F.length("text").cast(dict(documents.dtypes)["n_chars"])} if "n_chars" in documents.columns else {}
    return out.select(*unwrapped(documents.columns, **changed))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
