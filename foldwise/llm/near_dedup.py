"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A text's set is its distinct shingles of so many words (five unless asked otherwise), A-Z lower-cased; texts with equal sets
are one node. One hash of each shingle fills 192 bins with their minima; an empty bin copies the full one that a fixed random
order of its own names first. Six bins make one of 32 bands, and equal bands share a bucket. In each bucket the member that
meets the most others over all its buckets is the centre, and edges lead from it to the others. Edges whose signatures
agree far too little are dropped, the rest is confirmed on full sets, and connected components follow.

A bucket is done when its members, the centre left out, are of one component. Members of the others are gone through once,
exactly, by prefixes: shingles are put into an order of rising frequency (by a table of fixed size; any order is right), and
two sets with 80 % of their union in common share one of the first shingles, as deep as their sizes ask for, at places that
leave enough behind them. Pairs of different components that do so are confirmed on full sets. That is the end: there are
two passes whatever the data, and rows made are the prefixes' shingles and the pairs that could be links by size and place.

What can be missed: a pair at exactly 80 % shares no band with probability 6e-5 (in mean 4e-4 with the spread of sets of some
hundred shingles), and an edge of a bucket's centre is dropped by its signature at six standard errors below 80 %.

Null and empty texts have an empty set, are linked with nothing, and form components of their own id. Rows with null doc_id
take part like others, and have the smallest id of their component (null if there is none); rows repeated under one id are
nodes by text, and equal rows are one. Ties in popularity or size go by the smaller node. A text of any length is one row
of one task at a time, and so is a single word. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import (
    as_json, byte_classes, connected_components, grams, hashed_words, mixed, stored, text_batches, unwrapped, wrapped,
)

WORDS, BINS, ROWS = 5, 192, 6
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Standard errors below PERCENT at which signatures rule a pair out.
MARGIN = 6
#: Sets that meet one copy of a centre's text; slots of the table of shingle frequencies.
CHUNK, SLOTS = 256, 1 << 20
CLASSES = byte_classes(lower=True)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words has its whole sequence as one."""
    h, _, _, first = hashed_words(data, ends, CLASSES)
    found, out = grams(h, words), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(found[a: b - words + 1]))
        elif b > a:
            out.append(mixed(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


@functools.cache
def _orders() -> np.ndarray:
    """For each bin the rank of every bin in the order by which it looks for one to copy."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the bins, from sorted distinct hashes; empty bins are densified."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    full, out = bins[first], np.zeros(BINS, np.uint64)
    out[full] = hashes[first]
    empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
    out[empty] = out[full[_orders()[np.ix_(empty, full)].argmin(1)]]
    return out


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two longs."""
    digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def key_columns(sets: list[np.ndarray]) -> list[pa.Array]:
    keys = [set_key(s) if len(s) else (None, None) for s in sets]
    return [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]


def sketches(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, key of the set (high, low; null: empty), one byte of each bin and buckets of each row."""
    salt = mixed(np.arange(1, BINS // ROWS + 1, dtype=np.uint64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches):
            sets = shingle_sets(data, ends, words)
            signs = np.array([signature(s) for s in sets if len(s)], np.uint64).reshape(-1, BINS)
            bands = np.zeros((len(signs), BINS // ROWS), np.uint64) + salt
            for i in range(ROWS):
                bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + signs[:, i::ROWS])
            some = iter(signs.astype(np.uint8))
            ends_ = np.concatenate([[0], np.cumsum([len(s) > 0 for s in sets])]).astype(np.int32) * (BINS // ROWS)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *key_columns(sets),
                pa.array([next(some).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends_), pa.array(bands.ravel().view(np.int64)))],
                ["doc_id", "n_shingles", "high", "low", "signature", "buckets"])

    return documents.select("doc_id", "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, high long, low long, signature binary, buckets array<long>")


def with_keys(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with the key of their set as __set_high and __set_low; null without words."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *key_columns(shingle_sets(data, ends, words))], [*batch.schema.names, "__set_high", "__set_low"])

    return documents.mapInArrow(keyed, T.StructType([*documents.schema.fields, T.StructField("__set_high", T.LongType()), T.StructField("__set_low", T.LongType())]))


def node_texts(documents: DataFrame, wanted: DataFrame, words: int, repeated: bool) -> DataFrame:
    """node and text of the wanted nodes (node, high, low, doc_id of one row); repeated: whether that names several equal rows."""
    rows = with_keys(documents.select("doc_id", "text").filter(F.col("text").isNotNull()), words)
    same = (F.col("__set_high") == F.col("high")) & (F.col("__set_low") == F.col("low")) & rows["doc_id"].eqNullSafe(wanted["doc_id"])
    found = rows.join(wanted, same).select("node", "text")
    return found.groupBy("node").agg(F.min("text").alias("text")) if repeated else found


def similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their signatures don't rule out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sign_a", "sign_b"))
            least = batch.column("least").to_numpy()
            error = np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / np.minimum(least, BINS))
            yield batch.select(["a", "b"]).filter(pa.array((one == two).mean(1) >= PERCENT / 100 - MARGIN * error))

    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sign_a"), F.col("n_shingles").alias("n_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sign_b"), F.col("n_shingles").alias("n_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sign_a", "sign_b", F.least("n_a", "n_b").alias("least")).mapInArrow(compare, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose texts' full sets have enough in common; texts: node, text.

    Each text goes to its pair's a, whose own text comes first there, once for so many others: a task holds two sets.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, last = np.zeros(0, np.uint64), None
        for batch, data, ends in text_batches(batches):
            good = []
            for a, chunk, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "b")), shingle_sets(data, ends, words), strict=True):
                if b < 0:
                    centre, last = s, (a, chunk)
                elif (a, chunk) != last:
                    raise RuntimeError("a pair came before the text of its centre")
                low, high = sorted((len(s), len(centre)))
                both = len(np.intersect1d(s, centre, assume_unique=True)) if b >= 0 and 100 * low >= PERCENT * high else 0
                good.append(b >= 0 and 100 * both >= PERCENT * (low + high - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    large = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
    chunked = pairs.join(large, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)), F.lit(0)).alias("chunk"))
    texts = texts.select("node", "text")
    centres = chunked.select("a", "chunk").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(-1).cast("long").alias("b"), "text")
    others = chunked.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "text")
    return centres.union(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").mapInArrow(compare, "a long, b long")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, n_shingles and the bucket's size, of buckets with several members."""
    members = nodes.select(F.explode("buckets").alias("bucket"), "node", "n_shingles")
    sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "bucket-sizes")
    return members.join(sizes, "bucket")


def bucket_centres(shared: DataFrame) -> DataFrame:
    """bucket and centre: the member that meets the most others over all its buckets."""
    popular = shared.groupBy("node").agg(F.sum(F.col("size") - 1).alias("popularity"))
    best = F.max(F.struct("popularity", (-F.col("node")).alias("back"), F.col("n_shingles").alias("n_centre")))
    return shared.select("bucket", "node", "n_shingles").join(popular, "node").groupBy("bucket").agg(best.alias("best")).select(
        "bucket", (-F.col("best.back")).alias("centre"), "best.n_centre")


def stars(shared: DataFrame, centres: DataFrame) -> DataFrame:
    """Edges (a, b) from each bucket's centre to its others, where sizes allow a link."""
    low, high = F.least("n_shingles", "n_centre"), F.greatest("n_shingles", "n_centre")
    return shared.join(centres, "bucket").filter((F.col("node") != F.col("centre")) & (100 * low >= PERCENT * high)).select(
        F.col("centre").alias("a"), F.col("node").alias("b")).distinct()


def left_over(shared: DataFrame, centres: DataFrame, component: DataFrame) -> DataFrame:
    """node and component of the members of buckets where, the centre left out, components differ."""
    others = shared.select("bucket", "node").join(centres, "bucket").filter(F.col("node") != F.col("centre"))
    known = others.join(component, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    spanning = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    return known.join(stored(spanning, "spanning"), "bucket").select("node", "component").distinct()


def frequencies(texts: DataFrame, words: int) -> np.ndarray:
    """How many sets have a shingle of each slot; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for _, data, ends in text_batches(batches):
            for s in shingle_sets(data, ends, words):
                np.add.at(total, (s % np.uint64(SLOTS)).astype(np.int64), 1)
        slot = np.flatnonzero(total)
        for i in range(0, len(slot), 10_000):
            at = slot[i: i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    found = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, words: int, counts: np.ndarray) -> DataFrame:
    """node, component, n, shingle, place and first of the shingles by which sets can meet, rare ones first.

    A set meets larger ones by its ``first`` shingles, and smaller ones by all that are given. A shingle that is alone in
    its slot is in no other set.
    """
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in text_batches(batches):
            parts, sizes = [], []
            for s in shingle_sets(data, ends, words):
                often = sent.value[(s % np.uint64(SLOTS)).astype(np.int64)]
                order, n = np.lexsort((s, often)), len(s)
                order = order[: n - -(-PERCENT * n // 100) + 1]
                place = np.flatnonzero(often[order] > 1)
                parts.append((np.full(len(place), n), s[order[place]].view(np.int64), place, place <= n - -(-2 * PERCENT * n // (100 + PERCENT))))
                sizes.append(len(place))
            n, shingle, place, first = (np.concatenate(p) for p in zip(*parts, strict=True))
            row = pa.array(np.repeat(np.arange(len(batch)), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(row), batch.column("component").take(row), pa.array(n.astype(np.int64)), pa.array(shingle), pa.array(place.astype(np.int64)), pa.array(first)],
                ["node", "component", "n", "shingle", "place", "first"])

    return texts.select("node", "component", "text").mapInArrow(cut, "node long, component long, n long, shingle long, place long, first boolean")


def prefix_pairs(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can be links by the sizes of their sets and the place of a common shingle."""
    # sizes of linked sets are at most one class apart
    kind = F.floor(F.log("n") / F.log(F.lit(104 / PERCENT))).cast("long")
    one = found.filter("first").select("shingle", kind.alias("kind"), F.col("node").alias("a"), F.col("component").alias("component_a"), F.col("n").alias("n_a"), (F.col("n") - F.col("place")).alias("rest_a"))
    two = found.select("shingle", F.explode(F.array(kind, kind - 1)).alias("kind"), F.col("node").alias("b"), F.col("component").alias("component_b"), F.col("n").alias("n_b"), (F.col("n") - F.col("place")).alias("rest_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    enough = (100 + PERCENT) * F.least("rest_a", "rest_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    near = (F.col("component_a") != F.col("component_b")) & smaller & (100 * F.col("n_a") >= PERCENT * F.col("n_b")) & enough
    return one.join(two, (one["shingle"] == two["shingle"]) & (one["kind"] == two["kind"]) & near).select("a", "b").distinct()


def classes(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, key of the set (high, low) and class of each row; key and class are null for rows without words."""
    rows = stored(sketches(documents, words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    found = rows.filter("high is not null")
    keys = stored(found.groupBy("high", "low").agg(F.min("row").alias("node")), "keys")
    nodes = stored(found.join(keys.select("node"), F.col("row") == F.col("node")).drop("row"), "nodes")
    repeated = found.groupBy("high", "low", "doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0

    shared = stored(shared_buckets(nodes), "shared-buckets")
    centres = stored(bucket_centres(shared), "centres")
    pairs = stored(similar(stored(stars(shared, centres), "stars"), nodes), "candidates")
    wanted = nodes.select("node", "high", "low", "doc_id").join(shared.select("node").distinct(), "node", "left_semi")
    texts = stored(node_texts(documents, wanted, words, repeated), "texts")
    component = connected_components(stored(confirmed(pairs, texts, words), "links"))

    rest = stored(left_over(shared, centres, component), "left-over")
    rest_texts = stored(texts.join(rest, "node"), "left-over-texts")
    if not rest_texts.isEmpty():
        met = stored(prefix_pairs(prefixes(rest_texts, words, frequencies(rest_texts, words))), "prefix-pairs")
        late = stored(confirmed(met, texts, words), "late-links")
        if not late.isEmpty():
            component = connected_components(late.union(component.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = keys.join(component, "node", "left").select("high", "low", F.coalesce("component", "node").alias("class"))
    return rows.join(named, ["high", "low"], "left").select("doc_id", "n_shingles", "high", "low", "class")


def near_components(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    named = stored(classes(documents, words), "classes")
    least = stored(named.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id")), "least-ids")
    return named.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each class, of the smallest id (null after all others), then the least key, text and other columns (as JSON);
    rows without words all stay. Other columns may have any names and types."""
    named = classes(documents, words).filter("class is not null")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "high", "low")
    least = named.groupBy("class").agg(F.min(one).alias("one"))
    # rows that have the least id and key of their class: where there are several, one of them is chosen by its columns
    same = named.groupBy("class", one.alias("one")).agg(F.count("*").alias("rows"))
    kept = stored(same.join(least, ["class", "one"]).select("one.doc_id", "one.high", "one.low", "rows"), "kept")
    rows = with_keys(wrapped(documents), words)

    def chosen(some: DataFrame, how: str) -> DataFrame:
        # ids are keys of the join as well, so that copies of one text are spread
        at = (rows["__set_high"] == some["high"]) & (rows["__set_low"] == some["low"]) & rows["doc_id"].eqNullSafe(some["doc_id"])
        return rows.join(some, at, how).select(rows["doc_id"], "text", "document", "__set_high", "__set_low", "rows")

    parts = ("doc_id", "text", "document")
    # texts are gone through once, and once more only where equal rows are repeated
    whole = chosen(kept.filter("rows = 1"), "left").filter("__set_high is null or rows is not null").select(*parts)
    repeated = kept.filter("rows > 1")
    if not repeated.isEmpty():
        several = chosen(repeated, "inner").groupBy("__set_high", "__set_low").agg(
            F.min_by(F.struct(*parts), F.struct("text", as_json(F.col("document")))).alias("row")).select("row.*")
        whole = whole.unionByName(several)
    return whole.select(*unwrapped(documents.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
