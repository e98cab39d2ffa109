"""Embedding near-dedup by a forest of random-projection trees.

Trees are fitted on a bounded sample: each node projects on a random direction and splits at the median, and vectors near
the median go to both sides. Every vector is sent down every tree; in each leaf the vectors of one label are all compared,
by their cosines in double precision. A vector carries the leaves that it reaches, so that a pair counts in the first leaf
that both are in and nowhere else: a leaf gives each vector's number of links and the first vector that it reaches by
them, not pairs, so that rows grow with the vectors. Sums over the leaves and components follow.

No task holds more than two blocks of vectors of a leaf: leaves with more are split on by Spark, at quantiles of their own
projections, and where their vectors lie so close together that a split would part linked ones every block meets every
other one in a task of their own.

Equal vectors of one label are one node that counts its copies, so copies are never paired with each other. Vectors that
are null, of length zero, or hold null or non-finite components, and vectors without label, are linked with nothing and
form components of their own id. Vectors of different dimension are never compared. Rows repeated under one id count as
further vectors. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import connected_components, stored

COSINE = 0.93
#: Trees; the sample that they are fitted on; vectors of a leaf at which splitting ends; share of vectors that go to both sides.
TREES, SAMPLE_ROWS, LEAF, SPILL = 6, 20_000, 2048, 0.1
#: Cosine with their mean from which vectors count as close together.
CLOSE = 0.9
#: Vectors of a leaf and label that one task compares; directions by which larger leaves are measured; rounds of their splits.
GROUP, DIRECTIONS, ROUNDS = 8192, 8, 40
#: Vectors whose cosines are computed at once.
BLOCK = 512


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def split(x: np.ndarray, direction: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, float, float]:
    """Projections, and the bounds above which vectors go right and below which they go left."""
    p = x @ direction
    low, high = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
    return p, float(low), float(high)


class Tree:
    """Directions and bounds of a complete binary tree, level by level."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.directions = rng.normal(size=((1 << depth) - 1, sample.shape[1])).astype(np.float32)
        self.bounds = np.zeros(((1 << depth) - 1, 2))
        rows = [np.arange(len(sample))]
        for i in range(len(self.directions)):
            at = rows[i]
            p, low, high = split(sample[at], self.directions[i]) if len(at) else (np.zeros(0), 0.0, 0.0)
            self.bounds[i] = low, high
            rows += [at[p <= high], at[p >= low]]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves that they reach; a row can reach several."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            p = np.einsum("ij,ij->i", x[row], self.directions[at])
            left, right = p <= self.bounds[at, 1], p >= self.bounds[at, 0]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


class Leaves:
    """The leaves of a group's vectors that come before its own, as rows of numbers."""

    def __init__(self, owner: np.ndarray, ids: np.ndarray, leaf: int):
        before = np.flatnonzero(ids < leaf)
        before = before[np.argsort(owner[before], kind="stable")]
        self.owner, self.ids = owner[before], ids[before]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which vectors of two runs of rows have one of them in common."""
        parts = [slice(*np.searchsorted(self.owner, [rows[0], rows[-1] + 1])) for rows in (a, b)]
        both = np.intersect1d(*(self.ids[p] for p in parts))
        marks = []
        for rows, p in zip((a, b), parts, strict=True):
            at, known = np.zeros((len(rows), len(both)), np.float32), np.isin(self.ids[p], both)
            at[self.owner[p][known] - rows[0], np.searchsorted(both, self.ids[p][known])] = 1
            marks.append(at)
        return marks[0] @ marks[1].T > 0


def met(x: np.ndarray, copies: np.ndarray, leaves: Leaves, first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a group the copies linked to it of which no leaf before has the pair, and the first vector that
    it reaches by the group's links. Vectors before number ``first`` meet those from there on; 0: all meet all."""
    n = len(x)
    links, root = np.zeros(n), np.arange(n)
    blocks = [np.arange(i, min(i + BLOCK, stop)) for start, stop in ((0, first), (first, n)) for i in range(start, stop, BLOCK)]
    for a in blocks:
        for b in blocks:
            if b[0] < a[0] or (first and not a[0] < first <= b[0]):
                continue
            near = x[a] @ x[b].T >= least
            if a[0] == b[0]:
                np.fill_diagonal(near, False)
            some = np.flatnonzero(near.any(1))
            if not len(some):
                continue
            fresh = near & ~leaves.shared(a, b)
            links[a] += fresh @ copies[b]
            if a[0] != b[0]:
                links[b] += copies[a] @ fresh
            for i in some:
                ends = np.unique(np.append(root[b[near[i]]], root[a[i]]))
                if len(ends) > 1:
                    root[np.isin(root, ends[1:])] = ends[0]
    return links, root


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def forest(nodes: DataFrame, dimension: int, trees: int) -> list[Tree]:
    """Trees as deep as the number of nodes asks for and the sample allows."""
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("vector").toArrow()
    x = unit(matrix(sample.column("vector").combine_chunks()))
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / LEAF)))), int(np.log2(max(1, len(x) / 16)))))
    return [Tree(x, depth, seed) for seed in range(trees)]


def placed_in(nodes: DataFrame, trees: list[Tree]) -> DataFrame:
    """label, key, vector and the leaves (of all trees) that each node reaches."""
    sent = nodes.sparkSession.sparkContext.broadcast(trees)
    kinds = dict(nodes.dtypes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 2000):
                batch = whole.slice(k, 2000)
                x = unit(matrix(batch.column("vector"))).astype(np.float32)
                found = [(row, (i << 32) + leaf) for i, (row, leaf) in enumerate(t.leaves(x) for t in sent.value)]
                row, leaf = (np.concatenate(part) for part in zip(*found, strict=True))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(batch) + 1)).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf[order]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "key", "copies", "vector")), leaves], ["label", "key", "copies", "vector", "leaves"])

    return nodes.select("label", "key", "copies", "vector").mapInArrow(route, f"label {kinds['label']}, key long, copies long, vector {kinds['vector']}, leaves array<long>")


def projected(rows: DataFrame) -> DataFrame:
    """The rows with their vectors' projections on the random directions that their leaf names."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 2000):
                batch = whole.slice(k, 2000)
                x, leaf = unit(matrix(batch.column("vector"))), batch.column("leaf").to_numpy()
                p = np.zeros((len(batch), DIRECTIONS))
                for one in np.unique(leaf):
                    p[leaf == one] = x[leaf == one] @ np.random.default_rng(int(one) & ((1 << 63) - 1)).normal(size=(x.shape[1], DIRECTIONS))
                ends = np.arange(len(batch) + 1, dtype=np.int32) * DIRECTIONS
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()))], [*batch.schema.names, "p"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(project, f"{kinds}, p array<double>")


def whole_leaf() -> list:
    """Columns of a leaf that is one group."""
    return [F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side")]


def large_leaves(rows: DataFrame, group: int) -> DataFrame:
    return rows.groupBy("label", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > group)


def divided(rows: DataFrame, group: int) -> DataFrame:
    """Rows of leaves over ``group`` vectors, as label, leaf, one, two, side, key and vector: groups of bounded size.

    Random splits with spill go on until leaves are small enough or close together; a close leaf's rows get a block by
    hash, and block ``one`` meets block ``two`` in a group of their own. Sizes and quantiles are aggregates.
    """
    out: list[DataFrame] = []
    rows = stored(rows, "large-leaves")
    for turn in range(ROUNDS + 1):
        # the sum of variances over random directions of unit vectors tells their mean's length
        spread = sum((F.var_pop(F.get("p", F.lit(i))) for i in range(DIRECTIONS)), F.lit(0.0)) / DIRECTIONS
        measured = stored(projected(rows), "projected")
        shape = measured.groupBy("label", "leaf").agg(
            F.count("*").alias("n"), spread.alias("spread"),
            F.percentile_approx(F.get("p", F.lit(0)), [0.5 - SPILL / 2, 0.5 + SPILL / 2], 1000).alias("cuts"))
        close = (F.col("spread") <= 1 - CLOSE**2) | (F.get("cuts", F.lit(0)) == F.get("cuts", F.lit(1))) | F.lit(turn == ROUNDS)
        shaped = measured.join(stored(shape.withColumn("close", close), "shapes"), ["label", "leaf"])
        blocks = F.ceil(F.col("n") / (group // 2)).cast("int")
        block = F.pmod(F.xxhash64("key", F.lit(1)), blocks).cast("int")
        met = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
        out.append(shaped.filter("close").select("label", "leaf", "key", "copies", "vector", block.alias("block"), met).select(
            "label", "leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
            (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "copies", "vector"))
        p = F.get("p", F.lit(0))
        sides = F.array_compact(F.array(*[F.when(there, F.xxhash64("leaf", F.lit(i))) for i, there in enumerate((
            p <= F.get("cuts", F.lit(1)), p >= F.get("cuts", F.lit(0))))]))
        rows = stored(shaped.filter(~F.col("close")).select("label", F.explode(sides).alias("leaf"), "key", "copies", "vector"), "split-leaves")
        large = stored(large_leaves(rows, group), "large")
        out.append(rows.join(large, ["label", "leaf"], "left_anti").select("label", "leaf", *whole_leaf(), "key", "copies", "vector"))
        rows = rows.join(large.drop("n"), ["label", "leaf"], "left_semi")
        if large.isEmpty():
            break
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def links(nodes: DataFrame, least: float = COSINE, trees: int = TREES, group: int = GROUP) -> DataFrame:
    """key, n_links and root, a row for each node and leaf with links; nodes: key, label, vector of one dimension, copies.

    n_links sums to the copies of other nodes that are linked; key and root are linked, and all links follow from those.
    """
    dimension = nodes.select(F.size("vector").alias("n")).first()
    if dimension is None:
        return nodes.sparkSession.createDataFrame([], "key long, n_links long, root long")
    placed = stored(placed_in(nodes, forest(nodes, dimension["n"], trees)), "placed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]
        keys, side, copies = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("key", "side", "copies"))
        ids, counts = (np.concatenate([f(b.column("leaves")).to_numpy() for b in parts]) for f in (pa.ListArray.flatten, pa.ListArray.value_lengths))
        order = np.lexsort([keys, side])
        owner = np.repeat(np.argsort(order), counts)
        x = unit(np.concatenate([matrix(b.column("vector")) for b in parts])[order])
        keys, leaf = keys[order], parts[0].column("leaf")[0].as_py()
        apart = parts[0].column("one")[0] != parts[0].column("two")[0]
        found, root = met(x, copies[order].astype(float), Leaves(owner, ids, leaf), int((side == 0).sum()) if apart else 0, least)
        some = (found > 0) | (root != np.arange(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(found[some].astype(np.int64)), pa.array(keys[root[some]])], ["key", "n_links", "root"])

    routed = placed.select("label", F.explode("leaves").alias("leaf"), "key", "copies", "vector", "leaves")
    large = stored(large_leaves(routed.select("label", "leaf"), group), "large")
    if large.isEmpty():
        groups = routed.select("label", "leaf", *whole_leaf(), "key", "copies", "vector", "leaves")
    else:
        plain = routed.drop("leaves")
        groups = stored(plain.join(large, ["label", "leaf"], "left_anti").select("label", "leaf", *whole_leaf(), "key", "copies", "vector").unionByName(
            divided(plain.join(large.drop("n"), ["label", "leaf"], "left_semi"), group)), "groups")
        # the leaves in which a node is compared in the end
        groups = groups.join(groups.groupBy("key").agg(F.collect_set("leaf").alias("leaves")), "key")
    return groups.groupBy("label", "leaf", "one", "two").applyInArrow(compare, "key long, n_links long, root long")


def near_vectors(embeddings: DataFrame, least: float = COSINE, trees: int = TREES, group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # equal vectors are told by 128 bits
    rows = stored(embeddings.select(
        "vec_id", "label", v.alias("vector"), F.when(fine, F.xxhash64("label", v)).alias("high"), F.when(fine, F.xxhash64(F.lit(1), v, "label")).alias("low"),
        F.monotonically_increasing_id().alias("row")), "vectors")
    keys = stored(rows.filter("high is not null").groupBy("high", "low").agg(F.min("row").alias("key"), F.count("*").alias("copies")), "keys")
    nodes = stored(rows.join(keys.select("key", "copies"), F.col("row") == F.col("key")).select("key", "label", "vector", "copies"), "nodes")
    found = nodes.sparkSession.createDataFrame([], "key long, n_links long, root long")
    for r in nodes.select(F.size("vector").alias("n")).distinct().collect():
        found = found.union(links(nodes.filter(F.size("vector") == r["n"]), least, trees, group))
    found = stored(found, "vector-links")
    component = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    near = found.groupBy("key").agg(F.sum("n_links").alias("near"))
    known = keys.join(near, "key", "left").join(component, "key", "left").select(
        "high", "low", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("class"))
    named = stored(rows.select("vec_id", "high", "low").join(known, ["high", "low"], "left"), "named")
    least_id = named.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("component_id"))
    return named.join(least_id, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
