"""Vector codes: parts of vectors as indexes into codebooks, in integers only.

A component x becomes the integer floor(1024 x) and vectors are cut into equal consecutive parts. Parts and codebook
entries are zero-padded to a power of two and go through an integer Walsh-Hadamard transform, which multiplies squared
distances by the padded length and nothing else. Differences are summed in sequency order, from slow changes to fast ones,
where most of a smooth part's energy comes first. Partial sums only grow, so an entry whose sum exceeds that of a finished
entry is out; equal ones stay, and ties go to the lower index.

A round assigns all parts and adds them up by entry in the tasks; the tasks' sums meet in a shuffle by position and entry,
and what comes to the driver and is sent out again is the codebooks: at most entries x dimension integers.

Vectors that are null, empty or hold null or non-finite components are left out. Vectors of different dimension, a dimension
that the parts don't divide, and components of 2^40 or more in size are errors. Where products of the integers wouldn't fit
64 bits, Python's integers take over; an error that no long can hold is null. Of equal vec_ids the vector that sorts first
comes first into a codebook, null ids come last. Fewer vectors than entries give shorter codebooks. Repeated rows are coded
each for itself. Other columns than vec_id, label and embedding are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 50
#: Vectors that one step of a task takes; coefficients after which sums are compared.
ROWS, STEP = 2048, 4


def walsh(x: np.ndarray) -> np.ndarray:
    """The transform of each row, zero-padded to a power of two, in sequency order; sums and differences only."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), width), x.dtype)
    out[:, : x.shape[1]] = x
    half = 1
    while half < width:
        pairs = out.reshape(len(x), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
        half *= 2
    return out[:, sequency(width)]


def sequency(width: int) -> list[int]:
    """Places of the natural order by the number of sign changes of their rows: bits reversed, Gray code undone."""
    bits = width.bit_length() - 1
    changes = []
    for i in range(width):
        code = int(f"{i:0{bits}b}"[::-1], 2) if bits else 0
        n = 0
        while code:
            n ^= code
            code >>= 1
        changes.append(n)
    return sorted(range(width), key=changes.__getitem__)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry, the lower on ties, and the squared distance."""
    a, b = walsh(parts), walsh(entries)
    width, rows = a.shape[1], np.arange(len(a))
    first = min(STEP, width)
    sums = np.zeros((len(a), len(b)), a.dtype)
    for j in range(first):
        sums += (a[:, j, None] - b[:, j]) ** 2
    # the entry that leads so far is finished: its sum bounds all others
    lead = sums.argmin(1)
    bound = sums[rows, lead] + ((a[:, first:] - b[lead, first:]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for j in range(first, width, STEP):
        for c in range(j, min(j + STEP, width)):
            left = left + (a[row, c] - b[entry, c]) ** 2
        stay = left <= bound[row]
        row, entry, left = row[stay], entry[stay], left[stay]
    # rows are in order, and so are the entries of a row
    starts = np.searchsorted(row, rows)
    least = np.minimum.reduceat(left, starts)
    best = np.flatnonzero(left == least[row])
    best = best[np.searchsorted(row[best], rows)]
    return entry[best], least // width


def cut(column: pa.Array, dimension: int, parts: int, reach: int) -> list[np.ndarray]:
    """Each part position's rows; ``reach``: the largest integer of the codebooks."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = fitting(flat, dimension // parts, max(reach, int(np.abs(flat).max()) if len(flat) else 0))
    return np.split(flat.reshape(-1, dimension), parts, axis=1)


def fitting(x: np.ndarray, length: int, reach: int) -> np.ndarray:
    """As int64 where sums of squared differences of transforms can't overflow, else as Python's integers."""
    width = 1 << max(0, length - 1).bit_length()
    return x if 4 * width**3 * reach**2 < 1 << 62 else x.astype(object)


class Codebooks:
    """The entries of each part position, and the largest size of an integer in them."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.reach = max((abs(x) for part in entries for e in part for x in e), default=0)

    def assigned(self, column: pa.Array, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part, entries in zip(cut(column, dimension, len(self.entries), self.reach), self.entries, strict=True):
            yield part, *nearest(part, np.array(entries, object).astype(part.dtype))

    def digest(self) -> str:
        numbers = (str(x) for part in self.entries for e in part for x in e)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and x: the integers of the vectors that count."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.when(F.forall(v, lambda c: F.abs(c.cast("double")) < float(LARGEST // SCALE)), v).otherwise(
        F.raise_error(F.lit("components of 2^40 or more in size")).cast("array<double>"))
    whole = F.transform(small.cast("array<double>"), lambda c: F.floor(c * float(scale)).cast("long"))
    return embeddings.filter(fine).select("vec_id", "label", whole.alias("x"))


def trained(rows: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after so many rounds, from the smallest ids' parts on."""
    length = dimension // parts
    first = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    books = Codebooks([[x[p * length: (p + 1) * length] for x in first] for p in range(parts)])
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((parts, entries), np.int64)
            sums = np.zeros((parts, entries, length), object if books.reach > 1 << 30 else np.int64)
            for batch in batches:
                for i in range(0, len(batch), ROWS):
                    for p, (part, code, _) in enumerate(books.assigned(batch.column("x").slice(i, ROWS), dimension)):
                        if part.dtype == object:
                            sums = sums.astype(object)
                        order = np.argsort(code, kind="stable")
                        used, starts = np.unique(code[order], return_index=True)
                        sums[p, used] += np.add.reduceat(part[order], starts, axis=0)
                        counts[p] += np.bincount(code, minlength=entries)
            p, e = np.nonzero(counts)
            totals = [list(map(str, row)) for row in sums[p, e].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(totals, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

        found = rows.select("x").mapInArrow(add, "part long, entry long, n long, sums array<string>")
        totals = found.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(length)]).alias("sums"))
        new = [list(part) for part in books.entries]
        for r in totals.collect():
            new[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        books = Codebooks(new)
    return books


def coded(rows: DataFrame, books: Codebooks, dimension: int) -> DataFrame:
    """vec_id, label, codes (0-based indexes in part order) and error (the summed squared distances) of each row."""
    kind = dict(rows.dtypes)["label"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                batch = whole.slice(i, ROWS)
                _, codes, errors = zip(*books.assigned(batch.column("x"), dimension), strict=True)
                error = [x if x < 1 << 63 else None for x in sum(e.astype(object) for e in errors)]
                flat = pa.array(np.stack(codes, 1).ravel().astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(codes)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    return rows.mapInArrow(code, f"vec_id long, label {kind}, codes array<int>, error long")


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, codes, error, label_error and codebooks_sha256 of each vector."""
    rows = stored(integers(embeddings, scale), "vectors")
    shape = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if shape["most"] is None:
        return coded(rows, Codebooks([[]] * parts), parts).withColumns({"label_error": F.lit(None).cast("long"), "codebooks_sha256": F.lit(Codebooks([]).digest())})
    if shape["least"] != shape["most"] or shape["most"] % parts:
        raise ValueError(f"vectors of dimensions {shape['least']} to {shape['most']} in {parts} parts")
    books = trained(rows, shape["most"], parts, entries, rounds)
    made = stored(coded(rows, books, shape["most"]), "codes")
    by_label = made.groupBy(F.col("label").alias("_label")).agg(
        F.when(F.count("error") == F.count("*"), F.try_sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error"))
    return made.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label").withColumn("codebooks_sha256", F.lit(books.digest()))


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with the vectors that they stand for, as doubles."""
    entries = books.entries

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(part, float) / scale for part in entries]
        for batch in batches:
            at = batch.column("codes").flatten().to_numpy().reshape(-1, len(tables))
            x = np.concatenate([t[at[:, p]] for p, t in enumerate(tables)], axis=1)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], [*batch.schema.names, "vector"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in codes.dtypes)
    return codes.mapInArrow(look_up, f"{kinds}, vector array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    return made.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")
