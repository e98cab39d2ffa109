"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes are padded with bytes 255 to a positive multiple of 576 and stored as an 8-bit grey PNG image of 576
columns, one sample a byte. Tasks append each payload that they have not yet stored, named by the SHA-256 of its
samples, to a tar shard in the shared folder; a row carries the digest, shard, offset and length. Of copies in several
shards the first is used. Range reads of the headers fill the metadata columns; whole reads give back the payload.

Null texts count as empty. Repeated rows share one payload and repeat their result. Other columns than doc_id and text are
not read. An empty table gives an empty result. A task that is run again writes a shard of its own, and only rows of the
attempt that ended well name one.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import new_folder, stored, text_batches

UNIT = 576
#: Bytes after which a task starts its next shard.
SHARD = 256 << 20
HEADER = 33
#: Stored bytes that a task reads back.
READ = 64 << 20


def payload(text: Column) -> Column:
    """The padded bytes of a text, as a binary column."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.length(data)
    pad = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), pad)))


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """An 8-bit grey image of UNIT columns whose samples are the payload."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first bytes of an image."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png wrote."""
    width, height, _ = png_header(data)
    at, packed = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at: at + 4])
        if data[at + 4: at + 8] == b"IDAT":
            packed += data[at + 8: at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def write_shards(documents: DataFrame, folder: str, shard_bytes: int = SHARD) -> DataFrame:
    """Write the payloads of all texts; rows: digest, shard, offset, length, once for each shard that holds the digest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, seen = None, set()
        try:
            for batch, data, ends in text_batches(batches):
                rows = []
                for i in range(len(batch)):
                    samples = padded(data[ends[i]: ends[i + 1]].tobytes())
                    digest = hashlib.sha256(samples).hexdigest()
                    if digest in seen:
                        continue
                    if out is None or out.tell() > shard_bytes:
                        if out is not None:
                            out.write(b"\0" * 1024)
                            out.close()
                        shard, seen = f"shard-{uuid.uuid4().hex}.tar", set()
                        out = system.open_output_stream(f"{root}/{shard}")
                    image = to_png(samples)
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(image)
                    out.write(member.tobuf(tarfile.USTAR_FORMAT))
                    rows.append((digest, shard, out.tell(), len(image)))
                    out.write(image + b"\0" * (-len(image) % 512))
                    seen.add(digest)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                        ["digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()

    return documents.select("text").mapInArrow(write, "digest string, shard string, offset long, length long")


def _ranges(index: DataFrame, folder: str, most: int | None, read, schema: str) -> DataFrame:
    """``read(row's bytes)`` of each row of the index, by range reads of ``most`` bytes at most; shards are opened once in a row."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, system.open_input_file(f"{root}/{shard}")
                rows.append(read(file.read_at(length if most is None else min(most, length), offset)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*batch.schema.names, *names])
        if file is not None:
            file.close()

    before = ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in index.schema.fields)
    return index.mapInArrow(work, f"{before}, {schema}")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bits, from the headers alone."""
    return _ranges(index, folder, HEADER, png_header, "width int, height int, bits int")


def features(image: bytes) -> tuple:
    samples = from_png(image)
    values = np.frombuffer(samples, np.uint8)
    counts = np.bincount(values >> 4, minlength=16)
    feature = f"mean={int(values.sum(dtype=np.int64)) * 1000 // len(values)};bins=" + ".".join(map(str, counts.tolist()))
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), hashlib.sha256(image).hexdigest(), feature


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """The index with what the stored bytes themselves show."""
    return _ranges(index, folder, None, features, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media_columns(documents: DataFrame, folder: str) -> DataFrame:
    """One row for each document, with the columns of its stored payload."""
    written = stored(write_shards(documents, folder), "media-index")
    index = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # reading tasks are sized by the payloads, not by the small index
    tasks = max(2 * documents.sparkSession.sparkContext.defaultParallelism, (written.agg(F.sum("length")).first()[0] or 0) // READ + 1)
    index = index.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    filled = with_features(with_metadata(index, folder), folder).withColumnRenamed("length", "media_bytes")
    rows = documents.select("doc_id", F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("n_bytes"),
                            F.sha2(payload(F.col("text")), 256).alias("digest"))
    return rows.join(filled, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "shard", "offset", "width", "height", "bits")


def unpacked(shard: bytes) -> dict[str, bytes]:
    """Members of a shard by digest (for tests and small tools)."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {m.name.removesuffix(".png"): tar.extractfile(m).read() for m in tar}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "media"))
