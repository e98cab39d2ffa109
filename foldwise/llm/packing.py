"""Packing by power-of-two decomposition.

A document's token ids (with the closing id) are cut into pieces of the sequence length and then into the binary digits
of the rest. Every piece is a sequence of its own whose length is a power of two, so that no sequence crosses documents
and none is padded; pieces of one length form a bucket from which batches are drawn.

Null texts count as empty and give one piece, the closing id. Repeated rows give their pieces again, with sequence ids of
their own. Other columns than doc_id and text are not read. An empty table gives no pieces. There is no shuffle: ids of
sequences are the partition's number and a count within it, so a repeated task gives the same ones.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from foldwise.llm.common import text_batches

SEQUENCE, CLOSING = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, cached by word.

    The tokenizer splits at white space before merging, so a text's ids are those of its words in a row. Texts of plain
    Latin letters are lower-cased first, as the tokenizer does, and a stop or comma after a letter counts as a word: both
    keep the ids and make words recur. The cache is emptied when it holds ``most`` words.
    """

    # both begin with a set of characters, which the search skips to
    OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
    STOP = re.compile(r"[.,](?<=[a-zß-öø-ÿ][.,])(?=[ \n\t\r]|$)")
    LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
    BREAK = re.compile(r"[ \t\n\r]+")

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.most = most

    def words(self, text: str) -> list[str]:
        if "<|" in text or self.OTHER.search(text):
            return [w for w in self.BREAK.split(text) if w]
        return self.STOP.sub(r" \g<0>", text.lower()).split()

    def learn(self, words: set[str]) -> None:
        plain = [w for w in words if self.LETTERS.fullmatch(w)]
        for i in range(0, len(plain), 4000):
            part = plain[i: i + 4000]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            data, at = ids.tobytes(), 0
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(part):
                raise ValueError("the tokenizer doesn't mark the ends of words")
            for word, stop in zip(part, stops, strict=True):
                self.cache[word] = data[at:stop]
                at = stop
        rest = list(words.difference(plain))
        for word, found in zip(rest, self.full.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.cache[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(x) for x in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
        missing = set().union(*split).difference(self.cache)
        if missing:
            self.learn(missing)
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]


@functools.cache
def encoder(tokenizer: str) -> WordEncoder:
    if not os.path.isabs(tokenizer):
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return WordEncoder(tokenizer)


def piece_lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Whole sequences, then the binary digits of the rest, longest first."""
    return [sequence] * (n // sequence) + [1 << i for i in reversed(range(sequence.bit_length())) if n % sequence >> i & 1]


def packed(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; each is the sequence ``sequence_id``, from offset 0. with_ids: their ids, as a column."""
    if sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        closing = np.array([CLOSING], "<u4").tobytes()
        for batch, _, _ in text_batches(batches, 1 << 18):
            rows: list[tuple] = []
            parts: list[bytes] = []
            encoded = encoder(tokenizer).encode([x or "" for x in batch.column("text").to_pylist()])
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                data += closing
                n, start = len(data) // 4, 0
                for length in piece_lengths(n, sequence):
                    part = data[4 * start: 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), n, number, 0, length.bit_length() - 1))
                    if with_ids:
                        parts.append(part)
                    start += length
                    number += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.int32()], strict=True)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select("doc_id", "text").mapInArrow(cut, SCHEMA + ", ids array<int>" * with_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces with ids as Parquet, in one folder for each length: readers draw batches of equal length from a folder."""
    pieces.write.partitionBy("bucket").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
