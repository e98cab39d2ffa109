"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the labelled sample are cut into at most 64 bins; each tree level takes the split of largest gain from the
histograms of gradients and curvatures. The trees are then flattened into arrays (feature, threshold, leaf value) of
complete binary trees, and whole batches of rows go down all trees at once in numpy.

Null texts count as empty; empty texts have the statistics 0 and are scored like others. Every row is scored by itself, so
repeated rows and ids repeat their result; other columns than doc_id and text are not read. Without labelled rows every
score is 0.5. An empty table gives an empty result. Of several rows under one labelled id one is learned from, that with the
least statistics. A text of any length is one row of one task at a time. Of splits of equal gain the first feature and bin count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import held_out, labelled_sample, text_batches

#: The most labelled documents that are learned from: what the driver gets is this many rows of statistics.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 60, 4, 64, 0.2, 1.0, 8
LIMIT = 0.3
STATISTICS = (
    "log_bytes", "log_words", "word_length", "letters", "digits", "spaces", "upper", "symbols", "pipes", "stops", "lines_per_word",
    "distinct_words", "top_word", "repeats", "distinct_lines", "long_words", "stop_ends", "wide_bytes", "single_characters", "distinct_pairs")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
UPPER, DIGITS, BLANKS, STOPS = bytes(range(65, 91)), b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?"
WIDE = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    data, words, lines = text.encode(), text.split(), text.split("\n")
    n, k = max(1, len(data)), max(1, len(words))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    letters, digits, blanks, stops, wide = map(share, (LETTERS, DIGITS, BLANKS, STOPS, WIDE))
    counts = Counter(words)
    ends = sum(w[-1] in ".!?" for w in words)
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / k, letters, digits, blanks, share(UPPER),
        (1 - letters - digits - blanks - stops - wide) * bool(data), data.count(b"|") / k, stops, len(lines) / k,
        len(counts) / k, max(counts.values(), default=0) / k, sum(map(str.__eq__, words, words[1:])) / k, len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if len(w) > 14) / k, ends / k, wide,
        sum(c for w, c in counts.items() if len(w) == 1) / k, len(set(zip(words, words[1:], strict=False))) / k]


def with_statistics(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns and an array of the text's statistics."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_batches(batches):
            found = np.array([statistics(x or "") for x in batch.column("text").to_pylist()], np.float32)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))], [*columns, "statistics"])

    kinds = dict(documents.dtypes)
    return documents.select(*columns, "text").mapInArrow(measure, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", statistics array<float>")


class Forest:
    """Flattened trees: feature and threshold of each inner node and value of each leaf, level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        self.feature = np.zeros((TREES, (1 << DEPTH) - 1), np.int64)
        self.threshold = np.full((TREES, (1 << DEPTH) - 1), np.inf, np.float32)
        self.leaf = np.zeros((TREES, 1 << DEPTH))
        if not len(y):
            return
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
        width = x.shape[1]
        flat = bins + np.arange(width) * BINS
        margin = np.full(len(y), self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                count = 1 << level
                spot = (flat + (node * width * BINS)[:, None]).ravel()
                sums = [np.bincount(spot, np.repeat(v, width), minlength=count * width * BINS).reshape(count, width, BINS).cumsum(2) for v in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, :, -1:] for s in sums)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
                best = gain.reshape(count, -1).argmax(1)
                for i in range(count):
                    f, b = divmod(int(best[i]), BINS)
                    if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                        self.feature[t, count - 1 + i], self.threshold[t, count - 1 + i] = f, cuts[f][b]
                at = count - 1 + node
                node = 2 * node + (x[np.arange(len(y)), self.feature[t, at]] > self.threshold[t, at])
            gs, hs = (np.bincount(node, v, minlength=1 << DEPTH) for v in (g, h))
            self.leaf[t] = -RATE * gs / (hs + L2)
            margin += self.leaf[t][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees level by level."""
        trees, rows = np.arange(TREES)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), TREES), np.int64)
        for level in range(DEPTH):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.leaf[trees, node].sum(1) + self.base)))


def fitted(labels: DataFrame, documents: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> Forest:
    sample = with_statistics(labelled_sample(labels, documents, target, rows), ["doc_id", "label"]).groupBy("doc_id", "label").agg(
        F.min("statistics").alias("statistics")).toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(sample.column("statistics").to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    return Forest(x, np.array(sample.column("label").to_pylist(), float))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(fitted(labels, documents))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_batches(batches):
            x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(x))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
