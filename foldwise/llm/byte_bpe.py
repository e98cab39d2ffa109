"""Byte-level BPE: encoding with the ranks of a public vocabulary, and decoding.

Texts are split as the vocabulary's pattern splits them (`public_tokenizers.PATTERN`), but without a regular expression.
Each code point has a class (letter, number, space, ...), raised by what stands next to it where the pattern looks ahead.
A class is a function from the automaton's states to its states. Functions compose associatively and only some hundred
different ones arise, so a scan over numbers of functions, in blocks side by side, gives every code point's state, and with
it the places where pieces begin. A text's first code point is a constant function, so texts are scanned in one run.

Pieces are slices of the text's bytes. Their ids come from a cache, or from merging pairs by rank: many short pieces side by
side, a long one by a heap and links, whose time grows with n log n. A text keeps, beside its ids, the byte at which each
begins, so that any run of ids can be decoded by itself; decoding copies the tokens' bytes to those places.

Null texts count as empty; an empty text has no ids. Repeated rows repeat their result; there are no ties. Texts of any length are
whole rows of one task, worked on by about 1 MB of text at a time, or by one text. Columns of other names are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foldwise.llm.common import text_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Most pieces that the cache keeps, and length beyond which a piece is merged by a heap and not kept.
CACHED_PIECES, LONG = 400_000, 128
#: Code points of a column of the scan; pieces or tokens that are held as single things at once; pieces merged together.
WIDTH, STRETCH, TOGETHER = 64, 1 << 18, 1 << 14
#: More than any rank.
NONE = 1 << 31

# classes of code points: any other sign, letter, number, white space before white space or the end; then what needs a look ahead:
# a blank and other white space before something else, and an apostrophe before one letter or two of a contraction
OTHER, LETTER, NUMBER, SPACE, BLANK, LAST, ONE, TWO = range(8)
# states: a piece has just ended, or the piece so far is white space, one blank, letters, numbers, other signs, or a contraction
# that lacks one or two letters
ENDED, SPACES, PAST_BLANK, LETTERS, NUMBERS, OTHERS, LACKS_ONE, LACKS_TWO = range(8)
#: The pattern's white space and contractions (fixed values).
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a piece begins at it."""
    if state in (LACKS_ONE, LACKS_TWO):
        return (ENDED if state == LACKS_ONE else LACKS_ONE), False
    if kind == SPACE:
        return SPACES, state != SPACES
    if kind in (BLANK, LAST):
        return (PAST_BLANK if kind == BLANK else ENDED), True
    own = {LETTER: LETTERS, NUMBER: NUMBERS}.get(kind, OTHERS)
    if state in (PAST_BLANK, own):
        return own, False
    return {ONE: LACKS_ONE, TWO: LACKS_TWO}.get(kind, own), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that arise from the classes: each class's number (as it is, then as a text's first), the numbers of
    compositions (row first, then column), each function's states, and where pieces begin by state and class."""
    kinds = range(8)
    each = [tuple(step(s, k)[0] for s in range(8)) for k in kinds]
    single = each + [(f[ENDED],) * 8 for f in each]
    known = {f: i for i, f in enumerate(dict.fromkeys([*single, tuple(range(8))]))}
    found, i = list(known), 0
    while i < len(found):
        for g in dict.fromkeys(single):
            made = tuple(g[s] for s in found[i])
            if made not in known:
                known[made] = len(found)
                found.append(made)
        i += 1
    both = np.array([[known[tuple(g[s] for s in f)] for g in found] for f in found], np.int16)
    begins = np.array([[step(s, k)[1] for k in kinds] for s in range(8)])
    return np.array([known[f] for f in single], np.int16), both, np.array(found, np.int8), begins


@functools.cache
def classes() -> np.ndarray:
    """Each code point's class, without what needs a look ahead: letters and numbers of the library's version of Unicode,
    which it gives back, of all code points, under a vocabulary of single bytes."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        only = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(only.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    table[WHITE] = SPACE
    return table


def raised(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Classes of the code points with the look ahead; ``last``: places of texts' last code points."""
    kinds = classes()[points]
    apart = np.zeros(len(points) + 2, bool)
    apart[last] = True
    space = np.concatenate([kinds == SPACE, [True, True]])
    before_other = space[:-2] & ~space[1:-1] & ~apart[:-2]
    kinds[before_other] = np.where(points[before_other] == 0x20, BLANK, LAST)
    marks = np.flatnonzero((points == 0x27) & ~apart[:-2])
    following = np.concatenate([points, [0, 0]])
    for text in CONTRACTIONS:
        hit = marks
        for j, c in enumerate(text, 1):
            hit = hit[following[hit + j] == ord(c)]
        if len(text) == 2:
            hit = hit[~apart[hit + 1]]
        kinds[hit] = ONE if len(text) == 1 else TWO
    return kinds


def boundaries(points: np.ndarray, first: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Where pieces begin, of texts in a row that start at the places ``first`` (no text is empty)."""
    if not len(points):
        return np.zeros(0, np.int64)
    single, both, states, begins = automaton()
    kinds = raised(points, np.append(first[1:], len(points)) - 1)
    number = single[kinds]
    number[first] = single[kinds[first] + 8]
    # a column holds `width` code points in a row, and the scan goes down all columns side by side
    columns = -(-len(points) // width)
    grid = np.full(columns * width, single[0], np.int16)
    grid[: len(points)] = number
    grid = np.ascontiguousarray(grid.reshape(columns, width).T)
    for i in range(1, width):
        grid[i] = both[grid[i - 1], grid[i]]
    # the columns' totals are scanned by doubling, and give the state in which each column begins
    total, gap = grid[-1].copy(), 1
    while gap < columns:
        total[gap:] = both[total[:-gap], total[gap:]]
        gap *= 2
    entered = np.concatenate([[ENDED], states[total[:-1], ENDED]])
    after = states[grid, entered[None, :]]
    before = np.concatenate([entered[None, :], after[:-1]]).T.ravel()[: len(points)]
    starts = begins[before, kinds]
    starts[first] = True
    return np.flatnonzero(starts)


class Pairs:
    """Which token two tokens in a row make: an open-addressed table, looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter(found.keys(), np.uint64, len(found))
        bits = max(4, (4 * len(found)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.made = np.full(1 << bits, NONE, np.int64)
        made = np.fromiter(found.values(), np.int64, len(found))
        at, left, self.tries = self.place(keys), np.arange(len(keys)), 0
        while len(left):
            self.tries += 1
            free = self.made[at[left]] == NONE
            self.keys[at[left[free]]] = keys[left[free]]
            # of those that chose one slot the last is in it
            here = free & (self.keys[at[left]] == keys[left])
            self.made[at[left[here]]] = made[left[here]]
            left = left[~here]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each pair, or NONE."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self.place(keys)
        out = np.where(self.keys[at] == keys, self.made[at], NONE)
        for _ in range(self.tries - 1):
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.made[at[hit]]
        return out


class Vocabulary:
    """Ranks of byte strings, the cache of pieces' ids, and the tokens' bytes in a row."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        by_rank = [b""] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.lengths = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.data = np.frombuffer(b"".join(by_rank), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)

    def learn(self, pieces: list[bytes]) -> None:
        """Ids of pieces into the cache, merged side by side: in each round, of every piece that still has a pair the leftmost
        pair of lowest rank."""
        whole = [p for p in pieces if p not in self.ranks and len(p) <= LONG]
        for p in pieces:
            if p in self.ranks:
                self.cache[p] = self.ranks[p].to_bytes(4, "little")
            elif len(p) > LONG:
                self.cache[p] = np.array(self.merged_by_heap(p), "<u4").tobytes()
        for i in range(0, len(whole), TOGETHER):
            part = whole[i: i + TOGETHER]
            ids, ends = self.merged(part)
            data, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            self.cache.update(zip(part, (data[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's begin (one more than pieces); no piece is empty."""
        sizes = np.array([len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts + sizes - 1] = n
        before[starts] = -1
        # what each token and the one after it make; a last token makes nothing
        made = np.full(n + 1, NONE)
        inner = np.flatnonzero(after < n)
        made[inner] = self.pairs.joined(ids[inner], ids[inner + 1])
        alive = np.ones(n, bool)
        rows, active_starts, active_sizes = np.arange(n), starts, sizes
        while len(rows):
            # of rank and place the least; pieces without a pair leave, and places that were joined away go from time to time
            best = np.minimum.reduceat(made[rows] * n + rows, active_starts)
            going = best < NONE * n
            i = best[going] % n
            ids[i] = made[i]
            gone = after[i]
            alive[gone] = False
            made[gone] = NONE
            after[i] = after[gone]
            inside = after[i] < n
            before[after[i][inside]] = i[inside]
            made[i] = NONE
            made[i[inside]] = self.pairs.joined(ids[i[inside]], ids[after[i[inside]]])
            left = i[before[i] >= 0]
            made[before[left]] = self.pairs.joined(ids[before[left]], ids[left])
            keep = np.repeat(going, active_sizes) & alive[rows]
            active_sizes = np.add.reduceat(keep.astype(np.int64), active_starts)[going]
            rows = rows[keep]
            active_starts = np.cumsum(active_sizes) - active_sizes
        counts = np.add.reduceat(alive.astype(np.int64), starts)
        return ids[alive], np.concatenate([[0], np.cumsum(counts)])

    def merged_by_heap(self, piece: bytes) -> list[int]:
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # where the part that begins here ends; 0: none begins here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle == n or end[middle] != stop:
                continue  # one of the two has grown or gone since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i: end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := get(piece[before[i]: stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [self.ranks[piece[i:e]] for i, e in enumerate(end) if e]

    def encoded(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts in a row (``ends``: byte offsets, one more than texts): ids, each token's first byte within its text,
        and the texts' offsets into both."""
        raw = np.frombuffer(data, np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((raw & 0xC0) != 0x80)
        full = np.flatnonzero(np.diff(ends))
        starts = places[boundaries(points, np.searchsorted(places, ends[full]))]
        cuts, found = np.append(starts, len(data)).tolist(), []
        for i in range(0, len(starts), STRETCH):
            stretch = cuts[i: i + STRETCH + 1]
            pieces = [data[a:b] for a, b in zip(stretch, stretch[1:], strict=False)]
            self.learn(list(set(pieces).difference(self.cache)))
            found.append(b"".join(map(self.cache.__getitem__, pieces)))
            if len(self.cache) > CACHED_PIECES or any(len(p) > LONG for p in pieces):
                self.forget()
        ids = np.frombuffer(b"".join(found), "<u4")
        lengths = self.lengths[ids]
        first = np.cumsum(lengths) - lengths
        offsets = np.searchsorted(first, ends)
        return ids, first - np.repeat(ends[:-1], np.diff(offsets)), offsets

    def forget(self) -> None:
        """Empty the cache where it is full, else drop long pieces only."""
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        else:
            for piece in [p for p in self.cache if len(p) > LONG]:
                del self.cache[piece]

    def decoded(self, ids: np.ndarray, first: np.ndarray, base: np.ndarray) -> bytes:
        """The tokens' bytes, each written to its place; ``base``: where each token's text begins in the result."""
        out = np.zeros(int(self.lengths[ids].sum()), np.uint8)
        for i in range(0, len(ids), STRETCH):
            part = ids[i: i + STRETCH]
            lengths = self.lengths[part]
            within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            places = base[i: i + STRETCH] + first[i: i + STRETCH]
            out[np.repeat(places, lengths) + within] = self.data[np.repeat(self.starts[part], lengths) + within]
        return out.tobytes()


@functools.cache
def vocabulary(ranks: str) -> Vocabulary:
    if not os.path.isabs(ranks):
        import public_tokenizers

        ranks = public_tokenizers.path(ranks)
    return Vocabulary(ranks)


def encoded_batches(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    for batch, data, ends in text_batches(batches):
        ids, first, offsets = vocabulary(ranks).encoded(data.tobytes(), ends)
        at = pa.array(offsets.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(first))],
            ["doc_id", "ids", "offsets"])


def decoded_batches(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    known = vocabulary(ranks)
    for whole in batches:
        for i in range(0, len(whole), 256):
            batch = whole.slice(i, 256)
            counts = batch.column("ids").value_lengths().to_numpy()
            ids, first = (batch.column(c).flatten().to_numpy() for c in ("ids", "offsets"))
            sizes = np.concatenate([[0], np.cumsum(known.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            data = known.decoded(ids, first, np.repeat(sizes[:-1], counts))
            texts = [data[a:b] for a, b in zip(sizes.tolist(), sizes[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "data"])


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets = batch.column("ids").offsets.to_numpy().tolist()
        data = batch.column("ids").values.to_numpy().astype("<u4").tobytes()
        by_ids = [hashlib.sha256(data[4 * a: 4 * b]).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
        by_data = [hashlib.sha256(x).hexdigest() for x in batch.column("data").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(by_ids, pa.string()), pa.array(by_data, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids, and offsets: the byte of the text at which each id's token begins."""
    return documents.select("doc_id", "text").mapInArrow(lambda b: encoded_batches(b, ranks), "doc_id long, ids array<int>, offsets array<long>")


def decoded(codes: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids and data: the bytes that the ids stand for."""
    return codes.select("doc_id", "ids", "offsets").mapInArrow(lambda b: decoded_batches(b, ranks), "doc_id long, ids array<int>, data binary")


def digests(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Texts there and back in one task: numbers of ids, and the SHA-256 of the ids and of the bytes that they decode to."""
    return documents.select("doc_id", "text").mapInArrow(
        lambda b: digest_batches(decoded_batches(encoded_batches(b, ranks), ranks)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
