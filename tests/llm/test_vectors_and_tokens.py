"""Whitening, byte-level BPE and vector codes against brute force, on small tables with all odd cases."""

import base64
import collections
import hashlib
import math
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.llm import byte_bpe, vector_codes, whitening

VECTORS = "vec_id long, embedding array<float>, label int, component int, codes string, v string, x string, error string"


def vectors(n=700, d=8, seed=0, copies=150):
    """Rows with copies, ties, repeated and null ids, null labels, and vectors that don't count."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.linspace(0.05, 1.5, d) + np.linspace(-3, 2, d)).astype(np.float32)
    x[n // 2: n // 2 + copies] = x[min(7, n - 1)]
    rows = [(i, [float(c) for c in v], i % 3 if i % 10 else None) for i, v in enumerate(x)]
    rows += [(3, rows[n // 3][1], 1), (None, rows[n // 4][1], 2), (None, rows[n // 4][1], 2)]
    bad = [None, [], [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [1.0] * (d - 1) + [float("inf")], [float("-inf")] * d]
    return rows + [(10_000 + i, b, 1) for i, b in enumerate(bad)]


def counted(rows):
    return [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, None, "a", "b", "c", "d") for r in rows], VECTORS).repartition(parts)


# whitening

def whitened_by_covariance(rows):
    x = np.array([[math.floor(64 * np.float64(c)) + 1_000_000 for c in r[1]] for r in counted(rows)], np.int64)
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, centred, values[::-1], basis[:, ::-1]


def test_whitening_against_covariance(spark):
    rows = vectors()
    got = whitening.whitened(table(spark, rows), components=5).collect()
    x, n, s, centred, values, basis = whitened_by_covariance(rows)
    assert len(got) == n * 5 and {r["component"] for r in got} == set(range(1, 6)) and {r["n"] for r in got} == {n}
    expected = collections.Counter((r[0], sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True))) for r, v in zip(counted(rows), x, strict=True))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == expected
    ids = [r[0] for r in counted(rows)]
    once = [i for i, r in enumerate(ids) if r is not None and ids.count(r) == 1]
    for c in range(5):
        of = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        want = centred @ basis[:, c] / np.sqrt(values[c])
        mine = np.array([of[ids[i]] for i in once])
        assert np.abs(mine - want[once] * np.sign(mine[0] * want[once[0]])).max() < 1e-7
        assert all(abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9 for r in got if r["component"] == c + 1)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_keeps_small_components(spark):
    """Dimensions whose deviations differ by a factor of 10^6, which a covariance's own decomposition tells to 10^-4 only."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 4)) * [1e7, 1e4, 1e2, 2]) / 64
    got = whitening.whitened(table(spark, [(i, [float(c) for c in v], 1) for i, v in enumerate(x)], 3).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))).collect()
    assert max(r["component"] for r in got) == 4 and got[0]["identity_error"] < 1e-6
    fourth = np.array([r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == 4])
    assert abs(fourth.var() - 1) < 1e-6


def test_whitening_of_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-200, 200, (2, 300)) / 64.0
    rows = [(i, [p, q, p + q, 5.0, p], 1) for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True))]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9
    assert abs(sum(r["explained"] for r in got) / len(rows) - 1) < 1e-9


def test_whitening_of_odd_tables(spark):
    row = (1, [0.5, 0.25], 1)
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [row])).count() == 0
    assert whitening.whitened(table(spark, [row] * 9)).count() == 0
    assert whitening.whitened(table(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    got = whitening.whitened(table(spark, [row, (2, [0.75, 0.25], 1)])).collect()
    assert sorted((r["vec_id"], abs(round(r["whitened"], 9)), r["deviation"], r["component"]) for r in got) == [(1, 1.0, 256, 1), (2, 1.0, 256, 1)]
    with pytest.raises(ValueError, match="dimensions 2 to 3"):
        whitening.whitened(table(spark, [row, (2, [1.0, 2.0, 3.0], 1)]))


def test_deviations_stay_exact_when_large(spark):
    huge = float(2**38)
    rows = [(i, [huge * (i % 5 - 2), float(i)], 1) for i in range(50)]
    frame = table(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(frame).filter("component = 1").collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((50 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    assert got == {i: e if e < 1 << 63 else None for i, e in enumerate(exact)}


# vector codes

def codes_by_rounds(rows, parts=4, entries=256, rounds=4):
    kept = counted(rows)
    x = [[math.floor(1024 * c) for c in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i]))[:entries]
    length = len(x[0]) // parts
    cut = [[v[p * length: (p + 1) * length] for v in x] for p in range(parts)]
    books = [[cut[p][i] for i in order] for p in range(parts)]

    def assign(p):
        found = []
        for v in cut[p]:
            distances = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]]
            found.append((distances.index(min(distances)), min(distances)))
        return found

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v, (e, _) in zip(cut[p], assign(p), strict=True):
                groups[e].append(v)
            new.append([[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])])
        books = new
    final = [assign(p) for p in range(parts)]
    errors = [sum(final[p][i][1] for p in range(parts)) for i in range(len(kept))]
    labels = collections.Counter()
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    return collections.Counter((r[0], "".join(f"{final[p][i][0]:02x}" for p in range(parts)), errors[i], labels[r[2]], digest) for i, r in enumerate(kept))


def coded(frame):
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    made = vector_codes.compressed(frame).select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")
    return collections.Counter(tuple(r) for r in made.collect())


@pytest.mark.parametrize("n,d", [(520, 12), (300, 20), (90, 4), (1, 8)])
def test_codes_against_rounds(spark, n, d):
    rows = vectors(n, d, seed=n, copies=n // 5)
    assert coded(table(spark, rows)) == codes_by_rounds(rows)


def test_codes_of_large_components(spark):
    """Integers whose transforms don't fit 64 bits, and ties between entries."""
    rows = [(i, [float((i % 7) * 3.0e9), -float(i % 3), float(i * 1e5), 0.0] * 2, None) for i in range(60)]
    assert coded(table(spark, rows)) == codes_by_rounds([(i, [float(np.float32(c)) for c in v], k) for i, v, k in rows])


def test_codes_of_odd_tables(spark):
    assert vector_codes.compressed(table(spark, [])).count() == 0
    assert vector_codes.compressed(table(spark, [(1, None, 2)])).columns == ["vec_id", "label", "codes", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="in 4 parts"):
        vector_codes.compressed(table(spark, [(1, [1.0] * 6, 2)]))
    with pytest.raises(Exception, match="2\\^40"):
        vector_codes.compressed(table(spark, [(1, [1.0e30] * 4, 2)])).collect()


def test_codes_round_trip(spark):
    """With as many entries as vectors all come back exactly, down to the integers."""
    rows = [(i, [i / 8, i / 16, -i / 4, 1.0], 1) for i in range(40)]
    frame = vector_codes.integers(table(spark, rows))
    books = vector_codes.trained(frame, 4)
    back = {r["vec_id"]: r["vector"] for r in vector_codes.decoded(vector_codes.coded(frame, books, 4), books).collect()}
    assert back == {i: v for i, v, _ in rows}


@given(st.integers(1, 40), st.integers(1, 9), st.integers(1, 20), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_nearest_by_elimination(n, m, d, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-4, 5, (n, d)), rng.integers(-4, 5, (m, d))
    every = ((a[:, None] - b) ** 2).sum(2)
    code, distance = vector_codes.nearest(a, b)
    assert (code == every.argmin(1)).all() and (distance == every.min(1)).all()
    code, distance = vector_codes.nearest(a.astype(object), b.astype(object))
    assert (code == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_transform_is_in_sequency_order():
    for width in (1, 2, 4, 16, 32):
        rows = vector_codes.walsh(np.eye(width, dtype=np.int64)).T
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(width))
        assert (rows @ rows.T == width * np.eye(width)).all()


# byte-level BPE

@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(texts):
    data = "".join(texts).encode()
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    return byte_bpe.vocabulary(byte_bpe.RANKS).encoded(data, ends)


def check(texts, reference):
    known = byte_bpe.vocabulary(byte_bpe.RANKS)
    ids, first, offsets = pieces(texts)
    for i, text in enumerate(texts):
        own = slice(offsets[i], offsets[i + 1])
        assert ids[own].tolist() == reference.encode_ordinary(text), text
        assert known.decoded(ids[own], first[own], np.zeros(offsets[i + 1] - offsets[i], np.int64)) == text.encode()


def test_classes_of_code_points(reference):
    """Signs of all kinds between letters, numbers and blanks."""
    signs = [chr(i) for i in [*range(1, 0x3100), *range(0x3100, 0x110000, 53)] if not 0xD800 <= i < 0xE000]
    check([f"a{c}a1{c}1 {c} .{c}.\n{c}{c}" for c in signs], reference)


@given(st.lists(st.text(alphabet=st.sampled_from("aeslmdtvr'’ \n\t  é日٣½9_.!🙂éⅣAZ​"), max_size=30), min_size=1, max_size=6))
@settings(max_examples=400, deadline=None)
def test_tokens_of_odd_texts(reference, texts):
    check(texts, reference)


@given(st.lists(st.text(max_size=300), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_tokens_of_any_texts(reference, texts):
    check(texts, reference)


def test_scan_in_columns_of_any_width(reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a b'sre  \n12.") for _ in range(rng.randint(1, 90))) for _ in range(40)]
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    first = np.cumsum([0, *map(len, texts)])[:-1]
    runs = [byte_bpe.boundaries(points, first, width).tolist() for width in (1, 2, 7, 64, 10_000)]
    assert all(r == runs[0] for r in runs)


def test_long_pieces_and_texts(reference):
    rng = random.Random(2)
    began = time.time()
    word = "".join(rng.choice("abcdefghij") for _ in range(3_000))
    check([word, "x" * 3_000, " " * 3_001 + "a", "\n" * 500, "ab" * 1_000 + "é" * 700, "-=" * 900], reference)
    ids, first, offsets = pieces(["".join(rng.choice("abcdefghij") for _ in range(1_000_000)), "a" * 1_000_000, "word " * 400_000])
    assert offsets[-1] == len(ids) and time.time() - began < 90


def test_tokens_of_documents(spark, documents, texts, no_documents, reference):
    got = byte_bpe.digests(documents).collect()
    expected = collections.Counter()
    for i, text in texts:
        ids = reference.encode_ordinary(text or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in got) == expected
    assert byte_bpe.digests(no_documents).count() == 0
    back = collections.Counter((r["doc_id"], bytes(r["data"])) for r in byte_bpe.decoded(byte_bpe.encoded(documents)).collect())
    assert back == collections.Counter((i, (t or "").encode()) for i, t in texts)


def test_offsets_decode_any_run(documents, texts):
    of = dict(texts)
    known = byte_bpe.vocabulary(byte_bpe.RANKS)
    for r in byte_bpe.encoded(documents).filter("doc_id in (104, 111, 113)").collect():
        data, a, b = of[r["doc_id"]].encode(), len(r["ids"]) // 3, 2 * len(r["ids"]) // 3
        run = np.array(r["ids"][a:b])
        got = known.decoded(run, np.array(r["offsets"][a:b]), np.full(b - a, -r["offsets"][a]))
        assert got == data[r["offsets"][a]: r["offsets"][b]]


def test_cache_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 5)
    known = byte_bpe.Vocabulary(public_tokenizers.path(byte_bpe.RANKS))
    text = "one two three four five six seven eight nine ten " * 3
    ids, _, _ = known.encoded(text.encode(), np.array([0, len(text)]))
    assert len(known.cache) <= 5 and ids.tolist() == reference.encode_ordinary(text)
