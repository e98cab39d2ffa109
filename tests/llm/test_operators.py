"""Each operator against a brute-force version on a small table with all odd cases."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from foldwise.llm import common, media, mixing, near_dedup, packing, quality, secrets, substring_dedup, toxicity, url_filter, vector_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(frame, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in frame.collect())


# quality and toxicity

def labelled(spark, n=900):
    """Junk and prose, some with insults; a third without labels."""
    rng = random.Random(3)
    from tests.llm.conftest import prose

    rows, labels = [], []
    for i in range(n):
        text, good, toxic = prose(rng, rng.randint(30, 90)), 1, 0
        if i % 5 == 0:
            text, good = " | ".join(text.split()), 0
        if i % 4 == 1:
            text, toxic = text + " " + rng.choice(["zqidiot", "zqscum"]) + " " + prose(rng, 9), 1
        rows.append((i, text))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string")
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("run,target", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_on_held_out(spark, run, target):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in run(docs, labels).collect()}
    truth = {r["doc_id"]: r[target] for r in labels.groupBy("doc_id").agg(F.max(target).alias(target)).collect() if r[target] is not None}
    assert len(got) == docs.count() and all(r["held_out"] == held(i) for i, r in got.items())
    tested = [i for i in truth if i in got and held(i)]
    assert sum(got[i]["predicted"] == truth[i] for i in tested) / len(tested) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_classifiers_on_odd_tables(spark, run, documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert run(documents, labels).count() == documents.count()
    assert run(documents, labels.filter("false")).count() == documents.count()
    assert run(no_documents, labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = labelled(spark, 300)
    other = labels.withColumn("quality", F.when(common.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_row(quality.quality(docs, labels), "doc_id", "score") == by_row(quality.quality(docs, other), "doc_id", "score")


def test_trees_row_by_row():
    """The flattened trees against a walk of each row down each tree, and against labels that two statistics decide."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, len(quality.STATISTICS))).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    forest = quality.Forest(x[:1000], y[:1000])
    got = forest.score(x)
    for row, score in zip(x[::50], got[::50], strict=True):
        total = forest.base
        for t in range(quality.TREES):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + bool(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - ((1 << quality.DEPTH) - 1)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((got[1000:] >= 0.5) == y[1000:]).mean() > 0.95


def test_ftrl_coordinate_by_coordinate():
    """Against the update written out for each coordinate."""
    rng = random.Random(4)
    rows = [sorted(rng.sample(range(64), rng.randint(1, 12))) for _ in range(300)]
    labels = [float(3 in r or 9 in r) for r in rows]
    z, n, bias = [0.0] * 65, [0.0] * 65, 64

    def weight(i):
        bound = 0.0 if i == bias else toxicity.L1
        if abs(z[i]) <= bound:
            return 0.0
        return -(z[i] - (bound if z[i] > 0 else -bound)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for r, y in zip(rows, labels, strict=True):
            used = [*r, bias]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in used:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    at, w, b = toxicity.ftrl([np.array(r) for r in rows], np.array(labels), bits=6, passes=3)
    assert {int(i): pytest.approx(v) for i, v in zip(at, w, strict=True)} == {i: weight(i) for i in range(64) if weight(i)} and b == pytest.approx(weight(bias))


def test_learning_is_bounded_where_ids_repeat(spark):
    from tests.llm.conftest import prose

    rng = random.Random(11)
    docs = spark.createDataFrame([(i % 40, prose(rng, 20)) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == toxicity.toxicity(docs, labels).count() == 4000


# secrets

def brute_base(text):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_base_spans(documents, texts, no_documents):
    want = collections.Counter()
    for i, t in texts:
        spans = brute_base(t or "")
        kinds = [k for _, k, _ in spans]
        want[i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(secrets.joined(spans).encode()).hexdigest()] += 1
    assert by_row(secrets.scanned(documents), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert secrets.scanned(no_documents).count() == 0


@pytest.mark.parametrize("text,found", [
    ('db_password = "Tr0ub4dor&3x"', ["Tr0ub4dor&3x"]),
    ('part = "q9W8e7R6t5"\nclient_secret = part', ["q9W8e7R6t5"]),
    ('{"apiKey": "Zk3l9-Qm2v7"}', ["Zk3l9-Qm2v7"]),
    ('a = "hunter2Xy9"\nb = a\nauth_token = "pre" + b', ["hunter2Xy9"]),
    ('password_hint = "your first pet"', []), ('secret = "changeme"', []), ('title = "q9W8e7R6t5"', []), ("see: https://example.com/x", []), ("", [])])
def test_secret_lexer(text, found):
    assert [text[a:b] for a, k, b in secrets.spans_of(text) if k == 3] == found


@pytest.mark.parametrize("text,found", [
    ('conn = "Server=db;Uid=app;Pwd=9fKq-27Zx"', "9fKq-27Zx"),
    ("JAVA_OPTS: -Ddb.pwd=9fKq-27Zx", "9fKq-27Zx"),
    ('JAVA_OPTS: "-Xmx1g -Ddb.pwd=9fKq-27Zx -Dx=y"', "9fKq-27Zx"),
    ("env: PWD=9fKq-27Zx", "9fKq-27Zx"),
    ("url = 'https://db.example/x?user=app&passphrase=9fKq-27Zx&n=1'", "9fKq-27Zx"),
    ("body = '{\"user\": \"app\", \"credential\": \"9fKq-27Zx\"}'", "9fKq-27Zx"),
    ('body = "{\\"private_key\\": \\"9fKq-27Zx\\"}"', "9fKq-27Zx")])
def test_secrets_inside_literals(text, found):
    assert found in [text[a:b] for a, k, b in secrets.spans_of(text) if k == 3]


@pytest.mark.parametrize("text,found", [
    ("db_passphrase" + " " * 5000 + '= "Zk3l9Qm2v7pp"', "Zk3l9Qm2v7pp"),
    ("db_passphrase:\n    Zk3l9Qm2v7pp\nport: 80", "Zk3l9Qm2v7pp"),
    ("db_passphrase: |\n  Zk3l9Qm2v7pp\n", "Zk3l9Qm2v7pp"),
    ('PWD = """Zk3l9Qm2v7pp"""', "Zk3l9Qm2v7pp"),
    ('<add key="db_passphrase" value="Zk3l9Qm2v7pp"/>', "Zk3l9Qm2v7pp"),
    ("<credential>Zk3l9Qm2v7pp</credential>", "Zk3l9Qm2v7pp"),
    ("settings['db_passphrase'] = 'Zk3l9Qm2v7pp'", "Zk3l9Qm2v7pp"),
    ('"wifi passphrase": "correct horse battery staple"', "correct horse battery staple"),
    ("Authorization: Bearer Zk3l9Qm2v7pp", "Zk3l9Qm2v7pp"),
    ("dsn = 'postgres://app:Zk3l9Qm2v7pp@db/x'", "Zk3l9Qm2v7pp"),
    ("x" * 300 + '_pwd = "Zk3l9Qm2v7pp"', "Zk3l9Qm2v7pp"),
    ('#define PRIVATE_KEY "Zk3l9Qm2v7pp"', "Zk3l9Qm2v7pp"),
    ("setenv AUTH_CREDENTIAL Zk3l9Qm2v7pp", "Zk3l9Qm2v7pp"),
    ("curl --auth-credential Zk3l9Qm2v7pp --x", "Zk3l9Qm2v7pp"),
    ('config.set("api_credential", "Zk3l9Qm2v7pp")', "Zk3l9Qm2v7pp"),
    ('PRIVATE_KEY <- "Zk3l9Qm2v7pp"', "Zk3l9Qm2v7pp"),
    ('def f(auth_key: str = "Zk3l9Qm2v7pp"):', "Zk3l9Qm2v7pp"),
    ('credentials: ["Zk3l9Qm2v7pp"]', "Zk3l9Qm2v7pp"),
    ('private_key[] = {"Zk3l9Qm2v7pp"};', "Zk3l9Qm2v7pp"),
    ("credentials = [\n  'none',\n  'Zk3l9Qm2v7pp',\n]", "Zk3l9Qm2v7pp"),
    ('x = os.environ.get("PRIVATE_KEY", "Zk3l9Qm2v7pp")', "Zk3l9Qm2v7pp")])
def test_secrets_in_many_syntaxes(text, found):
    assert [text[a:b] for a, k, b in secrets.spans_of(text) if k == 3] == [found]


@pytest.mark.parametrize("text", [
    'passphrase = "aaaaaa"', "pwd: string", "passphrase: required", 'title = "Reset of passwords"', "credential:\n  kind: basic", "pwd_length = 123456789",
    "The passphrase: please choose one.", 'credentials: {"username_field": "plain"}', "--color Zk3l9Qm2v7pp", 'f("color", "Zk3l9Qm2v7pp")', 'pwd = "changeme"', 'color = "Zk3l9Qm2v7pp"', "pass: ${FROM_ENV}"])
def test_no_secrets(text):
    assert not [text[a:b] for a, k, b in secrets.spans_of(text) if k == 3]


def test_secrets_among_settings():
    """Precision and recall over settings in many forms, each with a name that is sensitive or not and a value that is secret or not."""
    rng = random.Random(3)
    forms = ["{n} = \"{v}\"", "{n}: {v}", "{n}={v}", "export {n}='{v}'", "'{n}': '{v}',", "  \"{n}\"   :   \"{v}\",", "{n} := `{v}`", "<{n}>{v}</{n}>",
             "<add name='{n}' value='{v}'/>", "o.{n} = '{v}';", "let {n} = x || '{v}'; const y = 1", "{n} =>\n    '{v}'", "-D{n}={v}", "{n}:\n  {v}"]
    sensitive = ["db_passphrase", "PWD", "adminPwd", "CREDENTIALS", "auth_pass", "signingSecretValue", "PRIVATE_KEY"]
    plain = ["color", "host_name", "region", "maxItems", "pass_length", "key_file", "title"]
    lines, want, at = [], set(), 0
    for _ in range(3000):
        form, hot, fine = rng.choice(forms), rng.random() < 0.5, rng.random() < 0.7
        value = "".join(rng.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRST23456789_") for _ in range(rng.randint(10, 30))) if fine else rng.choice(["none", "aaaaaaa", "required", "xxxxxxxx", "${FROM_ENV}"])
        line = form.format(n=rng.choice(sensitive if hot else plain), v=value) + "\n"
        if hot and fine:
            start = at + line.rindex(value, 0, line.rindex("</") if "</" in line else None)
            want.add((start, start + len(value)))
        lines.append(line)
        at += len(line)
    got = {(a, b) for a, b in ((a, b) for a, k, b in secrets.spans_of("".join(lines)) if k == 3)}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.97 * len(got), (len(want), len(got), len(want & got))


def test_secrets_in_long_texts():
    """Time grows with the text: blanks, operators, open quotes and tags, and one long word, of a million characters and more."""
    began = time.time()
    for unit in (" ", "=", "a=", "a='", "<a ", '\"', "a:\n ", "[a", "pwd=b ", "x", "://a:", 'a="""', "'a' 'b': "):
        secrets.spans_of(unit * (1_000_000 // len(unit)) + ' pwd = "Zk3l9Qm2v7pp"')
    assert time.time() - began < 60


@pytest.mark.parametrize("before,run,after", [
    ("<a ", "x", "> b=c"), ("<", "a", ""), ("<a b='", "x", "'>"), ("<a ", " ", "="), ("#define ", "A", ""), ("--", "a", " b"), ("f(\"", "a", "\","),
    ("pwd = [", "\"a\", ", ""), ("pwd: x = ", "(", ""), ("AKIA", "A", ""), ("", "0", "g"), ("token", " ", "x"), ("://", "a", ":b@"), ("pwd = '", "\\x", ""),
    ("pwd = ", "a+", ""), ("passphrase: ", "ab-", ""), ("<a ", "b ", ">"), ("", "pwd<- ", ""), ("", "--pwd a ", ""), ("", "(\"pwd\",", ""), ("", "pwd = [\"", "")])
def test_secrets_of_long_runs(before, run, after):
    """Every pattern on a megabyte of what it repeats."""
    began = time.time()
    secrets.spans_of(before + run * (1_000_000 // len(run)) + after + " = :")
    assert time.time() - began < 20


def test_secrets_go(spark, documents):
    clean = secrets.without_secrets(documents)
    assert clean.columns == documents.columns and clean.count() == documents.count()
    assert secrets.scanned(clean).filter("n_hex + n_access > 0").count() == 0


# embeddings

@pytest.mark.parametrize("group", [vector_dedup.GROUP, 300])  # 300: most leaves are split on by Spark, the hot one into blocks
def test_vectors_against_all_pairs(spark, group):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2500, 16))
    near = base[:400] + rng.normal(size=(400, 16)) * 0.12
    hot = base[0] + rng.normal(size=(700, 16)) * 0.02
    x = np.concatenate([base, near, hot, np.repeat(base[5:6], 50, 0)])
    rows = [(i, v.astype(np.float32).tolist(), int(i % 7 != 0)) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1), (5004, x[0].tolist(), None), (5005, [], 1), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("mine"))
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(frame, group=group).collect()}
    assert len(got) == len(rows) and got[5006]["n_links"] == 1 and got[5007]["component_id"] == 5006
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(5000, 5006))
    y = np.float32(x).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows[: len(x)]])
    link = (y @ y.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    want = link.sum(1)
    have = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    assert all(got[i]["component_id"] <= i for i in range(len(x)))
    assert vector_dedup.near_vectors(frame.filter("false"), group=group).count() == 0


# packing

def test_packing_round_trip(documents, texts, no_documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in texts)
    rows = packing.packed(documents, with_ids=True).orderBy("sequence_id").collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    got, ids = collections.Counter(), []
    for r in rows:
        assert r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["length"] <= 2048
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["start"] == len(ids)
        ids += r["ids"]
        if len(ids) == r["doc_tokens"]:
            got[r["doc_id"], tuple(ids)] += 1
            ids = []
    assert got == want
    assert packing.packed(no_documents).count() == 0


# substrings

def test_substrings_against_counting(documents, texts, no_documents, monkeypatch):
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    counts = collections.Counter(tuple(w[j: j + 35]) for _, w in words for j in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if counts[tuple(w[j: j + 35])] > 1:
                gone[j: j + 35] = [True] * 35
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    for most in (1000, 0):  # 0: all buckets are counted by aggregation
        monkeypatch.setattr(substring_dedup, "MOST_STRINGS", most)
        assert by_row(substring_dedup.deduplicated(documents), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.deduplicated(no_documents).count() == 0


def test_substrings_under_odd_ids_and_of_long_words(spark, monkeypatch):
    rng = random.Random(8)
    from tests.llm.conftest import prose

    passage, long_word = prose(rng, 40), "x" * 300_000
    texts = [(None, f"{prose(rng, 20)} {passage} {prose(rng, 5)}"), (None, f"{prose(rng, 9)} {passage}"), (None, prose(rng, 60)),
             (7, f"{prose(rng, 50)} {passage}"), (7, prose(rng, 45)), (7, prose(rng, 45)), (7, None), (8, ""), (None, None),
             (9, f"{long_word} {passage} a {long_word} b"), (10, f"c {long_word} {passage} a {long_word} d")]
    texts += [texts[2], texts[4]]
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    counts = collections.Counter(tuple(w[j: j + 35]) for _, w in words for j in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = set().union(*(range(j, j + 35) for j in range(len(w) - 34) if counts[tuple(w[j: j + 35])] > 1))
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for most in (1000, 0):
        monkeypatch.setattr(substring_dedup, "MOST_STRINGS", most)
        assert by_row(substring_dedup.deduplicated(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == want


# mixing

def test_mix(documents, texts, no_documents):
    rows = mixing.mix(documents, block=8).collect()
    sizes = collections.Counter()
    for i, t in texts:
        sizes[None if i % 9 == 0 else f"s{i % 4}"] += len(WORD.findall(t or ""))
    assert sum(r["size"] for r in rows) == sum(sizes.values()) and len(rows) == len(texts)
    want = dict(zip(order := sorted(sizes, key=lambda s: (s is None, s or "")), mixing.targets([sizes[s] for s in order]), strict=True))
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s in order:
        assert abs(taken[sizes[s]] - want[s]) <= 0.02 * want[s] + 16
    assert by_row(mixing.mix(documents, block=8), "doc_id", "taken") == by_row(mixing.mix(documents.repartition(7), block=8), "doc_id", "taken")
    assert mixing.mix(no_documents).count() == 0


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    got = mixing.targets([100, 1000, 1000])
    assert got == [200, pytest.approx((3150 - 200) / 3), pytest.approx((3150 - 200) * 2 / 3)]


def test_permutation():
    for n in (1, 2, 7, 100):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mix_row_by_row(spark):
    """Every slot's words, laid out and counted in plain Python, and texts rebuilt from them."""
    from tests.llm.conftest import prose

    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(1, 70)), "abc"[i % 3] if i % 7 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    block = 8
    placed, plan, sources = mixing.laid_out(docs, block)
    slots = mixing.drawn_slots(spark, plan).collect()
    order = {r["source_no"]: r["source"] for r in sources.collect()}
    number = {r["doc_id"]: (r["source_no"], r["start"]) for r in placed.collect()}
    streams = collections.defaultdict(dict)
    for i, text, source in rows:
        no, start = number[i]
        assert order[no] == source
        for k, word in enumerate(text.split()):
            assert start + k not in streams[no]
            streams[no][start + k] = (i, word)
    assert all(sorted(s) == list(range(len(s))) for s in streams.values())
    taken, words = collections.Counter(), collections.defaultdict(collections.Counter)
    per_block = collections.Counter((r["source_no"], r["block"]) for r in slots)
    assert max(per_block.values()) <= 2
    for r in slots:
        for at in range(r["block"] * block, (r["block"] + 1) * block):
            if at in streams[r["source_no"]]:
                i, word = streams[r["source_no"]][at]
                taken[i] += 1
                words[i][word] += 1
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block).collect()} == {i: taken[i] for i, _, _ in rows}
    got = collections.defaultdict(collections.Counter)
    for r in mixing.mixed_documents(docs, block).collect():
        got[r["doc_id"]].update(r["text"].split())
    assert got == words


def test_rows_under_one_id_are_mixed_apart(spark):
    """One text under one id in two sources: each source's words are its own."""
    from tests.llm.conftest import prose

    text = prose(random.Random(3), 200)
    rows = [(1, text, "s1", 5), (1, text, "s2", 5), (1, text, "s2", 6), (2, text + " more", "s2", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note long")
    out = collections.Counter()
    for r in mixing.mixed_documents(docs, block=8).collect():
        out[r["doc_id"], r["source"]] += len(r["text"].split())
    sizes = {("s1"): 200, ("s2"): 601}
    taken = {r["source_size"]: 0 for r in mixing.mix(docs, block=8).collect()}
    for r in mixing.mix(docs, block=8).collect():
        taken[r["source_size"]] += r["taken"]
    assert sum(n for (_, s), n in out.items() if s == "s1") == taken[sizes["s1"]] and sum(n for (_, s), n in out.items() if s == "s2") == taken[sizes["s2"]]


def test_mixed_documents_hold_what_the_mix_takes(documents):
    out = mixing.mixed_documents(documents, block=8)
    assert out.columns == documents.columns
    words = collections.Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    taken = collections.Counter()
    for r in mixing.mix(documents, block=8).collect():
        taken[r["doc_id"]] += r["taken"]
    assert +words == +taken


# near copies

@pytest.mark.parametrize("words", [4, 5])
def test_near_copies_against_all_pairs(documents, texts, no_documents, words):
    sets = []
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j: j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s:
            least[root(k)] = min(i, least.get(root(k), i))
    want = collections.Counter((i, len(s), least[root(k)] if s else i, i == (least[root(k)] if s else i)) for k, (i, s) in enumerate(sets))
    assert by_row(near_dedup.near_components(documents, words), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dedup.near_components(no_documents).count() == 0
    assert near_dedup.deduplicated(documents).columns == documents.columns


def test_near_copies_in_chains_and_large_groups(spark):
    """Each text differs from the next by a word, so only neighbours are linked; and many variants of one text."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(40):
        words[(i * 7) % 60] = f"new{i}"
        rows.append((i, " ".join(words)))
    base = [f"v{j}" for j in range(80)]
    for i in range(300):
        one = list(base)
        one[rng.randrange(80)] = f"x{i}"
        rows.append((1000 + i, " ".join(one)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_near_pairs_in_buckets_of_one_passage(spark):
    """Many texts share most of their words with each other without being linked; pairs among them are all found."""
    rng = random.Random(8)
    passage = [f"p{j}" for j in range(140)]
    rows = []
    for i in range(120):
        own = [f"t{i}w{j}" for j in range(34)]
        rows.append((2 * i, " ".join(passage + own)))
        own[rng.randrange(30, 34)] = "other"
        rows.append((2 * i + 1, " ".join(passage + own)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i - i % 2 for i in range(240)}


def test_pairs_at_the_limit(spark):
    """Of 1,500 pairs at 80 to 82 % nearly all are linked, those just below are not."""
    rng = random.Random(12)
    rows, want = [], []
    for i in range(1500):
        one = [f"a{rng.randrange(10**9)}" for _ in range(124)]
        same = 111 if i % 3 else 110
        two = one[:same] + [f"b{rng.randrange(10**9)}" for _ in range(124 - same)]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
        want += [2 * i, 2 * i if i % 3 else 2 * i + 1]
    a, b = (near_dedup.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for _, t in rows[2:4])
    assert 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) <= 0.82
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    wrong = sum(got[i] != want[i] for i in range(3000))
    assert wrong <= 3 and not any(got[2 * i + 1] != 2 * i + 1 for i in range(0, 1500, 3))


def test_many_short_texts_of_one_form(spark):
    """Title pages that share four of five words meet in large buckets and are nobody's copies."""
    rows = [(i, f"chapter one of book b{i}") for i in range(9000)] + [(9000, "Chapter ONE of book b17"), (9001, "chapter one of book b17 b17")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4).collect()}
    assert got == {**{i: i for i in range(9000)}, 9000: 17, 9001: 9001}


def test_exact_prefixes(spark):
    """All links across components are among the pairs of prefixes, and pairs are far fewer than all."""
    rng = random.Random(6)
    rows = []
    for g in range(6):
        base = [f"g{g}w{j}" for j in range(60)]
        for i in range(50):
            cut = rng.randrange(0, 9)
            rows.append((len(rows), len(rows) // 3, " ".join(base[cut:] + [f"u{len(rows)}x{j}" for j in range(rng.randrange(14))])))
    texts = spark.createDataFrame(rows, "node long, component long, text string").repartition(3)
    counts = near_dedup.frequencies(texts, 1)
    assert counts.sum() == sum(len(t.split()) for _, _, t in rows)
    got = [(r["a"], r["b"]) for r in near_dedup.prefix_pairs(near_dedup.prefixes(texts, 1, counts)).collect()]
    sets = [set(t.split()) for _, _, t in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if rows[a][1] != rows[b][1] and (len(sets[a]), a) < (len(sets[b]), b)
            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and want <= set(got) and 0 < len(want) and len(got) < 6 * 50 * 49 / 2
    links = near_dedup.confirmed(spark.createDataFrame(got, "a long, b long"), texts, 1)
    assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_deduplicated_by_row(spark):
    """Null ids, rows repeated under one id and other texts under it."""
    rng = random.Random(9)
    from tests.llm.conftest import prose

    a, b, c, d, e = (prose(rng, 40) for _ in range(5))
    rows = [(1, a, "x"), (1, a, "y"), (None, a, "x"), (2, a, "x"), (2, b, "x"), (None, c, "x"), (None, c, "w"), (None, d, "x"), (3, e, "x"), (3, e, "x"),
            (None, "", "x"), (None, None, "x"), (4, " ", "x"), (4, " ", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = [(1, a, "x"), (2, b, "x"), (None, c, "w"), (None, d, "x"), (3, e, "x"), (None, "", "x"), (None, None, "x"), (4, " ", "x"), (4, " ", "x")]
    got = near_dedup.deduplicated(frame)
    assert got.columns == frame.columns and by_row(got, *frame.columns) == collections.Counter(want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent}


# urls

def test_urls_against_rules(spark):
    rng = random.Random(6)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "x.net", "net", "anet", "com", "b.org", "EXAMPLE.COM", "..com", "x.net:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/2?x=/fr/", "/fr/#a", "?q=/en/", "#/es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b://c/en/", "http://example.com/en/\nx"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")]
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.RULES)
    rules = spark.sql(f"select * from values {values} as r(action, host, path)")
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    want = collections.Counter()
    for i, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want[i, host, path, best[1], best[2]] += 1
    assert by_row(url_filter.url_verdicts(pages, rules), "page_id", "host", "path", "rule", "verdict") == want
    assert url_filter.url_verdicts(pages.filter("false"), rules).count() == 0
    assert url_filter.url_verdicts(pages, rules.filter("false")).filter("verdict = 'allow'").count() == len(rows)
    del rng


def test_cascade_is_exact(spark):
    """Many listed keys among many others: every key of the universe is judged right."""
    universe = spark.range(20000).select(F.concat(F.lit("key"), "id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(7)) == 0).alias("listed"))
    levels = url_filter.cascade(universe)
    assert len(levels) > 2
    assert universe.filter(url_filter.listed(levels, F.col("key")) != F.col("listed")).count() == 0


# media

def test_media_round_trip(spark, documents, texts, no_documents):
    folder = common.new_folder(spark, "media-test")
    rows = media.media_columns(documents, folder).collect()
    want = collections.Counter()
    for i, t in texts:
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        want[i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    system, root = fs.FileSystem.from_uri(folder)
    for r in rows:
        with system.open_input_file(f"{root}/{r['shard']}") as f:
            members = media.unpacked(f.read())
        image = members[r["payload_sha256"]]
        assert len(image) == r["media_bytes"] and hashlib.sha256(image).hexdigest() == r["media_sha256"]
        assert (r["width"], r["width"] * r["height"], r["bits"]) == (576, r["payload_bytes"], 8)
    same = {(r["payload_sha256"], r["media_sha256"], r["feature"], r["offset"]) for r in rows if r["doc_id"] in (100, 101)}
    assert len(same) == 1
    assert media.media_columns(no_documents, common.new_folder(spark, "media-none")).count() == 0
