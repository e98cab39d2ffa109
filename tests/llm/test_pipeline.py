"""The pipeline's stages on a small table, each judged on its own input."""

import collections

import pytest

import corpus_pipeline
from foldwise.llm import near_dedup, secrets
from foldwise.llm.common import stored


def test_stages(spark, documents, tmp_path):
    folder = f"file://{tmp_path}"
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, out := stored(stage(spark, docs, folder), "stage"))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    before, after = seen["near_dedup"]
    kept = {r["doc_id"] for r in near_dedup.near_components(before).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["secrets"]
    assert before.count() == after.count() and secrets.scanned(after).filter("n_hex + n_access > 0").count() == 0
    assert collections.Counter(r["doc_id"] for r in after.collect()) == collections.Counter(r["doc_id"] for r in before.collect())
    assert seen["packing"][1].selectExpr("sum(length)").first()[0] > 0


CLASHING = ["tie", "_tie", "takes", "take", "__rows", "rows", "other", "document", "words", "n", "low", "high", "__set_high", "class", "one", "kept_id", "of_tie", "start", "a.b", "row", "block"]


def odd_table(spark, documents, rows):
    """The documents with columns of all names that stages use themselves, and a map."""
    columns = ", ".join(f"cast({i} as long) as `{c}`" for i, c in enumerate(CLASHING))
    return documents.select("doc_id", "text", "lang", "source", "n_chars").limit(rows).selectExpr("*", columns.split(", ")[0], *columns.split(", ")[1:], "map('k', doc_id) as labels_map")


@pytest.mark.parametrize("kind", ["empty", "null", "clashing"])
def test_stages_of_odd_tables(spark, documents, texts, tmp_path, kind):
    """Empty tables, tables of null texts, and columns of any name and type: every stage gives what it should."""
    folder = f"file://{tmp_path}"
    rows = odd_table(spark, documents, 0 if kind == "empty" else 1000)
    if kind == "null":
        rows = rows.withColumn("text", rows["text"].substr(1, 0).try_cast("int").cast("string"))
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), "stage")
        counts[name] = out.count()
        assert name == "packing" or out.columns == columns
        docs = out
    n = {"empty": 0}.get(kind, len(texts))
    # without labels nothing is toxic; null texts are nobody's copies and have no words to mix
    assert counts["toxicity"] == n and counts["secrets"] == counts["near_dedup"]
    if kind == "null":
        assert counts["near_dedup"] == n and counts["mixing"] == counts["packing"] == 0
    if kind == "clashing":
        assert 0 < counts["near_dedup"] < n and counts["mixing"] > 0 and counts["packing"] > 0
