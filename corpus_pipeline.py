"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet and read again for the next
stage. All stages but the last return the columns of documents, whatever further ones there are.

Null texts count as empty: they are never toxic, nobody's copies, hold no secrets, have no words to mix (so they end at
mixing) and pack as none. Rows with null ids are rows like others, and learn and score like them but for labels, which need an
id. Rows repeated under one id are scored and cleaned one by one; near-dedup keeps one of equal or near rows and all of
rows without words; mixing and packing take what is left, each for itself. Ties go by the smaller id, then the other
columns. Further columns may have any names and types, maps included. Texts of any length are one row at a time. Empty tables give empty results, an empty table of labels none toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldwise.llm import mixing, near_dedup, packing, secrets, toxicity
from foldwise.llm.common import new_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the classifier learns from labelled documents of the input."""
    model = toxicity.fitted(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    return toxicity.scored(docs, model, keep=toxicity.LIMIT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies by shingles of four words, as op8: that with the smallest id, a null id only where no other is."""
    return near_dedup.deduplicated(docs, words=4)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.without_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: for each document and turn a row with the words that the mix takes."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their token ids."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the trained classifier, the draws of the mix and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
