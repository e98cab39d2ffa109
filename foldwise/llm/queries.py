"""Queries of this subpackage, by the names that __spark_entry__ registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwise.llm import (
    byte_bpe, media, mixing, near_dedup, packing, quality, secrets, substring_dedup, toxicity, url_filter, vector_codes, vector_dedup, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.query,
    "op2_secret_scan": secrets.query,
    "op3_toxicity": toxicity.query,
    "op4_vector_dedup": vector_dedup.query,
    "op5_packing": packing.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_mixing": mixing.query,
    "op8_near_dedup": near_dedup.query,
    "op9_url_filter": url_filter.query,
    "op10_media_columns": media.query,
    "op11_whitening": whitening.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLES: dict[str, str] = {"op9_url_filter": url_filter.ORACLE}
