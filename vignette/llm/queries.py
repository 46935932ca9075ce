"""The queries of this subpackage: one per operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, byteconv, crosspoly, htmlcut, langid, packing, quality, secrets, simhash, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return byteconv.classify(docs, byteconv.fit(docs, _read(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files, some 6 % of the records damaged on the way, and what the salvage reader gets
    back; the quarantined gaps are logged as a table beside the files."""
    return warc.recovered(*warc.round_trip(_read(spark, sf_dir, "pages")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.contents(_read(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is indexed; the rows whose id is divisible by 20 are the queries."""
    return crosspoly.neighbours(_read(spark, sf_dir, "embeddings"), every=20)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.bins(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op")}


#: Kinds 1 and 2 of damage() lose the record; kind 3 only adds bytes after it.
_OP5 = """
SELECT page_id, url, html FROM pages
WHERE NOT coalesce(substr(md5(CAST(page_id AS VARCHAR)), 1, 2) < '0c', false)
"""


def oracle_sql() -> dict[str, str]:
    """SQL expresses none of the other operators; tests/llm compares them with brute force."""
    return {"op5_warc": _OP5}
