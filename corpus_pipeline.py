"""The corpus pipeline: quality rules, language ID, near-duplicate removal, secret masking, sequence packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Stages decide on their own input alone.

Cases, of all stages: nulls may stand in any column; extra columns of any name stay; an empty table gives an empty one.
Rows that repeat stay repeated up to near_dedup, which leaves one row of each (doc_id, text); a doc_id with several texts
keeps those that are not copies. A null or empty text is rejected by the quality rules; where a stage gets one all
the same, language ID rejects it, near_dedup and secret_scan keep it, packing leaves it out. Texts of any length are
read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vignette.llm import langid, packing, quality, secrets, simhash
from vignette.llm.common import remove, scratch, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.bins(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: SQL expresses none of the compression, SimHash, network or packing decisions; tests/llm/test_pipeline.py compares run()
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the packed corpus. Stage results are Parquet in the shared folder; a stage's own tables go when it is
    written, its result when the next stage is."""
    base = scratch_path(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
