"""From raw documents to packed sequences: quality rules, near-dedup, secret redaction, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last give
the columns that they get, extra ones included, whatever their names. Null texts are rejected by the first stage, as having no words, and count as empty in
the others. Null doc_ids, repeated rows, very long texts and empty tables pass through all stages; what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import op3_near_dedup, op4_quality_rules, op6_pack, op8_secrets, op10_mix
from tracewright.llm.common import documents, materialise, release, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ledger of rules the current policy keeps. Each row is judged alone: null ids like others, repeated rows alike, texts whole."""
    small_batches(spark)
    return op4_quality_rules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that of the least doc_id, a null one only where the group has no other. Repeated rows
    of it go; texts without words stay, one row for each id and text."""
    small_batches(spark)
    return op3_near_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced, and n_chars to match. Each row alone; null texts stay null."""
    small_batches(spark)
    return op8_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an order that interleaves sources by their target weights; the order of files and of the rows in them carries it to the next stage. A null
    source is one of its own; repeated rows stand together."""
    return op10_mix.interleaved(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: windows of the mixed order follow one another, and the curve orders documents within each. Null texts are the end id
    alone."""
    small_batches(spark)
    return op6_pack.pack_mixed(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Sketches, tokenisation and packing order are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
