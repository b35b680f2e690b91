"""Corpus pipeline: STAGES in order over documents; each stage's rows are written as Parquet and reread as the next one's docs.

The first four stages return the columns of documents and only take rows away (quality rules, near copies, contaminated documents) or
change text (personal data); the last packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadlake.llm import decontam, neardup, packing, pii, quality
from quadlake.llm.common import Work, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop(docs, table(spark, sf_dir, "benchmark"))


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.scrub(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("benchmark decontamination", decontaminate), ("personal data", scrub), ("best-fit packing", pack)]
#: Hashed likelihood ratios, boosted trees and tokenizers aren't SQL; tests/llm/ hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Work(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.put(docs)
    return docs
