"""The corpus pipeline: quality rules, line dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns the pieces of packed sequences.

Defined cases, of all stages: columns other than doc_id and text are carried along under whatever names; a row that
occurs twice is judged twice, alike; an empty table stays empty. Null ids and texts are as each stage says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import decontaminate, line_dedup, near_dedup, packing, quality
from trellis.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go: null, empty and blank texts among them, for want of words."""
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts, and documents of which nothing is left. Null and empty texts
    have no lines and stay; a null id counts as the first of all."""
    return line_dedup.clean_documents(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays. Texts without words
    have no duplicates; rows without an id go where their group has one, and else stay."""
    return near_dedup.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Null texts hold none; items without words or no items take nothing out."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. A null text is its end token alone; long texts are cut into pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", decontaminate_documents),
    ("packing", pack_documents),
]
#: Near duplicates and token packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
