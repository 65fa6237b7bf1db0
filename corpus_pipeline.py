"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns
of documents. Each stage's rows are written as Parquet and read again as the next one's documents.

Edge cases: language_id drops null texts and texts without a letter, so the later stages see texts with letters only;
rows with null ids pass; very long texts are judged whole in every stage. near_dedup keeps one row of equal rows and of
equal ids with near texts, the smallest by id, then by all columns. decontamination keeps every document where the
benchmark is empty or null. packing cuts only documents that are longer than a sequence. An empty table, or one of nulls
alone, gives an empty result. Extra columns pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from smoothlake.llm._common import staged
from smoothlake.llm.decontaminate import keep_clean
from smoothlake.llm.language_id import keep_identified
from smoothlake.llm.near_dedup import keep_first
from smoothlake.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; those rejected go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, placed in sequences."""
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: No stage can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
