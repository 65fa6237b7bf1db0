"""The queries that apply each training-data operator to its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import oracle as license_oracle
from .spelling import ORACLE as SPELLING_ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read, write

    return read(write(_table(spark, sf_dir, "documents")))


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_trust import judge

    return judge(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op4_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vp_search import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    return read(write(_table(spark, sf_dir, "pages")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_trust": op1_url_trust,
    "op2_license_scan": op2_license_scan,
    "op4_vp_search": op4_vp_search,
    "op6_warc": op6_warc,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op5_ring_sharding": op5_ring_sharding,
    "op7_token_files": op7_token_files,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {"op2_license_scan": license_oracle(), "op11_spelling_variants": SPELLING_ORACLE}
