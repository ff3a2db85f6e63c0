"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, mixing, packing.

Every stage takes (spark, docs, sf_dir), sees all rows its predecessor kept, and is written as Parquet in the shared
folder before the next one reads it. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillwave.llm import language, mixing, neardup, packing, secrets
from rillwave.llm.common import stored, table
from rillwave.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language, between two of them as well; those without letters go."""
    ship(spark)
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    ship(spark)
    return neardup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Overwrite secrets in the texts; no document goes."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as its source's target asks for."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences: one row per piece."""
    ship(spark)
    return packing.pieces(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix),
          ("pack", pack)]

#: Tokenisation is beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


run.__name__ = "pipeline"
