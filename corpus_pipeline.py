"""From raw documents to packed sequences: quality, near duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet and reads
them again as the next one's docs. All stages but the last return the columns of documents.

Cases, in every stage: null and empty texts are documents like others (quality scores them, near_dedup takes the empty ones for copies
of one another, secrets finds nothing, mixture gives them their cell's rate, packing one piece with the end mark alone); very long texts
are taken whole; repeated rows are scored, redacted and drawn alike, and near_dedup keeps one of them; rows that tie are treated alike but
in near_dedup, where one of those with the least id stays; an empty table passes through; further columns pass through to the last stage,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apsis.llm import mixing, near_duplicates, packing, quality_classifier, secret_scan
from apsis.llm.common import materialize, temporary
from apsis.llm.queries import VOCABULARY, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality_classifier.accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every class of near duplicates, that with the least id. Rows without an id stay."""
    return near_duplicates.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; no document goes."""
    formats = secret_scan.learn(secret_scan.evidence(docs))
    clean = secret_scan.redact(docs, formats)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the target marginals."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixture", mixture), ("packing", packed)]

#: No stage is expressible in SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):  # what a stage writes on its way goes once its rows are written
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
