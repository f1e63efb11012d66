"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, pieces.

Null, empty and very long texts, null and repeated ids, repeated rows, empty tables and further columns of any name go
through all stages as their operators' docstrings say: rows with a null or empty text fail the quality rules, equal rows
are one group of near copies, of which one stays, and no stage tells rows apart by their id alone.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns of
documents. `run` writes every stage's rows as Parquet in the checkpoint folder and rereads them for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, pieces, quality, secrets, simhash
from tokenloom.llm.common import delete, new_folder, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id; ids may be missing or repeat."""
    return simhash.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text: how many, their digest, and whether decoding gives the text."""
    return pieces.encoded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secret_scan", secret_scan),
    ("encode_pieces", encode_pieces),
]

#: Fingerprints by XXH64 and their components, and pieces, are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written is deleted once the next one has read it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            delete(spark, before)
        before = folder
    return docs
