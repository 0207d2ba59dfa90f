"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, quality, secret_scan, simhash
from millrace.llm.queries import MIX, THRESHOLD, domain, tokenizer_path
from millrace.session import drop_written, ship, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the rules are learned from the labels."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, into="__quality").where(F.col("__quality") >= THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, in the target weights: short leaves are passed over up to four times, rich ones in part."""
    return mixing.select_mixed(docs, [domain(), F.col("lang"), F.col("source")], MIX, share=1.0, epochs=4, seed=7)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence of 1,024 tokens and its place there."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_redaction),
    ("source_mixing", source_mixing),
    ("best_fit_packing", sequence_packing),
]

#: The first stage learns a model and the others decode, hash and pack; SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a table goes when the next one is written."""
    ship(spark)
    before, docs = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)  # from here on its own table of pieces is read
    drop_written(docs)
    return packed
