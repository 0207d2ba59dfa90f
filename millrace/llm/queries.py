"""The queries over the driver's tables that apply each operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import html_text, mixing, multi_index, packing, quality, secret_scan, sharding, simhash, spotsigs, token_fst


THRESHOLD = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.shuffled(_table(spark, sf_dir, "documents"), 40, seed=20240229)
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long")
    return cut.select("doc_id", sharding.record_size("text").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    rated = quality.scored(docs, model)
    return rated.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "n_near", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_fst.count_tokens(docs, tokenizer_path())
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.col("secrets.base_sha256").alias("base_sha256"), F.col("secrets.spans_text").alias("spans"))


def domain() -> Column:
    """The top level of the mixing tree: a domain for each source, by the source's number."""
    number = F.try_to_number(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("999999")).cast("int") % 3
    return F.when(number == 0, "web").when(number == 1, "books").otherwise("reference")


#: Weights by path (domain, language, source); all others have 1.0.
MIX = {
    ("web",): 0.5, ("books",): 0.3, ("reference",): 0.2,
    **{(d, lang): w for d in ("web", "books", "reference") for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.2), ("es", 0.1))},
    ("web", "en", "src0"): 2.0,
}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chosen = mixing.mixed(docs, [domain(), F.col("lang"), F.col("source")], MIX, share=0.8, epochs=4, seed=7)
    return chosen.select(F.col("id").alias("doc_id"), "leaf", "epoch", "n_tokens")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_multi_index": op3_multi_index,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_spotsigs": op6_spotsigs,
    "op7_packing": op7_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text,
}

ORACLE: dict[str, str] = {}
