"""The registered queries of the operators; each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import divergence, jaccard, license_scan, mixing, near_dedup, packing, quality, records, secret_scan, token_counts, top_k, toxicity, vector_codes
from tabsight.llm.common import keep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares of all sources; the copies in their shuffled order, with digests in place of the texts."""
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query
def op5_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows whose vec_id is divisible by 20 against all rows."""
    rows = keep(top_k.quantized(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k.top_k(rows, rows.where("vec_id % 20 = 0"))


@query
def op6_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("probability", F.round("probability", 4)).withColumn("similarity", F.round("similarity", 4))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


@query
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = records.token_files(table(spark, sf_dir, "documents"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))
