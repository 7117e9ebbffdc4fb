"""The registered queries of this package and the SQL they are checked against.

Every query runs its operator, with production parameters, over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, licenses, mixing, near_dedup, quality, sharding, token_counts, toxicity, url_filters
from .common import table

CATEGORIES = ["low_quality", "toxic"]
OVER = 4096


def vocabulary(name: str) -> bytes:
    """The content of a public vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.round_trip(docs, ranks, pattern())
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))


def chain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = toxicity.train(docs, chain_labels(spark, sf_dir), CATEGORIES)
    return toxicity.score(docs, models, CATEGORIES).select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], "toxic")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the row of ``labels`` that has their number: bad if of low quality or toxic."""
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("int"))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filters.judge(table(spark, sf_dir, "pages"), outcomes)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_url_filters": op4_url_filters,
    "op5_near_dedup": op5_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLE_SQL = {
    "op4_url_filters": url_filters.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op7_quality": quality.SQL,
    "op8_licenses": licenses.SQL,
    "op9_sharding": sharding.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
