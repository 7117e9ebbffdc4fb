"""The report over traces: edit counts, run sizes, timings, storage, correctness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(patches: DataFrame, *by: str) -> DataFrame:
    """Patches, and operations: one for each character deleted or inserted."""
    ops = F.coalesce("del", F.lit(0)) + F.char_length(F.coalesce("ins", F.lit("")))
    return patches.groupBy(*by).agg(F.count("*").alias("patch_count"), F.sum(ops).cast("long").alias("op_count"))


def run_sizes(records: DataFrame, *by: str) -> DataFrame:
    """The distribution of run lengths with nearest-rank percentiles; zeros without any run."""
    n = F.char_length("text").cast("long")
    sizes = records.where("kind = 'run'").withColumn("n", n)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)")
    found = sizes.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.min("n").alias("min"),
        rank(0.5).cast("long").alias("median"),
        rank(0.99).cast("long").alias("p99"),
        rank(0.995).cast("long").alias("p99_5"),
        rank(0.999).cast("long").alias("p99_9"),
        F.max("n").alias("max"),
        F.avg("n").alias("avg"),
    )
    return found.fillna(0)


def timings(times: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, population deviation in percent of it, smallest and largest."""
    mean = F.avg(value)
    return times.groupBy(*by).agg(mean.alias("mean"), (F.stddev_pop(value) * 100 / mean).alias("sd_percent"), F.min(value).alias("min"), F.max(value).alias("max"))


def rates(counted: DataFrame, seconds: str) -> DataFrame:
    """Operations and patches a second."""
    return counted.withColumns({"ops_per_s": F.col("op_count") / F.col(seconds), "patches_per_s": F.col("patch_count") / F.col(seconds)})


def storage(snapshots: DataFrame, texts: DataFrame) -> DataFrame:
    """Encoded and compressed bytes against the text's UTF-8 bytes; ``snapshots`` has doc_id, bytes and gzip_bytes."""
    plain = texts.select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"))
    size = F.octet_length("bytes").cast("long")
    joined = snapshots.select("doc_id", size.alias("encoded_bytes"), "gzip_bytes").join(plain, "doc_id")
    share = lambda c: F.when(F.col("text_bytes") > 0, F.col(c) / F.col("text_bytes"))
    return joined.withColumns({"encoded_ratio": share("encoded_bytes"), "gzip_ratio": share("gzip_bytes")})


def correctness(replayed: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, correct): whether the replayed text is the recorded one."""
    want = expected.select("doc_id", F.coalesce("text", F.lit("")).alias("want"))
    got = replayed.select("doc_id", F.col("text").alias("got"))
    return want.join(got, "doc_id", "left").select("doc_id", (F.coalesce("got", F.lit("")) == F.col("want")).alias("correct"))
