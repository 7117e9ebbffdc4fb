"""Mixing sources to target weights along a time-varying curriculum.

A document's size is its number of words.  Sources, in code-point order with null
last, weigh 3, 1, 2, repeating, and share 150 % of all words; a source's target
stops at twice its size, and what is above goes to the others by weight until none
is above (water-filling, in closed form over the sources sorted by their limits).

Each source has a weight schedule over training time 0 to 1, here linear: its rate
is target * (1 + slope * (2t - 1)), slope by the source's place in the weights.
The integral of the schedule is the source's cumulative demand.  A source's
documents, in a fixed pseudo-random order, fill that demand one after the other,
as often as needed; inverting the integral at the words before a use of a document,
those of earlier passes included, gives that use's training position, and the result
is range-sorted by position.  The last document of a source's last pass is taken in
part, so that targets are met to the word.

Only built-in expressions run.  The running totals are made in two levels: sums of
hash buckets of about ``BUCKET`` documents, then within buckets; so a source with
a third of all rows is dealt like the others, and so are rows that share an id or have none, whose bucket is cut into pieces.  The plan reads texts once and never
shuffles them; the mix writes the rows once with numbers and joins positions back by
these, so rows that share an id, or have none, are each used by their own plan.  Nulls
and empty texts have size 0 and are not taken; repeated rows count each; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HOT_KEYS, WORD, fresh, written

WEIGHTS = (3, 1, 2)
#: Change of a source's rate over time, by place in the weights: heavy sources early, light ones late.
SLOPES = (-0.5, 0.5, 0.0)
#: Documents that a bucket of the running totals has on average, at most.
BUCKET = 4096
#: Up to this many sources are broadcast (about 60 bytes each); beyond, the join is shuffled.
BROADCAST_SOURCES = 20_000

#: Targets in SQL that Spark and DuckDB both run; ``sources`` has source, source_size, n_docs.
TARGETS = f"""
ranked AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS place FROM sources),
weighed AS (SELECT *, CASE place WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight,
  CASE place WHEN 0 THEN {SLOPES[0]!r}e0 WHEN 1 THEN {SLOPES[1]!r}e0 ELSE {SLOPES[2]!r}e0 END AS slope FROM ranked),
ordered AS (SELECT *,
  sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source_size * 6 / weight, source ASC NULLS LAST) AS nth,
  coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 6 / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limits_before,
  sum(weight) OVER (ORDER BY source_size * 6 / weight DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weights_from
  FROM weighed),
first_free AS (SELECT min(nth) AS nth FROM ordered WHERE (3 * total - 2 * limits_before) * weight <= 4 * source_size * weights_from),
level AS (SELECT 3 * total - 2 * limits_before AS twice_rest, weights_from AS rest_weight FROM ordered WHERE nth = (SELECT nth FROM first_free)),
targets AS (SELECT source, source_size, n_docs, weight, slope,
  CASE WHEN nth < coalesce((SELECT nth FROM first_free), nth + 1) THEN 2e0 * source_size
    ELSE CAST((SELECT twice_rest FROM level) * weight AS DOUBLE) / (2e0 * (SELECT rest_weight FROM level)) END AS target
  FROM ordered)
"""


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes_of(docs: DataFrame, row: Column, size: Column) -> DataFrame:
    return docs.select(
        row.alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
    )


#: Training time in [0, 1) at which a source's cumulative demand is the share ``u`` of its target.
POSITION = "2e0 * u / ((1e0 - slope) + sqrt((1e0 - slope) * (1e0 - slope) + 4e0 * slope * u))"


def dealt(sizes: DataFrame) -> DataFrame:
    """(row, doc_id, size, source_size, target, slope, before, taken, copies) for every row of ``sizes``, a written table.

    ``before`` counts the words of the source that a pass takes before the document.
    """
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = written(spark.sql(f"WITH sources AS (SELECT * FROM {{sources_df}}), {TARGETS} SELECT * FROM targets", sources_df=sources), "targets")
    # The number of buckets is a power of two that follows the source's rows.
    targets = targets.withColumn("shift", F.expr(f"60 - greatest(0, ceil(log2(n_docs / {BUCKET}d)))").cast("int")).withColumnRenamed("source", "own")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    placed = (
        sizes.withColumn("key", F.coalesce(key, F.lit(0).cast("long")))
        .join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("own")))
        .withColumn("bucket", F.expr("shiftright(key, shift)"))
        .drop("own", "shift", "n_docs")
    )
    # A bucket with very many rows, of one id or of none, is cut into pieces that are in the same order; such buckets are few.
    most = max(8 * BUCKET, sizes.count() // HOT_KEYS)
    crowded = placed.groupBy("source", "bucket").count().where(F.col("count") > most)
    crowded = written(crowded.select(F.col("source").alias("own"), F.col("bucket").alias("own_bucket"), F.lit(True).alias("crowded")), "crowded")
    same_bucket = F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("own_bucket"))
    piece = F.when(F.col("crowded"), F.struct("key", "doc_id", "size", F.expr(f"shiftright(row, {BUCKET.bit_length() - 1})").alias("rows")))
    rows = placed.join(F.broadcast(crowded), same_bucket, "left").withColumn("piece", piece).drop("own", "own_bucket", "crowded")
    in_order = W.partitionBy("source").orderBy("bucket", "piece").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket", "piece").agg(F.sum("size").alias("words"))
    starts = sums.select(F.col("source").alias("own"), F.col("bucket").alias("own_bucket"), F.col("piece").alias("own_piece"), F.coalesce(F.sum("words").over(in_order), F.lit(0)).alias("start"))
    within = W.partitionBy("source", "bucket", "piece").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    started = rows.join(starts, same_bucket & F.col("piece").eqNullSafe(F.col("own_piece")))
    return (
        started.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("passes", F.expr("CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0L END"))
        .withColumn("last", F.expr("greatest(0L, least(size, cast(floor(target) AS bigint) - passes * source_size - before))"))
        .withColumn("taken", F.expr("passes * size + last"))
        .withColumn("copies", F.expr("CASE WHEN size > 0 THEN passes + if(last > 0, 1, 0) ELSE 0L END"))
        .select("row", "doc_id", "size", "source_size", "target", "slope", "before", "taken", "copies")
    )


def plan(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, position) for every row of ``docs``, range-sorted by position.

    ``copies`` is how often the mix uses the document, the last time perhaps in part;
    ``position`` in [0, 1) is where it does so first (null: never).
    """
    sizes = written(sizes_of(docs, F.monotonically_increasing_id(), size_of("text")), "sizes")
    return (
        dealt(sizes)
        .withColumn("u", F.expr("CASE WHEN copies > 0 THEN before / target END"))
        .withColumn("position", F.expr(POSITION))
        .select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix uses them, in training order: each use at its own position."""
    row, size, own, position = fresh(docs, "mix_row", "mix_size", "mix_own", "mix_position")
    rows = written(docs.withColumns({row: F.monotonically_increasing_id(), size: size_of("text")}), "rows")
    uses = (
        dealt(sizes_of(rows, F.col(row), F.col(size)))
        .withColumn("use", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1L, copies) END")))
        .withColumn("u", F.expr("(before + (use - 1) * source_size) / target"))
        .select(F.col("row").alias(own), F.expr(POSITION).alias(position))
    )
    joined = rows.join(uses, F.col(row) == F.col(own))
    return joined.orderBy(position, F.col("doc_id").cast("long"), row).select(*docs.columns)


SQL = f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sizes GROUP BY source),
{TARGETS},
placed AS (SELECT s.doc_id, s.size, t.*, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR)[:15], s.doc_id, s.size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM placed),
rest AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - passes * source_size - before)) AS last FROM passed),
used AS (SELECT *, CASE WHEN size > 0 THEN passes + (last > 0)::BIGINT ELSE 0 END AS copies FROM rest),
u AS (SELECT *, CASE WHEN copies > 0 THEN before / target END AS u FROM used)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + last)::BIGINT AS taken, copies::BIGINT AS copies,
  2e0 * u / ((1e0 - slope) + sqrt((1e0 - slope) * (1e0 - slope) + 4e0 * slope * u)) AS position
FROM u
"""
