"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash.  It starts as one
bucket; only a bucket whose bytes exceed the limit splits on its next bit, until
every shard fits.  Bits 0 to 59 come from the document's id; bits 60 to 119 from
the row's number, so that repeated ids split as well.  A row that is over the
limit by itself gets a shard of its own once its bits differ from all others'
(``oversized``).

The split runs level by level over a table of (hash, bytes) in the shared folder:
each level sums the bytes of the still open buckets by prefix, map-side first, and
only rows of oversized buckets go on.  Two levels of bits are settled by one pass
(``STEP`` bits a pass), from sums by the finer prefix.  Nothing but the pass's
count of open buckets comes to the driver.  Null and empty texts have 0 bytes; a very long text
is one row like any other.  ``directory`` is what the split leaves behind: one entry for each shard,
by which ``look_up`` finds the shard of a new document.  Extra columns are not read by ``assign`` and
kept by ``write``; an empty table has an empty directory and no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Bytes of text that a shard holds at most.
LIMIT = 1 << 20
#: Bits that a pass over the open buckets settles.
STEP = 6
DEPTH = 120


def prefix(bits: int) -> str:
    """SQL of the first ``bits`` bits of (h, g), as text."""
    first, second = min(bits, 60), max(bits - 60, 0)
    text = "lpad(bin(h), 60, '0')" if bits >= 60 else f"left(lpad(bin(h), 60, '0'), {first})"
    return text if not second else f"concat({text}, left(lpad(bin(g), 60, '0'), {second}))"


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, oversized): each row's shard, named by its hash prefix."""
    return placed_rows(docs, F.monotonically_increasing_id(), limit).drop("row")


def placed_rows(docs: DataFrame, row: Column, limit: int) -> DataFrame:
    """``assign`` with each row's number, ``row``, which only has to be stable if it is used afterwards."""
    sixty = lambda c: F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 15), 16, 10).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        row.alias("row"),
    )
    rows = written(rows.withColumn("h", F.coalesce(sixty("doc_id"), F.lit(0).cast("long"))).withColumn("g", sixty("row")), "hashes")
    open_rows, settled, start = rows, [], 0
    while True:
        end = min(start + STEP, DEPTH)
        fine = written(open_rows.groupBy(F.expr(prefix(end)).alias("path")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "level")
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(end)))).withColumn("shard", F.expr("left(path, depth)"))
        sums = levels.groupBy("shard", "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == DEPTH))
        # Of a fine path's prefixes that fit, the shortest is its shard.
        chosen = (
            levels.select("path", "depth", "shard")
            .join(fits, ["shard", "depth"])
            .groupBy("path")
            .agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("to"))
        )
        placed = written(open_rows.join(chosen, F.expr(prefix(end)) == F.col("path"), "left").drop("path"), "placed")
        settled.append(placed.where("to IS NOT NULL"))
        open_rows = placed.where("to IS NULL").drop("to")
        start = end
        if open_rows.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("row", "doc_id", "bytes", F.col("to.shard").alias("shard"), F.col("to.depth").cast("long").alias("depth"), F.col("to.shard_bytes").alias("shard_bytes"), (F.col("to.shard_bytes") > limit).alias("oversized"))


def directory(assigned: DataFrame) -> DataFrame:
    """(shard, depth, shard_bytes, n_rows): the directory's entries, of which each holds the hashes that begin with its bits."""
    return assigned.groupBy("shard", "depth", "shard_bytes").agg(F.count("*").alias("n_rows"))


def look_up(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """``ids`` (doc_id, others) with the ``shard`` of the directory ``entries`` that a new document of that id belongs to.

    Null where the directory has no such bucket yet.  An id whose bucket was split by row numbers goes to the first of its shards.
    """
    own, home = fresh(ids, "own_path", "shard")
    path = F.lpad(F.bin(F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))), 60, "0")
    # Depths are 0 to DEPTH, so what comes to the driver is bounded.
    depths = sorted(r["depth"] for r in entries.select(F.least("depth", F.lit(60)).alias("depth")).distinct().collect())
    keyed = ids.withColumn(own, path)
    byids = keyed.select(own).distinct().select(own, F.explode(F.array(*[F.substring(own, 1, d) for d in depths] or [F.lit(None).cast("string")])).alias("prefix"))
    firsts = entries.groupBy(F.expr("left(shard, 60)").alias("prefix")).agg(F.min("shard").alias(home))
    found = byids.join(firsts, "prefix").groupBy(own).agg(F.min(home).alias(home))
    return keyed.join(found, own, "left").select(*ids.columns, home)


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes ``docs`` with one folder for each shard, each by one task; a row goes to the shard that ``assign`` computes for it."""
    row, own, shard = fresh(docs, "shard_row", "shard_own", "shard")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    shards = placed_rows(rows, F.col(row), limit).select(F.col("row").alias(own), F.concat(F.lit("b"), "shard").alias(shard))
    joined = rows.join(shards, F.col(row) == F.col(own)).drop(row, own)
    joined.repartition(shard).write.partitionBy(shard).parquet(path)


SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || md5(doc_id::VARCHAR)[:15])::BIGINT AS h FROM documents),
levels AS (SELECT *, lpad(bin(h), 60, '0')[:depth] AS shard FROM rows, (SELECT unnest(range(0, 61)) AS depth)),
sums AS (SELECT depth, shard, sum(bytes)::BIGINT AS shard_bytes FROM levels GROUP BY depth, shard HAVING sum(bytes) <= {LIMIT} OR count(*) = 1),
chosen AS (SELECT l.doc_id, l.bytes, min((s.depth, s.shard, s.shard_bytes)) AS c FROM levels l JOIN sums s ON l.depth = s.depth AND l.shard = s.shard GROUP BY l.doc_id, l.bytes)
SELECT doc_id, bytes::BIGINT AS bytes, c[2] AS shard, c[1]::BIGINT AS depth, c[3] AS shard_bytes, c[3] > {LIMIT} AS oversized FROM chosen
"""
