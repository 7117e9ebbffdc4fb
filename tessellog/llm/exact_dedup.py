"""Exact deduplication by a log-structured merge index of text digests.

Texts are equal when they are identical after A-Z are lower-cased (null counts as
empty).  Each task is a memtable: it digests its rows, sorts them by digest and
flushes them to the log.  What ``MEMTABLES`` groups of tasks have flushed becomes one
sorted run each, with its key range and a blocked Bloom filter.  ``RATIO`` runs of a level
are compacted to one run of the next.  A compaction probes each run's digests
against the other runs' filters, as far as their key ranges meet: what no other run can
hold is taken over as it is, and only the rest is shuffled and merged, to each digest's
surviving row and count.  Partial sums are made before every shuffle, so a digest that a
third of all rows share sends one row a task.  Rows whose digest occurs again are hits:
their texts' bytes are compared, digest by digest, through the smallest and the
largest text.  Digests whose texts differ are split by the texts themselves.

Of equal texts, the row with the largest doc_id stays (``keep="min"``: the
smallest; rows without an id come last or first).  Of repeated rows with that id one stays; which is not told apart by
the result's other columns.  A very long text is one digest like any other.  Only
(doc_id, text) are read, whatever other columns there are.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import dealt, fresh, lower_ascii, scratch_path, without, written

#: Digests of at most this many groups are broadcast (36 bytes each) to find the hits' texts; beyond, a join is shuffled.
BROADCAST_GROUPS = 100_000
#: Runs that one table of documents is flushed to.
MEMTABLES = 4
#: Runs of a level that are compacted to one of the next.
RATIO = 4
#: Bits of a filter for each digest, and in one block of a filter; a block is a row of 4 KB.
FILTER_BITS, BLOCK_BITS = 16, 32_768
#: Up to this many blocks are broadcast (4 KB for each run of the compaction); beyond, the probe is a shuffled join.
BROADCAST_BLOCKS = 1024


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Run:
    """``entries`` (digest, keep_id, keep_row, group_size), sorted by digest, with filter blocks (block, bits) and key range."""

    entries: DataFrame
    blocks: DataFrame
    low: bytes | None
    high: bytes | None

    def meets(self, other: Run) -> bool:
        return None not in (self.low, other.low) and self.low <= other.high and other.low <= self.high


def _places(blocks: int) -> tuple[str, list[str]]:
    """SQL of a digest's filter block, and of its two bits there."""
    return f"pmod(shiftright(xxhash64(digest), 30), {blocks})", ["(xxhash64(digest) & 32767)", "(shiftright(xxhash64(digest), 15) & 32767)"]


def _holds(bits: str, places: list[str]) -> str:
    """SQL that tests whether a digest's bits are set in block ``bits`` (null: no block)."""
    tests = [f"shiftright(cast(conv(hex(substring({bits}, cast({p} div 8 AS int) + 1, 1)), 16, 10) AS int), cast({p} % 8 AS int)) & 1 = 1" for p in places]
    return f"coalesce({' AND '.join(tests)}, false)"


class DigestIndex:
    """Sorted runs of digests on levels, in the shared folder; level 0 holds what was flushed last.

    ``rows`` is how many digests the index is expected to hold, by which its filters are sized; more only make them less sharp.
    ``probed`` has, for each compaction, how many entries were passed on by filters and how many were merged.
    """

    def __init__(self, spark, rows: int, keep: str = "max", ratio: int = RATIO):
        self.spark, self.keep, self.ratio = spark, keep, ratio
        self.n_blocks = 1 << max(0, (rows * FILTER_BITS // BLOCK_BITS).bit_length())
        self.levels: list[list[Run]] = [[]]
        self.probed: list[tuple[int, int]] = []

    def _run(self, entries: DataFrame) -> Run:
        entries = written(entries.sortWithinPartitions("digest"), "run")
        block, places = _places(self.n_blocks)
        each = entries.select(F.expr(block).alias("block"), F.explode(F.array(*map(F.expr, places))).alias("place"))
        blocks = written(each.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")), "filter")
        ends = entries.agg(F.min("digest").alias("low"), F.max("digest").alias("high")).first()
        return Run(entries, blocks, ends["low"] and bytes(ends["low"]), ends["high"] and bytes(ends["high"]))

    def _merged(self, entries: DataFrame) -> DataFrame:
        best = (F.max if self.keep == "max" else F.min)(F.struct("keep_id", "keep_row"))
        merged = entries.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        return merged.select("digest", "best.keep_id", "best.keep_row", "group_size")

    def insert(self, memtable: DataFrame) -> None:
        """Makes the digests (digest, doc_id, row) a run of level 0; full levels are compacted."""
        entries = memtable.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
        self.levels[0].append(self._run(self._merged(entries)))
        level = 0
        while len(self.levels[level]) >= self.ratio:
            runs, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            level += 1
            self.levels[level].append(self.compact(runs))

    def compact(self, runs: list[Run]) -> Run:
        """One run of ``runs``; an entry that no other run can hold is not merged."""
        if len(runs) == 1:
            return runs[0]
        block, places = _places(self.n_blocks)
        numbered = reduce(DataFrame.union, [r.blocks.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
        filters = numbered.groupBy("block").agg(*[F.max(F.when(F.col("run") == i, F.col("bits"))).alias(f"bits_{i}") for i in range(len(runs))])
        filters = F.broadcast(filters) if self.n_blocks <= BROADCAST_BLOCKS else filters
        tagged = []
        for i, run in enumerate(runs):
            others = [_holds(f"bits_{j}", places) for j, other in enumerate(runs) if j != i and run.meets(other)]
            if others:
                probe = run.entries.withColumn("block", F.expr(block)).join(filters, "block", "left")
                tagged.append(probe.select(*run.entries.columns, F.expr(" OR ".join(others)).alias("shared")))
            else:
                tagged.append(run.entries.withColumn("shared", F.lit(False)))
        probed = written(reduce(DataFrame.union, tagged), "probed", by="shared")
        told = {r["shared"]: r["n"] for r in probed.groupBy("shared").agg(F.count("*").alias("n")).collect()}
        self.probed.append((told.get(False, 0), told.get(True, 0)))
        return self._run(probed.where("NOT shared").drop("shared").union(self._merged(probed.where("shared").drop("shared"))))

    def close(self) -> DataFrame:
        """Compacts all levels to one run: (digest, keep_id, keep_row, group_size)."""
        runs = [r for level in self.levels for r in level]
        self.levels = [[], [self.compact(runs)]]
        return self.levels[1][0].entries


def digests(docs: DataFrame, digest=sha256) -> DataFrame:
    """(digest, doc_id, row, memtable) of every row of ``docs``, each with a number of its own: what the tasks flush, sorted by digest."""
    own = docs.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    log = own.withColumns({"row": F.monotonically_increasing_id(), "memtable": F.pmod(F.spark_partition_id(), F.lit(MEMTABLES))})
    return written(log.sortWithinPartitions("digest"), "log", by="memtable")


def differing(level: DataFrame, docs: DataFrame, digest=sha256) -> DataFrame:
    """Digests that hits of different bytes share; from an honest digest, none."""
    groups = level.where("group_size > 1").select("digest")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    text = normalised(F.col("text"))
    hits = docs.select(digest(text).alias("digest"), text.cast("binary").alias("bytes")).join(F.broadcast(groups) if few else groups, "digest", "left_semi")
    return hits.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("low <> high").select("digest")


def dedup(docs: DataFrame, keep: str = "max", digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``digest`` may be a weaker one; byte verification makes up for it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    entries = digests(docs, digest)
    total = entries.count()
    index = DigestIndex(docs.sparkSession, total, keep)
    for i in range(MEMTABLES):
        index.insert(entries.where(F.col("memtable") == i))
    level = index.close()
    found = dealt(entries.select("digest", "doc_id", "row"), level, ["digest"], counts=level.select("digest", F.col("group_size").alias("n")), total=total)
    by_digest = found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    unequal = written(differing(level, docs, digest), "differing")
    if digest is sha256 and unequal.isEmpty():
        return by_digest.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
    # A digest that tells texts apart less well: the rows concerned are grouped by their texts.
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", digest(text).alias("digest"), text.alias("bytes"))
    clashing = rows.join(unequal, "digest", "left_semi")
    best = (F.max if keep == "max" else F.min)("doc_id")
    groups = clashing.groupBy("digest", "bytes").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    first = F.row_number().over(W.partitionBy("digest", "bytes", "doc_id").orderBy("doc_id")) == 1
    by_text = clashing.join(groups, ["digest", "bytes"]).select("doc_id", "keep_id", "group_size", ((F.col("doc_id") == F.col("keep_id")) & first).alias("kept"), "bytes")
    plain = by_digest.join(unequal, "digest", "left_anti")
    named = plain.join(rows.groupBy("doc_id", "digest").agg(F.max("bytes").alias("bytes")), ["doc_id", "digest"]).select("doc_id", "keep_id", "group_size", "kept", "bytes")
    return named.union(by_text).withColumn("text_sha256", F.sha2(F.col("bytes").cast("binary"), 256)).drop("bytes")


def keep_rows(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows, one."""
    (sha,) = fresh(docs, "text_sha256")
    judged = dedup(docs, keep).withColumnRenamed("text_sha256", sha)
    fates = written(judged.groupBy("doc_id", sha).agg(F.max("kept").alias("stays"), F.count("*").alias("n")), "fates")
    keyed = docs.withColumn(sha, F.lower(F.hex(sha256(normalised(F.col("text"))))))
    left = without(keyed, fates.where("not stays").select("doc_id", sha))
    if not fates.where("stays AND n > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", sha])
    return left.drop(sha)


SQL = """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)
"""
