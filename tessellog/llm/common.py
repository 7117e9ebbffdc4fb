"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (a single-machine session, as
    in tests) a temporary folder is made.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables that ``written`` made inside it without ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _scratch.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, label: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder, with a folder for each value of ``by``, and read again.

    It cuts the lineage: what follows reads files that outlive any executor.  What the driver has freed meanwhile goes back to the system.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path, partitionBy=by)
    driver_gives_back(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between two times that the driver gives memory back: a full collection of its heap takes some tenths of one.
GIVE_BACK_S = 10
_gave_back = [-math.inf]


def driver_gives_back(spark: SparkSession) -> str:
    """Returns what the driver has freed to the system, if it has not just done so; says what the JVM released beside its heap.

    Each job leaves plans, broadcasts and results in the driver's heap, and its short-lived threads leave freed blocks in
    the C library's arenas.  A JVM keeps both for later, so hundreds of small jobs fill the driver's memory, however little of it is used.
    """
    if time.monotonic() - _gave_back[0] < GIVE_BACK_S:
        return ""
    give_back()
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang
    java.System.gc()
    types, values = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = java.Class.forName(name)
    try:
        values[0], values[1] = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By its interface, as the server's own class is not open to callers.
        invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values).strip()
    except Py4JError:
        return ""  # another JVM or C library
    finally:
        _gave_back[0] = time.monotonic()


#: Up to this many dropped keys (at most about 90 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_KEYS = 100_000


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have."""
    out = []
    taken = {c.lower() for c in docs.columns}
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` whose key columns, those of ``keys``, are not among ``keys``' rows (nulls are equal); with ``left_semi``, those that are."""
    names = fresh(docs, *[f"other_{c}" for c in keys.columns])
    others = written(keys.distinct().toDF(*names), "keys")
    few = others.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    on = [docs[c].eqNullSafe(others[n]) for c, n in zip(keys.columns, names, strict=True)]
    return docs.join(F.broadcast(others) if few else others, on, how)


#: A table of at most so many bytes is broadcast to what it is joined with.
BROADCAST_BYTES = 4 << 20
#: A join's key is hot if it has more rows than this and than one in ``HOT_KEYS`` of all; so at most ``HOT_KEYS`` keys are.
HOT_ROWS = 512
HOT_KEYS = 20_000
#: So many rows are one task's work whatever their keys are.
FEW_ROWS = 4096


def dealt(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, total: int | None = None, n_one: int | None = None, width: int = 40) -> DataFrame:
    """``rows`` joined with ``one``, which has one row for each of ``keys`` at most; a hot key's rows are dealt to several tasks.

    If ``one`` (``n_one`` rows of about ``width`` bytes) is small, it is broadcast.  Beyond that
    ``counts`` (keys, n) and ``total`` say how many rows each key and all have, if it is known.
    The hot keys, at most ``HOT_KEYS`` of them, are broadcast; their rows of ``one`` are repeated once for each part.
    """
    n_one = one.count() if n_one is None else n_one
    if n_one * width <= BROADCAST_BYTES:
        return rows.join(F.broadcast(one), keys, how)
    total = rows.count() if total is None else total
    if total <= FEW_ROWS:
        return rows.join(one, keys, how)
    most = max(HOT_ROWS, total // HOT_KEYS)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = written(counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("dealt_parts")), "hot")
    if hot.isEmpty():
        return rows.join(one, keys, how)
    parts_of = F.coalesce("dealt_parts", F.lit(1))
    others = [c for c in rows.columns if c not in keys]
    spread = F.pmod(F.xxhash64(*others) if others else F.monotonically_increasing_id(), parts_of).alias("dealt_part")
    many = rows.join(F.broadcast(hot), keys, "left").select(*rows.columns, spread)
    each = F.explode(F.sequence(F.lit(0).cast("long"), parts_of - 1)).alias("dealt_part")
    few = one.join(F.broadcast(hot), keys, "left").select(*one.columns, each)
    return many.join(few, [*keys, "dealt_part"], how).drop("dealt_part")


#: Bytes of text that a worker takes at a time from an Arrow batch.
PART_BYTES = 400_000
_BATCH_SETTING, _BATCH_DEFAULT, _BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def small_batches(spark: SparkSession) -> None:
    """Sends text to Python workers in batches of 8 MB, unless the session has a setting of its own.

    A batch exists in the JVM and in the worker at once, for every task of an executor.
    """
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, _BATCH)


def parts(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``PART_BYTES`` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    size = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64) for c in texts)
    part = np.cumsum(size) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def give_back() -> None:
    """Returns what this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers give their memory back after each task; they stay for later ones."""

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(frugal, schema)
