"""Where edits come from: trace files and random editing sessions."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellog.functions.schemas import PATCHES, TRACE


def read_traces(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Trace files, JSON or gzipped JSON, one document each: (doc_id, path, endContent, txns).

    With ``lines`` a file holds a document on each line, as ``write_traces`` makes it, which a ``name`` tells from the others.
    """
    raw = spark.read.schema(f"{TRACE}, name string" if lines else TRACE).json(path, multiLine=not lines)
    if lines:
        return raw.select(F.xxhash64("name").alias("doc_id"), "name", "endContent", "txns")
    return raw.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), "endContent", "txns")


def write_traces(made: DataFrame, path: str) -> str:
    """Writes traces (doc_id, endContent, txns) as gzipped JSON lines, named by their ids; gives ``path``."""
    made.select(F.col("doc_id").cast("string").alias("name"), "endContent", "txns").write.json(path, compression="gzip")
    return path


def patches(traces: DataFrame) -> DataFrame:
    """The flat patches of traces, in (txn, i) order."""
    txns = traces.select("doc_id", F.posexplode("txns").alias("txn", "t"))
    each = txns.select("doc_id", "txn", F.posexplode("t.patches").alias("i", "p"))
    return each.select("doc_id", F.col("txn").cast("long").alias("txn"), F.col("i").cast("long").alias("i"), F.get("p", F.lit(0)).cast("long").alias("pos"), F.get("p", F.lit(1)).cast("long").alias("del"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("ins"))


def random_edits(ids: DataFrame, edits: int, seed: int = 0) -> DataFrame:
    """Patches of a random session of ``edits`` single insertions or deletions for each of ``ids`` (doc_id); a session's last one has the text it makes, as ``final``.

    Half the edits insert a random letter or digit, all do while the text is empty.
    """
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    schema = f"{PATCHES}, final string"
    fields = pa.schema([(c, pa.int64()) for c in ("doc_id", "txn", "i", "pos", "del")] + [("ins", pa.string()), ("final", pa.string())])

    def session(doc_id: int) -> list[dict]:
        rnd, text, out = random.Random(f"{seed}:{doc_id}"), [], []
        for txn in range(edits):
            row = {"doc_id": doc_id, "txn": txn, "i": 0, "del": 0, "ins": "", "final": None}
            if not text or rnd.random() < 0.5:
                row |= {"pos": rnd.randint(0, len(text)), "ins": rnd.choice(letters)}
                text.insert(row["pos"], row["ins"])
            else:
                row |= {"pos": rnd.randrange(len(text)), "del": 1}
                del text[row["pos"]]
            out.append(row)
        if out:
            out[-1]["final"] = "".join(text)
        return out

    def run(batches):
        for batch in batches:
            for d in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(session(d), schema=fields)

    return ids.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, schema)
