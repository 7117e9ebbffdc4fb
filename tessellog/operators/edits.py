"""Positional edits to operations, and the two layouts of a log.

The fold over one document's edits is sequential, so documents are the axis of
parallelism: one shuffle on ``doc_id`` brings a document's patches together, and an
Arrow-grouped map folds them.  A document's edits must fit a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from tessellog.functions import document
from tessellog.functions.hashing import PROFILES, preimage
from tessellog.functions.schemas import NODES, RECORDS

_IDS = pa.list_(pa.string())
_RECORDS = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("rec_id", pa.string()), ("kind", pa.string()), ("anchor", pa.string()), ("text", pa.string()), ("extra_deps", _IDS), ("targets", pa.binary()), ("places", pa.list_(pa.struct([("rec", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())])))])
_NODES = pa.schema([("doc_id", pa.int64()), ("node_id", pa.string()), ("op", pa.string()), ("anchor", pa.string()), ("ch", pa.string()), ("extra_deps", _IDS), ("targets", _IDS)])


def _hex(x: bytes | None) -> str | None:
    return None if x is None else x.hex()


def _raw(row: dict) -> dict:
    """A row with ids as bytes; a record's targets stay packed."""
    ids = lambda xs: [bytes.fromhex(x) for x in xs or ()]
    out = row | {"anchor": None if row["anchor"] is None else bytes.fromhex(row["anchor"]), "extra_deps": ids(row["extra_deps"])}
    out["targets"] = row["targets"] if isinstance(row["targets"], bytes) else ids(row["targets"])
    if "places" in row:
        out["places"] = [(bytes.fromhex(p["rec"]), p["lo"], p["hi"]) for p in row["places"] or ()]
    return out


def _record_table(doc_id: int, records: list[dict]) -> pa.Table:
    rows = [
        {
            "doc_id": doc_id,
            "seq": i,
            "rec_id": r["rec_id"].hex(),
            "kind": r["kind"],
            "anchor": _hex(r["anchor"]),
            "text": r["text"],
            "extra_deps": [x.hex() for x in r["extra_deps"]],
            "targets": b"".join(r["targets"]),
            "places": [{"rec": rec.hex(), "lo": lo, "hi": hi} for rec, lo, hi in r.get("places", ())],
        }
        for i, r in enumerate(records)
    ]
    return pa.Table.from_pylist(rows, schema=_RECORDS)


def _patches(patches: DataFrame) -> DataFrame:
    return patches.select("doc_id", "txn", "i", "pos", "del", "ins")


def _replayed(group: pa.Table, profile: str) -> document.Document:
    """The document that a group of patches leads to."""
    group = group.sort_by([("txn", "ascending"), ("i", "ascending")])
    doc = document.Document(profile)
    for pos, cut, ins in zip(*(group[c].to_pylist() for c in ("pos", "del", "ins")), strict=True):
        doc.remove(pos, cut or 0)
        doc.insert(pos, ins or "")
    return doc


def replay(patches: DataFrame, profile: str = "sha256") -> DataFrame:
    """Records of the operations that each document's patches make, in (txn, i) order: delete, then insert.

    Positions beyond the end clamp deletions; an insertion there makes a root of its own.
    """

    def fold(group: pa.Table) -> pa.Table:
        return _record_table(group["doc_id"][0].as_py(), _replayed(group, profile).records)

    return _patches(patches).groupBy("doc_id").applyInArrow(fold, RECORDS)


_BATCH_SETTING, _BATCH_DEFAULT, _BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"

#: Patches that are taken from an Arrow batch at a time, and rows that are given at a time or bytes of text that make them fewer.
_SLICE, _OUT_ROWS, _OUT_BYTES = 256, 1_000, 4_000_000


def by_document(patches: DataFrame, rows_of: Callable[[document.Document], list[tuple]], schema: str, profile: str = "sha256") -> DataFrame:
    """``rows_of`` the document that each ``doc_id``'s patches lead to, with the id ahead, which is the first column of ``schema``.

    Patches come sorted by document, so a task reads many from one batch; a group's own Arrow stream takes longer than most documents' edits.
    Batches have 8 MB, unless the session has a setting of its own.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, document.Document]]:
        doc = own = None
        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE):
                for doc_id, _, _, pos, cut, ins in zip(*(c.to_pylist() for c in batch.slice(lo, _SLICE).columns), strict=True):
                    if doc is None or doc_id != own:
                        if doc is not None:
                            yield own, doc
                        doc, own = document.Document(profile), doc_id
                    doc.remove(pos, cut or 0)
                    doc.insert(pos, ins or "")
        if doc is not None:
            yield own, doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for doc_id, doc in documents(batches):
            found = rows_of(doc)
            out += [(doc_id, *r) for r in found]
            size += sum(len(x) for r in found for x in r if isinstance(x, (bytes, str)))
            if len(out) >= _OUT_ROWS or size >= _OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers stay for later tasks

    spark = patches.sparkSession
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, _BATCH)
    return _patches(patches).repartition("doc_id").sortWithinPartitions("doc_id", "txn", "i").mapInArrow(run, fields)


def patches_of_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document as one batch insertion at 0."""
    zero = F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), zero.alias("txn"), zero.alias("i"), zero.alias("pos"), zero.alias("del"), F.col(text).alias("ins"))


def in_current_coordinates(changes: DataFrame) -> DataFrame:
    """Patches from changes (doc_id, txn, i, from_pos, to_pos, text) in the coordinates of the transaction's start.

    A change moves by what the changes ahead of it in the transaction added or took.
    """
    ahead = W.partitionBy("doc_id", "txn").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    grown = F.char_length(F.coalesce("text", F.lit(""))) - (F.col("to_pos") - F.col("from_pos"))
    return changes.select(
        "doc_id",
        "txn",
        "i",
        (F.col("from_pos") + F.coalesce(F.sum(grown).over(ahead), F.lit(0))).cast("long").alias("pos"),
        (F.col("to_pos") - F.col("from_pos")).cast("long").alias("del"),
        F.col("text").alias("ins"),
    )


def expand(records: DataFrame, profile: str = "sha256") -> DataFrame:
    """One row for each operation; ids are recomputed, never trusted.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = PROFILES[profile]
        for batch in batches:
            columns: list[list] = [[] for _ in _NODES]
            for row in batch.to_pylist():
                raw, text = _raw(row), row["text"] or ""
                targets = sorted(x.hex() for x in set(document.ids_of(raw["targets"])))
                extra = sorted(set(row["extra_deps"] or ()))
                chained = raw["kind"] == "run"
                op = "after" if chained else raw["kind"]
                ids = [sha(preimage(op, raw["anchor"], text[:1], raw["extra_deps"], document.ids_of(raw["targets"])))]
                if chained:
                    document.follow(ids, text, len(text) - 1, sha)
                names, more = [x.hex() for x in ids], len(ids) - 1
                own = ([row["doc_id"]] * len(ids), names, [op] * len(ids), [row["anchor"], *names[:-1]], list(text) if chained else [row["text"]], [extra, *[[]] * more], [targets, *[[]] * more])
                for column, values in zip(columns, own, strict=True):
                    column += values
                if len(columns[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES)], schema=_NODES)
                    columns = [[] for _ in _NODES]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES)], schema=_NODES)

    return records.select("doc_id", "rec_id", "kind", "anchor", "text", "extra_deps", "targets").mapInArrow(run, NODES)


def compact(nodes: DataFrame) -> DataFrame:
    """Records of each document's operations, with every chain folded into one run."""

    def fold(group: pa.Table) -> pa.Table:
        raw = bytes.fromhex
        ids, ops, anchors, chars, extra, targets = (group[c].to_pylist() for c in ("node_id", "op", "anchor", "ch", "extra_deps", "targets"))
        sets = lambda column: [[raw(x) for x in xs] if xs else [] for xs in column]
        found = document.compact(list(zip(map(raw, ids), ops, [raw(a) if a else None for a in anchors], chars, sets(extra), sets(targets))))
        return _record_table(group["doc_id"][0].as_py(), found)

    return nodes.groupBy("doc_id").applyInArrow(fold, RECORDS)


def recompact(records: DataFrame, profile: str = "sha256") -> DataFrame:
    """``compact`` of the single operations of ``records``, which are made and folded in the same task: only compact logs are shuffled."""

    def refold(group: pa.Table) -> pa.Table:
        rows = map(_raw, group.drop_columns("doc_id").to_pylist())
        nodes = {n[0]: n for n in document.expand(rows, profile)}
        return _record_table(group["doc_id"][0].as_py(), document.compact(list(nodes.values())))

    return records.select("doc_id", "kind", "anchor", "text", "extra_deps", "targets").groupBy("doc_id").applyInArrow(refold, RECORDS)


def characters(records: DataFrame) -> DataFrame:
    """(doc_id, rec_id, place, ch): a run's characters by code point, without their ids; stays in the JVM."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return records.where("kind <> 'remove'").select("doc_id", "rec_id", F.posexplode(chars).alias("place", "ch"))


def _with_ids(records: DataFrame, schema: str, rows_of, profile: str, *more: str) -> DataFrame:
    """A map over runs: ``rows_of(row, ids)`` gives rows; ``ids`` are those of the run's characters, recomputed from its anchor."""
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = PROFILES[profile]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = _raw(row)
                ids = [sha(preimage("after", raw["anchor"], row["text"][:1], raw["extra_deps"], ()))]
                document.follow(ids, row["text"], len(row["text"]) - 1, sha)
                out += rows_of(row, ids)
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(fields)
    runs = records.where("kind = 'run'").select("doc_id", "rec_id", "anchor", "text", "extra_deps", F.lit(b"").alias("targets"), *more)
    return runs.mapInArrow(run, fields)


def run_ids(records: DataFrame, profile: str = "sha256") -> DataFrame:
    """(doc_id, rec_id, n, first_id, last_id) of each run: its length in characters and the ids at both ends."""

    def rows(row: dict, ids: list[bytes]) -> list[dict]:
        return [{"doc_id": row["doc_id"], "rec_id": row["rec_id"], "n": len(ids), "first_id": ids[0].hex(), "last_id": ids[-1].hex()}]

    return _with_ids(records, "doc_id long, rec_id string, n long, first_id string, last_id string", rows, profile)


def find_position(ids: DataFrame, records: DataFrame, profile: str = "sha256") -> DataFrame:
    """The rows of ``ids`` (doc_id, node_id) that name a run's character, with its run and place there.

    Ids come to the runs: a document's ids and compact log are in one task, and only what is found leaves it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("rec_id", pa.string()), ("node_id", pa.string()), ("place", pa.int64())])

    def find(asked: pa.Table, runs: pa.Table) -> pa.Table:
        sha = PROFILES[profile]
        wanted = {bytes.fromhex(x) for x in asked["node_id"].to_pylist() if x} if runs.num_rows else ()
        out = []
        for row in runs.to_pylist() if wanted else ():
            raw, text = _raw(row), row["text"]
            found = [sha(preimage("after", raw["anchor"], text[:1], raw["extra_deps"], ()))]
            document.follow(found, text, len(text) - 1, sha)
            out += [{"doc_id": row["doc_id"], "rec_id": row["rec_id"], "node_id": x.hex(), "place": k} for k, x in enumerate(found) if x in wanted]
        return pa.Table.from_pylist(out, schema=schema)

    runs = records.where("kind = 'run'").select("doc_id", "rec_id", "anchor", "text", "extra_deps", F.lit(b"").alias("targets"))
    asked = ids.select("doc_id", "node_id").groupBy("doc_id").cogroup(runs.groupBy("doc_id"))
    return ids.join(asked.applyInArrow(find, "doc_id long, rec_id string, node_id string, place long"), ["doc_id", "node_id"])


def frontier(records: DataFrame, profile: str = "sha256") -> DataFrame:
    """(doc_id, node_id) of the operations nothing depends on, from compact logs of any number of replicas: ``graph.tips`` of their merged operations."""

    def tips(group: pa.Table) -> pa.Table:
        rows = list(map(_raw, group.drop_columns("doc_id").to_pylist()))
        folded = document.fold(rows, profile)
        named = lambda r: (*r["extra_deps"], *r["targets"], *([r["anchor"]] if r["anchor"] else []))
        if folded:
            ends = [[r["rec_id"]] for r in folded[0]]
            for ids, r in zip(ends, folded[0], strict=True):
                if r["kind"] == "run":
                    document.follow(ids, r["text"], len(r["text"]) - 1, PROFILES[profile])
            free = {ids[-1] for ids in ends}.difference(*map(named, folded[0]))
        else:
            nodes = list(document.expand(rows, profile))
            free = {n[0] for n in nodes}.difference(*((*n[4], *n[5], *([n[2]] if n[2] else [])) for n in nodes))
        return pa.table({"doc_id": pa.array([group["doc_id"][0].as_py()] * len(free), pa.int64()), "node_id": pa.array(sorted(x.hex() for x in free), pa.string())})

    return records.select("doc_id", "kind", "anchor", "text", "extra_deps", "targets").groupBy("doc_id").applyInArrow(tips, "doc_id long, node_id string")


def split_run(records: DataFrame, at: Column, profile: str = "sha256") -> DataFrame:
    """(doc_id, part, rec_id, anchor, text, extra_deps): each run as two at character ``at``, if both parts hold one.

    The right part is named by its first character's id and anchored on the left's last; it has no extra dependencies.
    """

    def rows(row: dict, ids: list[bytes]) -> list[dict]:
        own = {c: row[c] for c in ("doc_id", "rec_id", "anchor", "text", "extra_deps")} | {"part": 0}
        k = row["at"]
        if k is None or not 0 < k < len(ids):
            return [own]
        right = {"doc_id": row["doc_id"], "part": 1, "rec_id": ids[k].hex(), "anchor": ids[k - 1].hex(), "text": row["text"][k:], "extra_deps": []}
        return [own | {"text": row["text"][:k]}, right]

    schema = "doc_id long, part int, rec_id string, anchor string, text string, extra_deps array<string>"
    return _with_ids(records.withColumn("at", at.cast("int")), schema, rows, profile, "at")


def texts(patches: DataFrame, profile: str = "sha256") -> DataFrame:
    """(doc_id, text, length) of every document that has patches, also if these leave or make nothing.

    The state that the patches lead to shows its text, so no records are made: ids are hashed only where an order depends on them.
    """

    def fold(group: pa.Table) -> pa.Table:
        text = _replayed(group, profile).text()
        return pa.table({"doc_id": [group["doc_id"][0].as_py()], "text": [text], "length": pa.array([len(text)], pa.int64())})

    return _patches(patches).groupBy("doc_id").applyInArrow(fold, "doc_id long, text string, length long")


def linear_text(records: DataFrame, profile: str = "sha256") -> DataFrame:
    """(doc_id, text, length): the visible text of each document, from its records by one grouped map.

    Runs are expanded only inside the group, so what is shuffled is the compact log.
    """

    def fold(group: pa.Table) -> pa.Table:
        rows = [_raw(r) | {"rec_id": bytes.fromhex(r["rec_id"])} for r in group.to_pylist()]
        text = document.render(rows, profile)
        return pa.table({"doc_id": [group["doc_id"][0].as_py()], "text": [text], "length": pa.array([len(text)], pa.int64())})

    return records.groupBy("doc_id").applyInArrow(fold, "doc_id long, text string, length long")
