"""Batches and snapshots as columns: one binary value for each document."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessellog.functions import codec, document
from tessellog.functions.hashing import PROFILES, preimage
from tessellog.functions.schemas import FORMAT_VERSION, NODES, RECORDS

from .edits import _NODES, _raw, _record_table, by_document

DECODED = f"{NODES}, orphan boolean, error string"
_DECODED = pa.schema([*_NODES, ("orphan", pa.bool_()), ("error", pa.string())])


def _tuples(group: pa.Table) -> list[tuple]:
    """The operations (id, op, anchor, ch, extra_deps, targets) of ``NODES`` rows, with ids as bytes; repeated ones once."""
    raw = bytes.fromhex
    ids, ops, anchors, chars, extra, targets = (group[c].to_pylist() for c in ("node_id", "op", "anchor", "ch", "extra_deps", "targets"))
    sets = lambda xs: [raw(x) for x in xs] if xs else []
    own = {i: (i, op, a, ch, e, t) for i, op, a, ch, e, t in zip(ids, ops, anchors, chars, extra, targets)}
    return [(raw(i), op, a and raw(a), ch, sets(e), sets(t)) for i, op, a, ch, e, t in own.values()]


def encode_batches(records: DataFrame) -> DataFrame:
    """(doc_id, bytes) of each document's records in ``seq`` order."""

    def fold(group: pa.Table) -> pa.Table:
        rows = [_raw(r) for r in group.drop_columns("places").sort_by("seq").to_pylist()]
        rows = [r | {"targets": document.ids_of(r["targets"])} for r in rows]
        return pa.table({"doc_id": [rows[0]["doc_id"]], "bytes": pa.array([codec.encode_batch(rows)], pa.binary())})

    return records.groupBy("doc_id").applyInArrow(fold, "doc_id long, bytes binary")


_SNAPSHOT = "doc_id long, format_version int, bytes binary, gzip_bytes long"
_STATE = "n_nodes long, digest string"


def _packed(doc_id: pa.Array, data: bytes) -> pa.Table:
    return pa.table({"doc_id": doc_id, "format_version": pa.array([FORMAT_VERSION], pa.int32()), "bytes": pa.array([data], pa.binary()), "gzip_bytes": pa.array([len(gzip.compress(data))], pa.int64())})


def _snapshot(nodes: Iterable[tuple], strict: bool) -> bytes:
    rows = {n[0]: n for n in nodes}
    fit = set(document.admit({i: (n[1], n[2], n[4], n[5]) for i, n in rows.items()}, set()))
    return codec.encode_snapshot([n for i, n in rows.items() if i in fit], [n for i, n in rows.items() if i not in fit], strict)


def encode_snapshots(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, format_version, bytes, gzip_bytes) of each document's state; what lacks a dependency is an orphan."""
    return nodes.groupBy("doc_id").applyInArrow(lambda group: _packed(group["doc_id"][:1], _snapshot(_tuples(group), strict)), _SNAPSHOT)


def _log(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "kind", "anchor", "text", "extra_deps", "targets")


def _log_rows(group: pa.Table) -> list[dict]:
    return list(map(_raw, group.drop_columns("doc_id").to_pylist()))


def _written(rows: list[dict], strict: bool, profile: str, folded: tuple | None) -> bytes:
    """A state's snapshot from its records and what ``document.fold`` makes of them; by all operations if that is nothing."""
    return codec.write_snapshot(codec.Layout.of(*folded), (), strict) if folded else _snapshot(document.expand(rows, profile), strict)


def _state(rows: list[dict], profile: str, folded: tuple | None) -> tuple[int, str]:
    """(n_nodes, digest) of records: folded ones, which are the same for the same operations, are what is hashed."""
    own = folded[0] if folded else document.compact(list({n[0]: n for n in document.expand(rows, profile)}.values()))
    return sum(len(r["text"]) if r["kind"] == "run" else 1 for r in own), hashlib.sha256(codec.encode_batch(own)).hexdigest()


def encode_logs(records: DataFrame, strict: bool = False, profile: str = "sha256", state: bool = False) -> DataFrame:
    """What ``encode_snapshots`` gives, from the compact log, which is all that is shuffled; with ``state`` what ``states`` gives besides.

    Runs are laid out as wholes, not by character.
    """

    def pack(group: pa.Table) -> pa.Table:
        rows = _log_rows(group)
        folded = document.fold(rows, profile)
        out = _packed(group["doc_id"][:1], _written(rows, strict, profile, folded))
        if state:
            n, digest = _state(rows, profile, folded)
            out = out.append_column("n_nodes", pa.array([n], pa.int64())).append_column("digest", pa.array([digest]))
        return out

    return _log(records).groupBy("doc_id").applyInArrow(pack, f"{_SNAPSHOT}, {_STATE}" if state else _SNAPSHOT)


def states(records: DataFrame, profile: str = "sha256") -> DataFrame:
    """(doc_id, n_nodes, digest): how many operations a document's log holds, and the SHA-256 of the log with every chain in one run."""

    def digest(group: pa.Table) -> pa.Table:
        rows = _log_rows(group)
        n, own = _state(rows, profile, document.fold(rows, profile))
        return pa.table({"doc_id": group["doc_id"][:1], "n_nodes": pa.array([n], pa.int64()), "digest": [own]})

    return _log(records).groupBy("doc_id").applyInArrow(digest, f"doc_id long, {_STATE}")


def rewritten(snapshots: DataFrame, profile: str = "sha256") -> DataFrame:
    """(doc_id, same, same_bytes, orphans): whether what is read from ``bytes`` has the state (n_nodes, digest) and is written to the same bytes.

    A snapshot is a whole state, so no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.bool_()), ("same_bytes", pa.bool_()), ("orphans", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, raw, n, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, orphans = codec.decode_records(raw, profile)
                folded = document.fold([*own, *orphans], profile)
                row = (doc_id, _state([*own, *orphans], profile, folded) == (n, digest), _written([*own, *orphans], False, profile, folded) == raw, len(orphans))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return snapshots.select("doc_id", "bytes", "n_nodes", "digest").mapInArrow(run, "doc_id long, same boolean, same_bytes boolean, orphans int")


def _decode(data: DataFrame, read, fail_fast: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    parts, error = read(raw), None
                except codec.DecodeError as e:
                    if fail_fast:
                        raise
                    parts, error = ([], []), e.kind
                every = [(n, orphan) for orphan, nodes in zip((False, True), parts, strict=True) for n in nodes]
                for lo in range(0, max(1, len(every)), 50_000):
                    some = every[lo : lo + 50_000]
                    end = [None] * (error is not None)
                    columns = [
                        [doc_id] * (len(some) + len(end)),
                        [n[0].hex() for n, _ in some] + end,
                        [n[1] for n, _ in some] + end,
                        [n[2] and n[2].hex() for n, _ in some] + end,
                        [n[3] for n, _ in some] + end,
                        [[x.hex() for x in n[4]] for n, _ in some] + end,
                        [[x.hex() for x in n[5]] for n, _ in some] + end,
                        [orphan for _, orphan in some] + end,
                        [None] * len(some) + [error] * len(end),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DECODED)], schema=_DECODED)

    return data.select("doc_id", "bytes").mapInArrow(run, DECODED)


def decode_batches(data: DataFrame, profile: str = "sha256", fail_fast: bool = False) -> DataFrame:
    """One row for each operation; bytes that cannot be read give one row with ``error``."""
    return _decode(data, lambda raw: (list(document.expand(codec.decode_batch(raw), profile)), []), fail_fast)


def decode_logs(data: DataFrame, profile: str = "sha256") -> DataFrame:
    """The compact records of batches, named by recomputed ids and not expanded; bytes that cannot be read are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records = codec.decode_batch(raw)
                for r in records:
                    op = "after" if r["kind"] == "run" else r["kind"]
                    r["rec_id"] = PROFILES[profile](preimage(op, r["anchor"], (r["text"] or "")[:1], r["extra_deps"], r["targets"]))
                yield from _record_table(doc_id, records).to_batches()

    return data.select("doc_id", "bytes").mapInArrow(run, RECORDS)


def decode_snapshots(data: DataFrame, profile: str = "sha256", fail_fast: bool = False) -> DataFrame:
    """One row for each operation of each snapshot; errors as in ``decode_batches``."""
    return _decode(data, lambda raw: codec.decode_snapshot(raw, profile), fail_fast)


def decode_states(data: DataFrame, profile: str = "sha256") -> DataFrame:
    """The compact records of snapshots, orphans apart; bytes that cannot be read are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for orphan, own in zip((False, True), codec.decode_records(raw, profile), strict=True):
                    folded = document.fold(own, profile)
                    made = _record_table(doc_id, folded[0] if folded else document.compact(list(document.expand(own, profile))))
                    yield from made.append_column("orphan", pa.array([orphan] * len(made), pa.bool_())).to_batches()

    return data.select("doc_id", "bytes").mapInArrow(run, f"{RECORDS}, orphan boolean")


_BY_SECTION = "doc_id long, section string, n_bytes long, total long, unused_ids long"


def _section_rows(data: bytes) -> list[tuple]:
    sizes = codec.section_bytes(data)
    unused = sizes.pop("unused_ids")
    return [(k, v, len(data), unused) for k, v in sizes.items()]


def _by_section(snapshots: DataFrame) -> DataFrame:
    """(doc_id, section, n_bytes, total, unused_ids) for each section of each snapshot; if ``snapshots`` is such a table already, the same."""
    if "section" in snapshots.columns:
        return snapshots
    schema = to_arrow_schema(T.StructType.fromDDL(_BY_SECTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in _section_rows(raw)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return snapshots.select("doc_id", "bytes").mapInArrow(run, _BY_SECTION)


def _edited(doc: document.Document, profile: str) -> bytes | None:
    """The snapshot of a document that its own edits made; without operations there is none."""
    return _written(doc.records, False, profile, document.fold(doc.records, profile, doc.hashed())) if doc.records else None


def edited_sections(patches: DataFrame, profile: str = "sha256") -> DataFrame:
    """(doc_id, section, n_bytes, total, unused_ids) of the snapshot of the log that each document's patches make: the log
    is made, written and read in one task, which only these figures leave."""
    return by_document(patches, lambda doc: _section_rows(data) if (data := _edited(doc, profile)) else [], _BY_SECTION, profile)


def section_bytes(snapshots: DataFrame) -> DataFrame:
    """(doc_id, section, n_bytes, share): the size of each section of each snapshot; as the next, also from ``edited_sections``."""
    return _by_section(snapshots).select("doc_id", "section", "n_bytes", (F.col("n_bytes") / F.col("total")).alias("share"))


def section_check(snapshots: DataFrame) -> DataFrame:
    """(doc_id, whole, unused_ids): whether the sections take up all of a snapshot's bytes, and how many dictionary ids nothing names."""
    by_doc = _by_section(snapshots).groupBy("doc_id", "total").agg(F.sum("n_bytes").alias("n_bytes"), F.max("unused_ids").alias("unused_ids"))
    return by_doc.select("doc_id", (F.col("n_bytes") == F.col("total")).alias("whole"), "unused_ids")


def _layouts(log: DataFrame, rows_of, schema: str) -> DataFrame:
    """One grouped map over each document's operations (``NODES`` or ``RECORDS``): ``rows_of(layout)`` as rows with the document's id ahead."""
    compact = "kind" in log.columns
    names = [c.split()[0] for c in schema.split(", ")]

    def fold(group: pa.Table) -> pa.Table:
        rows = _log_rows(group) if compact else []
        folded = document.fold(rows) if compact else None
        found = rows_of(codec.Layout.of(*folded) if folded else codec.Layout({n[0]: n for n in document.expand(rows)}.values() if compact else _tuples(group)))
        doc_id = group["doc_id"][0].as_py()
        return pa.table({c: pa.array(column, pa.int64() if " long" in spec else pa.string()) for c, spec, column in zip(names, schema.split(", "), zip(*[(doc_id, *r) for r in found]) if found else [[]] * len(names), strict=True)})

    return (_log(log) if compact else log).groupBy("doc_id").applyInArrow(fold, schema)


def remove_ranges(log: DataFrame) -> DataFrame:
    """(doc_id, run_id, direction, first, last, length) from ``NODES`` or ``RECORDS``: chains of single removals along a run, each depending on the one before alone."""

    def rows(layout: codec.Layout) -> list[tuple]:
        out = []
        for chain in layout.chains:
            (run, first), (_, last) = layout.linked[chain[0]][1], layout.linked[chain[-1]][1]
            out.append((layout.runs[run]["rec_id"].hex(), "forward" if last > first else "backward", first, last, len(chain)))
        return out

    return _layouts(log, rows, "doc_id long, run_id string, direction string, first long, last long, length long")


def edited_ranges(patches: DataFrame) -> DataFrame:
    """(doc_id, run, direction, first, last, length): what ``remove_ranges`` finds in the log that each document's patches make, with runs by number instead of id.

    The ranges follow from which edit comes after which and from places, so nothing is hashed and no log is made.
    """

    def rows(doc: document.Document) -> list[tuple]:
        runs, removes = doc.single_removals()
        number = {run: i for i, run in enumerate(runs)}
        out = []
        for chain in codec.remove_ranges(removes):
            (run, first), (_, last) = removes[chain[0]][1], removes[chain[-1]][1]
            out.append((number[run], "forward" if last > first else "backward", first, last, len(chain)))
        return out

    return by_document(patches, rows, "doc_id long, run long, direction string, first long, last long, length long")


def remove_kinds(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, kind) of each removal: the kind of the one insertion it removes (run, before or root), else ``other``."""
    removes = nodes.where("op = 'remove'").select("doc_id", F.col("node_id").alias("remove_id"), F.when(F.size(F.array_distinct("targets")) == 1, F.get("targets", F.lit(0))).alias("node_id"))
    inserts = nodes.where("op <> 'remove'").select("doc_id", "node_id", F.when(F.col("op") == "after", "run").otherwise(F.col("op")).alias("kind"))
    joined = removes.join(inserts, ["doc_id", "node_id"], "left")
    return joined.select("doc_id", F.col("remove_id").alias("node_id"), F.coalesce("kind", F.lit("other")).alias("kind"))


def id_dictionary(log: DataFrame) -> DataFrame:
    """(doc_id, id, place) from ``NODES`` or ``RECORDS``: the ids that a snapshot of the operations names, in order.

    They are all extra dependencies, but those that a removal range implies, and the anchors of runs and of insertions before;
    inside a run, and for removed characters, places stand for ids.  Removals that have no place name their targets.
    """

    def rows(layout: codec.Layout) -> list[tuple]:
        implied = {n for chain in layout.chains for n in chain[1:]}
        named = {r["anchor"] for r in (*layout.runs, *layout.befores)}
        for r in (*layout.roots, *layout.runs, *layout.befores):
            named.update(r["extra_deps"])
        for i, n in layout.removes.items():
            named.update(() if i in implied else n[4], () if layout.target.get(i) else n[5])
        return [(x.hex(), k) for k, x in enumerate(sorted(named))]

    return _layouts(log, rows, "doc_id long, id string, place long")


def merge_encoded(nodes: DataFrame, snapshots: DataFrame, profile: str = "sha256") -> DataFrame:
    """A log together with the operations of other replicas' snapshots."""
    from .graph import merge

    theirs = decode_snapshots(snapshots, profile).where("error IS NULL").drop("orphan", "error")
    return merge(nodes, theirs)


def merge_encoded_logs(records: DataFrame, snapshots: DataFrame, profile: str = "sha256") -> DataFrame:
    """The same of compact logs: records together with those of snapshots.  Operations that several hold are still in each, as in any union of compact logs."""
    return records.unionByName(decode_states(snapshots, profile).drop("orphan"))
