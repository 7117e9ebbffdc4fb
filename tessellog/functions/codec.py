"""Binary forms of operations: batches and whole-state snapshots.

One description of fields serves writing, reading and measuring.  A batch is a
count and tagged records.  A snapshot is a dictionary of ids and nine sections whose
rows name ids by their place in the dictionary and removed characters by their place
in earlier sections; it holds only removals of one character each.  Others (of
several characters, of none, or of what is no insertion) follow in an extension of
this engine, which ``strict`` refuses.
"""

from __future__ import annotations

from collections.abc import Iterable

from . import document
from .hashing import PROFILES, preimage

# Fixed values of the formats: tags of operations, and the sections with their fields in order.
TAGS = {0: ("run", "id deps text"), 1: ("root", "deps char"), 2: ("before", "deps id char"), 3: ("remove", "deps targets"), 4: ("after", "deps id char")}
SECTIONS = [
    ("roots", "deps char"),
    ("runs", "id deps text"),
    ("befores", "deps id char"),
    ("forward_remove_runs", "deps num num num"),
    ("backward_remove_runs", "deps num num num"),
    ("single_run_removes", "deps num num"),
    ("before_removes", "deps num"),
    ("root_removes", "deps num"),
    ("orphans", ""),
]
_TAG_OF = {kind: tag for tag, (kind, _) in TAGS.items()}


class DecodeError(ValueError):
    """``kind`` is eof, varint, utf8, tag, empty_run, index or trailing."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


class Reader:
    """Reads fields from bytes; ids are whole, or places in ``ids`` if that is given."""

    def __init__(self, data: bytes):
        self.data, self.at, self.ids, self.used = data, 0, None, set()

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise DecodeError("eof")
        self.at += n
        return self.data[self.at - n : self.at]

    def num(self) -> int:
        value = 0
        for shift in range(0, 64, 7):
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                return value
        raise DecodeError("varint")

    def id(self) -> bytes:
        if self.ids is None:
            return self.take(32)
        place = self.num()
        if place >= len(self.ids):
            raise DecodeError("index")
        self.used.add(place)
        return self.ids[place]

    def deps(self) -> list[bytes]:
        return sorted({self.id() for _ in range(self.num())})

    targets = deps

    def char(self) -> str:
        lead = self.take(1)
        size = next((n for n, top, low in ((1, 0x7F, 0), (2, 0xDF, 0xC0), (3, 0xEF, 0xE0), (4, 0xF7, 0xF0)) if low <= lead[0] <= top), 0)
        if not size:
            raise DecodeError("utf8")
        return self.decoded(lead + self.take(size - 1))

    def text(self) -> str:
        out = self.decoded(self.take(self.num()))
        if not out:
            raise DecodeError("empty_run")
        return out

    @staticmethod
    def decoded(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            raise DecodeError("utf8") from None

    def row(self, fields: str) -> list:
        return [getattr(self, f)() for f in fields.split()]

    def tagged(self) -> tuple[str, list]:
        tag = self.take(1)[0]
        if tag not in TAGS:
            raise DecodeError("tag")
        kind, fields = TAGS[tag]
        return kind, self.row(fields)


class Writer:
    def __init__(self, ids: Iterable[bytes] | None = None):
        self.out = bytearray()
        self.place = None if ids is None else {x: varint(i) for i, x in enumerate(ids)}

    def put(self, fields: str, values: Iterable) -> None:
        ref = (lambda x: x) if self.place is None else self.place.__getitem__
        for f, v in zip(fields.split(), values, strict=True):
            if f == "num":
                self.out += varint(v)
            elif f == "id":
                self.out += ref(v)
            elif f in ("deps", "targets"):
                self.out += varint(len(set(v))) + b"".join(map(ref, sorted(set(v))))
            else:
                raw = v.encode()
                self.out += (varint(len(raw)) if f == "text" else b"") + raw

    def tagged(self, kind: str, values: Iterable) -> None:
        self.out.append(_TAG_OF[kind])
        self.put(TAGS[_TAG_OF[kind]][1], values)


def _values(record: dict) -> list:
    """A record's fields in the order of its tag."""
    own = {"id": record["anchor"], "deps": record["extra_deps"], "targets": record["targets"], "char": record["text"], "text": record["text"]}
    return [own[f] for f in TAGS[_TAG_OF[record["kind"]]][1].split()]


def _record(kind: str, values: list) -> dict:
    own = dict(zip(TAGS[_TAG_OF[kind]][1].split(), values, strict=True))
    return {"kind": kind, "anchor": own.get("id"), "text": own.get("text", own.get("char")), "extra_deps": own["deps"], "targets": own.get("targets", [])}


def encode_batch(records: Iterable[dict]) -> bytes:
    records, w = list(records), Writer()
    w.put("num", [len(records)])
    for r in records:
        w.tagged(r["kind"], _values(r))
    return bytes(w.out)


def decode_batch(data: bytes) -> list[dict]:
    """Records; their ids are left to ``document.expand``."""
    r = Reader(data)
    n = r.num()
    if n > len(data):  # a record takes a byte at least
        raise DecodeError("eof")
    return [_record(*r.tagged()) for _ in range(n)]


def _node(node: tuple) -> dict:
    _, op, anchor, ch, extra, targets = node
    return {"kind": op, "anchor": anchor, "text": ch, "extra_deps": extra, "targets": targets}


def remove_ranges(removes: dict[bytes, tuple[bytes | None, tuple[int, int]]]) -> list[list[bytes]]:
    """Chains of single removals along a run: each depends on the one before and takes the next character in one direction.

    ``removes`` gives each removal's only dependency (none if it has several or none) and its target's run and place; removals
    may go by numbers instead of ids.
    """
    after = {dep: node for node, (dep, _) in sorted(removes.items(), reverse=True) if dep is not None}
    step = {}
    for node, (_, (run, place)) in removes.items():
        follower = after.get(node)
        if follower is not None and removes[follower][1][0] == run and abs(removes[follower][1][1] - place) == 1:
            step[node] = (follower, removes[follower][1][1] - place)
    inner = {follower for follower, _ in step.values()}
    out = []
    for node in sorted(set(removes) - inner):
        chain, way = [node], 0
        while node in step:
            follower, direction = step[node]
            if way and direction != way:
                out.append(chain)
                chain, way = [], 0
            if chain:
                way = direction
            chain.append(follower)
            node = follower
        out.append(chain)
    return [c for c in out if len(c) > 1]


class Layout:
    """Where a state's operations (id, op, anchor, ch, extra_deps, targets) stand in a snapshot.

    ``place`` has each insertion's section and place, ``target`` that of each single removal's character (none if it
    is no insertion), ``linked`` the dependency and run place of removals inside runs, ``chains`` those that form ranges.
    """

    def __init__(self, nodes: Iterable[tuple]):
        nodes = sorted(nodes)
        records = document.compact(nodes)
        spots = {n: (r["rec_id"], k) for r in records if r["kind"] != "remove" for k, n in enumerate(r["ids"])}
        self._stand(records, spots, {n[0]: n for n in nodes if n[1] == "remove"})

    @classmethod
    def of(cls, records: list[dict], spots: dict[bytes, tuple[bytes, int]]) -> Layout:
        """The layout from what ``document.fold`` gives, with ``place`` for named insertions alone."""
        self = cls.__new__(cls)
        self._stand(records, spots, {r["rec_id"]: (r["rec_id"], "remove", None, None, r["extra_deps"], r["targets"]) for r in records if r["kind"] == "remove"})
        return self

    def _stand(self, records: list[dict], spots: dict[bytes, tuple[bytes, int]], removes: dict[bytes, tuple]) -> None:
        self.roots, self.runs, self.befores = ([r for r in records if r["kind"] == kind] for kind in ("root", "run", "before"))
        number = {r["rec_id"]: (kind, i) for kind, rows in (("root", self.roots), ("run", self.runs), ("before", self.befores)) for i, r in enumerate(rows)}
        self.place: dict[bytes, tuple] = {n: (*number[rec], k) if number[rec][0] == "run" else number[rec] for n, (rec, k) in spots.items()}
        self.removes = removes
        self.target = {i: self.place.get(n[5][0]) for i, n in self.removes.items() if len(n[5]) == 1}
        self.linked = {i: (self.removes[i][4][0] if len(self.removes[i][4]) == 1 else None, p[1:]) for i, p in self.target.items() if p and p[0] == "run"}
        self.chains = remove_ranges(self.linked)


def encode_snapshot(nodes: Iterable[tuple], orphans: Iterable[tuple] = (), strict: bool = False) -> bytes:
    """Bytes of the operations (id, op, anchor, ch, extra_deps, targets), the same for the same set."""
    return write_snapshot(Layout(nodes), orphans, strict)


def write_snapshot(layout: Layout, orphans: Iterable[tuple] = (), strict: bool = False) -> bytes:
    """Bytes of a state that is laid out."""
    orphans = sorted(orphans)
    removes, target, linked = layout.removes, layout.target, layout.linked
    rows: dict[str, list] = {name: [] for name, _ in SECTIONS}
    rows["roots"] = [[r["extra_deps"], r["text"]] for r in layout.roots]
    rows["runs"] = [[r["anchor"], r["extra_deps"], r["text"]] for r in layout.runs]
    rows["befores"] = [[r["extra_deps"], r["anchor"], r["text"]] for r in layout.befores]
    done = set()
    for chain in layout.chains:
        (run, first), (_, last) = linked[chain[0]][1], linked[chain[-1]][1]
        rows["forward_remove_runs" if last > first else "backward_remove_runs"].append([removes[chain[0]][4], run, first, last])
        done.update(chain)
    extension = []
    for i, n in removes.items():
        p = target.get(i)
        if i in done:
            continue
        if p:
            rows[{"run": "single_run_removes", "before": "before_removes", "root": "root_removes"}[p[0]]].append([n[4], *p[1:]])
        else:
            extension.append(n)
    if extension and strict:
        raise ValueError("a removal of several characters, or of none, has no place in the strict format")
    whole = Writer()
    ids = {x for name, fields in SECTIONS for row in rows[name] for f, v in zip(fields.split(), row) for x in ([v] if f == "id" else v if f == "deps" else [])}
    for n in (*orphans, *extension):
        ids |= {*n[4], *n[5], *([n[2]] if n[2] else [])}
    whole.put("num", [len(ids)])
    body = Writer(sorted(ids))
    for name, fields in SECTIONS[:-1]:
        body.put("num", [len(rows[name])])
        for row in rows[name]:
            body.put(fields, row)
    for part in (orphans, extension)[: 2 if extension else 1]:
        body.put("num", [len(part)])
        for n in part:
            body.tagged(n[1], _values(_node(n)))
    return bytes(whole.out + b"".join(sorted(ids)) + body.out)


def _sections(data: bytes) -> tuple[dict[str, list], dict[str, int], Reader]:
    r = Reader(data)
    n = r.num()
    if n > (len(data) - r.at) // 32:
        raise DecodeError("eof")
    r.ids = [r.take(32) for _ in range(n)]
    rows: dict[str, list] = {}
    sizes = {"dictionary": r.at}
    for name, fields in SECTIONS:
        start = r.at
        rows[name] = [r.row(fields) if fields else r.tagged() for _ in range(r.num())]
        sizes[name] = r.at - start
    start = r.at
    rows["extension"] = [r.tagged() for _ in range(r.num())] if r.at < len(data) else []
    sizes["extension"] = r.at - start
    if r.at < len(data):
        raise DecodeError("trailing")
    return rows, sizes, r


def decode_records(data: bytes, profile: str = "sha256") -> tuple[list[dict], list[dict]]:
    """The records of a snapshot as its sections have them, and those of its orphans; runs are hashed as far as a removal names them."""
    rows, _, _ = _sections(data)
    sha = PROFILES[profile]
    roots, runs, befores = ([_record(kind, x) for x in rows[name]] for kind, name in (("root", "roots"), ("run", "runs"), ("before", "befores")))
    head = lambda r: sha(preimage("after" if r["kind"] == "run" else r["kind"], r["anchor"], r["text"][0], r["extra_deps"], ()))
    ids: dict[int, list[bytes]] = {}
    out = [*roots, *runs, *befores]

    def remove(deps: list[bytes], target: bytes) -> bytes:
        out.append({"kind": "remove", "anchor": None, "text": None, "extra_deps": deps, "targets": [target]})
        return sha(preimage("remove", None, None, deps, [target]))

    def in_run(run: int, k: int) -> bytes:
        if not 0 <= k < len(runs[run]["text"]):
            raise DecodeError("index")
        own = ids.setdefault(run, [head(runs[run])])
        document.follow(own, runs[run]["text"], k, sha)
        return own[k]

    try:
        for name, way in (("forward_remove_runs", 1), ("backward_remove_runs", -1)):
            for deps, run, first, last in rows[name]:
                for k in range(first, last + way, way):
                    deps = [remove(deps, in_run(run, k))]
        for deps, run, k in rows["single_run_removes"]:
            remove(deps, in_run(run, k))
        for name, rows_of in (("before_removes", befores), ("root_removes", roots)):
            for deps, k in rows[name]:
                remove(deps, head(rows_of[k]))
    except IndexError:
        raise DecodeError("index") from None
    out += [_record(kind, fields) for kind, fields in rows["extension"]]
    return out, [_record(kind, fields) for kind, fields in rows["orphans"]]


def decode_snapshot(data: bytes, profile: str = "sha256") -> tuple[list[tuple], list[tuple]]:
    """The operations of a snapshot, and its orphans; all ids are recomputed."""
    own, orphans = decode_records(data, profile)
    return list(document.expand(own, profile)), [next(document.expand([r], profile)) for r in orphans]


def section_bytes(data: bytes) -> dict[str, int]:
    """Bytes of each section, the runs' text apart, and the number of dictionary ids that nothing names."""
    rows, sizes, r = _sections(data)
    text = sum(len(x[2].encode()) for x in rows["runs"])
    return sizes | {"runs": sizes["runs"] - text, "runs_text": text, "unused_ids": len(r.ids) - len(r.used)}
