"""One replica of one document, with the calls that an editor makes."""

from __future__ import annotations

from . import codec, document


class Peer:
    """Edits at positions, text, bytes of the state, and merging of another's bytes."""

    def __init__(self, profile: str = "sha256"):
        self.profile = profile
        self.nodes: dict[bytes, tuple] = {}
        self.orphans: dict[bytes, tuple] = {}
        self.doc = document.Document(profile)

    def _sync(self) -> None:
        for n in document.expand(self.doc.records, self.profile):
            self.nodes[n[0]] = n
        self.doc.records = []

    def insert(self, at: int, text: str) -> None:
        self.doc.insert(at, text)
        self._sync()

    def remove(self, at: int, n: int = 1) -> None:
        self.doc.remove(at, n)
        self._sync()

    def apply(self, nodes) -> None:
        """Takes operations in any order; those that lack a dependency wait as orphans, and
        insertions anchored on a removal are ignored."""
        waiting = self.orphans | {n[0]: n for n in nodes if n[0] not in self.nodes}
        fresh = document.admit({i: (n[1], n[2], n[4], n[5]) for i, n in waiting.items()}, set(self.nodes))
        for i in fresh:
            n = waiting.pop(i)
            anchor = self.nodes.get(n[2])
            if anchor is None or anchor[1] != "remove":
                self.nodes[i] = n
        self.orphans = waiting
        if fresh:
            self._load()

    def _load(self) -> None:
        doc = self.doc = document.Document(self.profile)
        used: set[bytes] = set()
        gone: set[bytes] = set()
        for n in self.nodes.values():
            used.update(n[4], n[5], [n[2]] if n[2] else [])
            gone.update(n[5])
        doc.other_tips = set(self.nodes) - used
        place: dict[bytes, int] = {}
        chains = [r for r in document.compact(list(self.nodes.values())) if r["kind"] != "remove"]
        for c, r in enumerate(chains):
            ids = [n[0] for n in document.expand([r], self.profile)]
            doc.chains.append(document.Chain("after" if r["kind"] == "run" else r["kind"], None, r["text"], ids))
            place.update((x, (c << document.SHIFT) + k) for k, x in enumerate(ids))
        below: dict[int, list[document.Chain]] = {}
        for chain, r in zip(doc.chains, chains):
            chain.anchor = place.get(r["anchor"])
            below.setdefault(-1 if chain.anchor is None else chain.anchor >> document.SHIFT, []).append(chain)
        number = {id(chain): c for c, chain in enumerate(doc.chains)}
        open_chains = list(below.get(-1, ()))
        while open_chains:
            chain = open_chains.pop()
            doc.hang(chain)
            open_chains += below.get(number[id(chain)], ())
        doc.removed = {place[x] for x in gone if x in place}
        doc.reorder()

    @property
    def text(self) -> str:
        return self.doc.text()

    def __len__(self) -> int:
        return len(self.doc.visible)

    def __eq__(self, other) -> bool:
        return self.doc.tips == other.doc.tips

    def encode(self, strict: bool = False) -> bytes:
        return codec.encode_snapshot(self.nodes.values(), self.orphans.values(), strict)

    def merge_encoded(self, data: bytes) -> None:
        nodes, orphans = codec.decode_snapshot(data, self.profile)
        self.apply([*nodes, *orphans])
