"""Admission of operations that arrive in any order, as a stream.

State is kept by document: the ids that were admitted, the operations that wait, and for
each id that is lacking which of them it holds up.  A batch touches only what arrives in it and
what that sets free; a waiting operation is read when the dependency it was parked under is
admitted, and then parked under the next one it lacks.  No watermark can expire any of it without losing
operations, so they stay; the state store is RocksDB, which keeps them on disk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessellog.functions.hashing import PROFILES, preimage
from tessellog.functions.schemas import NODES

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """Emits each operation once, when all it depends on was emitted."""

    def __init__(self, profile: str = "sha256"):
        self.profile = profile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "node_id string", "op string")
        self.waiting = handle.getMapState("waiting", "node_id string", "body string")
        #: The operations that an id holds up are numbered, so that parking one more reads one number.
        self.held = handle.getMapState("held", "dep_id string, place long", "node_id string")
        self.n_held = handle.getMapState("n_held", "dep_id string", "n long")

    def _arrived(self, rows: Iterator[pd.DataFrame]) -> dict[str, dict]:
        sha, fresh = PROFILES[self.profile], {}
        for frame in rows:
            for r in frame.to_dict("records"):
                anchor = r["anchor"] if isinstance(r["anchor"], str) else None
                ch = r["ch"] if isinstance(r["ch"], str) else None
                extra, targets = ([] if x is None else list(x) for x in (r["extra_deps"], r["targets"]))
                raw = lambda xs: [bytes.fromhex(x) for x in xs]
                # An id is never taken on trust.
                node = sha(preimage(r["op"], bytes.fromhex(anchor) if anchor else None, ch, raw(extra), raw(targets))).hex()
                fresh[node] = {"op": r["op"], "anchor": anchor, "ch": ch, "extra_deps": extra, "targets": targets}
        return {i: n for i, n in fresh.items() if not self.known.containsKey((i,)) and not self.waiting.containsKey((i,))}

    def _freed(self, node: str) -> list[tuple[str, dict]]:
        """What was parked under ``node``, taken out of the state."""
        if not self.n_held.containsKey((node,)):
            return []
        out = []
        for k in range(self.n_held.getValue((node,))[0]):
            (held,) = self.held.getValue((node, k))
            out.append((held, json.loads(self.waiting.getValue((held,))[0])))
            self.held.removeKey((node, k))
            self.waiting.removeKey((held,))
        self.n_held.removeKey((node,))
        return out

    def _park(self, node: str, body: dict, lacking: str | None) -> None:
        self.waiting.updateValue((node,), (json.dumps(body),))
        if lacking is not None:
            n = self.n_held.getValue((lacking,))[0] if self.n_held.containsKey((lacking,)) else 0
            self.held.updateValue((lacking, n), (node,))
            self.n_held.updateValue((lacking,), (n + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ops: dict[str, str | None] = {}

        def op_of(node: str) -> str | None:
            if node not in ops:
                ops[node] = self.known.getValue((node,))[0] if self.known.containsKey((node,)) else None
            return ops[node]

        queue = sorted(self._arrived(rows).items(), reverse=True)
        out = []
        while queue:
            node, body = queue.pop()
            needs = dict.fromkeys([*([body["anchor"]] if body["anchor"] else []), *body["extra_deps"], *body["targets"]])
            lacking = next((d for d in needs if op_of(d) is None), None)
            # An insertion anchored on a removal waits for ever, and with it what depends on it.
            if lacking is None and body["anchor"] and op_of(body["anchor"]) == "remove":
                self._park(node, body, None)
            elif lacking is not None:
                self._park(node, body, lacking)
            else:
                ops[node] = body["op"]
                self.known.updateValue((node,), (body["op"],))
                out.append({"doc_id": key[0], "node_id": node, **body})
                queue += self._freed(node)
        yield pd.DataFrame(out, columns=["doc_id", "node_id", "op", "anchor", "ch", "extra_deps", "targets"])

    def close(self) -> None:
        pass


def admit_stream(log: DataFrame, profile: str = "sha256") -> DataFrame:
    """The admitted operations of a streaming log of ``NODES`` rows, in append mode."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return log.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Admission(profile), outputStructType=NODES, outputMode="Append", timeMode="None")
