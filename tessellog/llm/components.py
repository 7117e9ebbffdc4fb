"""Connected components of a link table, without collecting it.

Every node takes the smallest label among its own and its neighbours', then the
label of that label, until nothing changes.  Each round is a table in the shared
folder; the driver sees only the numbers of nodes, links and changes.  At most ``FEW_LINKS`` links
are one task's work: rounds over so little cost jobs, whose threads and plans fill the driver's memory.  Labels are broadcast while they are few; beyond, a hub's links, and the members
of a giant component, which share a label, are dealt to several tasks in every join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, mapped, written

#: Up to this many links (16 bytes each) are joined in one task; beyond, in rounds over all of them.
FEW_LINKS = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all links (a, b) of a task."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): the smallest node each can reach."""
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    if links.count() <= FEW_LINKS:
        return written(mapped(links.coalesce(1), _joined, "node long, label long"), "labels")
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    n_links, n_nodes = both.count(), labels.count()
    while True:
        near = dealt(both, labels.withColumnRenamed("node", "b"), ["b"], total=n_links, n_one=n_nodes).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        low = dealt(labels, far, ["label"], total=n_nodes, n_one=n_nodes).join(near, "node")
        after = written(low.select("node", F.col("label").alias("was"), F.least("label", "near", "far").alias("label")), "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
