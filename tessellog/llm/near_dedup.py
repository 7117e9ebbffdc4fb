"""Near-duplicates by a chosen-path set similarity join.

Texts with equal shingle sets form a class, found by a 128-bit fingerprint; the
join runs over classes, so copies of one text cost one entry.  Independent trees
branch the classes: on each level a node's classes part by their next minwise
token, so two sets stay together with the probability of their similarity, and
unrelated ones part at once.  There are as many trees as ``recall`` asks for at the
threshold and at full depth.  Nodes of at most ``LEAF`` classes are compared
exhaustively; larger ones branch on, after the first level has compared all to a few
pivots, twice.  What is in one component already is not compared again, so most of a
large group of near copies is settled by pivots and drops out.

Nodes that are still large and mixed after ``DEPTH`` levels are joined exactly.  Sets of
the wanted similarity share one of their rarest shingles, as many of them as the sets may
differ in; classes that share one form a group of their own, small groups are compared
exhaustively, and what large ones still mix is compared on full sets in blocks of at most
about ``BLOCK_SETS`` sets and ``BLOCK_SHINGLES`` shingles.  So nothing is cut off.

A comparison first looks at the sets' sizes and at 64 one-byte minwise values, which
keep a pair at the threshold with a probability above 0.99999; every link is then
confirmed on the full shingle sets of the whole texts.

Texts without words have an empty set and are linked with nothing.  Nulls count as
empty.  Rows without an id are linked like others; a component of such rows alone has
no id.  Repeated rows are of one class; rows that share a doc_id but not a text are
of several.  A very long text is one set like any other.  Only (doc_id, text) are
read, whatever other columns there are.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import BROADCAST_BYTES, FEW_ROWS, dealt, fresh, mapped, parts, scratch, small_batches, without, written
from .components import components

#: Of the pairs at the threshold, the share that the trees bring together, if all nodes branch to full depth.
RECALL = 0.9998
DEPTH = 3
LEAF = 64
#: Classes that the others of a large node are compared with.
PIVOTS = 4
#: Pivots of all its large nodes that a class is confirmed with.
BEST = 4
#: Sets, and shingles (8 bytes each), that a block of a large node has, about.
BLOCK_SETS = 1000
BLOCK_SHINGLES = 150_000
#: Pairs of a cell (some 30 bytes each) that are judged at a time.
CELL_PAIRS = 100_000
SKETCH = 64
#: Equal bytes of two sketches from which a pair is confirmed on its full sets.
AGREE = 35
#: Up to this many classes (about 40 bytes each) are broadcast to find their texts; beyond, the join is shuffled.
BROADCAST_CLASSES = 200_000
#: Counters by which shingles are ranked from rare to common; all of them come to the driver.
COUNTERS = 1 << 18
#: Shingles (8 bytes each) that a task counts, about: several for each counter, as every task gives a row for each counter it has met.
COUNTED = 4 * COUNTERS


def trees_for(recall: float, percent: int) -> int:
    """Trees in one of which, with a probability of ``recall``, two sets at the threshold stay together to full depth."""
    trees = math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** DEPTH))
    if not 1 <= trees <= 63:
        raise ValueError("this recall takes fewer than 1 or more than 63 trees")
    return trees


def signatures(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """(doc_id, n, cls, path, sketch) for every row: set size, fingerprint, minwise tokens of the trees, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                m = part.num_rows
                h, o = shingles.sets(part.column(1).to_pylist(), k)
                low = shingles.minima(h, o, m, max(SKETCH, trees * DEPTH))
                path = pa.FixedSizeListArray.from_arrays(pa.array(low[:, : trees * DEPTH].astype(np.int64).ravel()), trees * DEPTH)
                sketch = [row.tobytes() for row in low[:, :SKETCH].astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(shingles.sizes(o, m)),
                        pa.array(shingles.fingerprints(h, o, m), pa.binary()),
                        path.cast(pa.list_(pa.int64())),
                        pa.array(sketch, pa.binary()),
                    ],
                    names=["doc_id", "n", "cls", "path", "sketch"],
                )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, cls binary, path array<long>, sketch binary")


def _agreeing(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Equal bytes of the sketches of each pair; 0 where the sets' sizes differ too much."""
    near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    out = np.zeros(len(i), dtype=np.int64)
    out[near] = (sketch[i[near]] == sketch[j[near]]).sum(axis=1)
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    """The sketches of an Arrow column, which are of one length each, without a copy."""
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[: (column.offset + len(column)) * SKETCH].reshape(-1, SKETCH)[column.offset :]


def leaf_pairs(leaves: DataFrame, percent: int, trees: int) -> DataFrame:
    """Candidates (a, b) within each row's ``members`` that are of two components.

    Members: (num, label, n, sketch, tree, keys); all pairs are compared.  ``keys`` holds the member's node in every tree (0: none that is compared now); a
    pair that meets in several trees is given by the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            num, label, n, tree = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("num", "label", "n", "tree"))
            sketch = _sketches(flat.field("sketch"))
            keys = flat.field("keys").flatten().to_numpy().reshape(-1, trees)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(num)) - 1  # members of the list that follow
            for step in range(1, int(sizes.max(initial=0))):
                i = np.flatnonzero(left >= step)
                for part in np.array_split(i, len(i) // 50_000 + 1):
                    j = part + step
                    use = label[part] != label[j]
                    a, b = part[use], j[use]
                    near = _agreeing(n, sketch, a, b, percent) >= AGREE
                    a, b = a[near], b[near]
                    met = (keys[a] == keys[b]) & (keys[a] != 0) & (np.arange(trees) < tree[a][:, None])
                    first = ~met.any(axis=1)
                    a, b = num[a[first]], num[b[first]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return mapped(leaves.select("members"), run, "a long, b long").distinct()


def pivot_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): each row (num, size, label, n, sketch) with those of its ``pivots`` that are of another component.

    The sketches are compared here, so a pair that differs never becomes a row.  The pivots of all its
    large nodes are dealt into ``BEST`` parts, and of each the class meets the one that agrees best: a few links take it out of the
    group, whose other pivots are linked as well.  What these do not join stays in its nodes, where the next comparisons find it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num, label, n = (batch.column(c).to_numpy() for c in ("num", "label", "n"))
            large = batch.column("size").to_numpy() > LEAF
            lists = batch.column("pivots")
            row = np.repeat(np.arange(len(num)), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            p_num, p_label, p_n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("num", "label", "n"))
            sketch = np.concatenate([_sketches(batch.column("sketch")), _sketches(flat.field("sketch"))])
            sizes = np.concatenate([n, p_n])
            at = np.flatnonzero(label[row] != p_label)
            for part in np.array_split(at, len(at) // 50_000 + 1):
                agree = _agreeing(sizes, sketch, row[part], part + len(num), percent)
                part, agree = part[agree >= AGREE], agree[agree >= AGREE]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (num[row[part]], p_num[part], agree, large[row[part]])], names=["num", "pivot", "agree", "large"])

    found = mapped(met.select("num", "size", "label", "n", "sketch", "pivots"), run, "num long, pivot long, agree long, large boolean")
    part = F.when(F.col("large"), F.pmod(F.xxhash64("pivot"), F.lit(BEST)) - BEST).otherwise(F.col("pivot"))
    best = found.groupBy("num", part.alias("part")).agg(F.max(F.struct("agree", "pivot")).alias("best"))
    return best.select(F.least("num", "best.pivot").alias("a"), F.greatest("num", "best.pivot").alias("b")).distinct()


def found_texts(ends: DataFrame, most: int, classes: DataFrame, nameless: bool, docs: DataFrame, k: int) -> DataFrame:
    """(num, text): a text of each of the classes ``ends`` (num), of which there are ``most`` at most.

    It is found by the class's id, or, where ``nameless`` says that some have none, by its fingerprint.
    """
    wanted = ends.join(classes.select("num", "cls", "cid"), "num")
    few = most <= BROADCAST_CLASSES
    own = docs.select(F.col("doc_id").cast("long").alias("cid"), "text")

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                prints = shingles.fingerprints(*shingles.sets(part.column("text").to_pylist(), k), part.num_rows)
                keep = [a == b for a, b in zip(prints, part.column("cls").to_pylist(), strict=True)]
                yield part.select(["num", "text"]).filter(pa.array(keep, pa.bool_()))

    found = mapped(own.join(F.broadcast(wanted) if few else wanted, "cid").select("num", "cls", "text"), matching, "num long, text string")
    if nameless:
        printed = with_fingerprint(own.where("cid IS NULL").select("text"), k, "cls")
        without_id = wanted.where("cid IS NULL").select("num", "cls")
        found = found.union(printed.join(F.broadcast(without_id) if few else without_id, "cls").select("num", "text"))
    # A repeated row, or one of equal shingles and another text under one id, gives a second text of the class.
    return written(found.groupBy("num").agg(F.min("text").alias("text")), "texts")


def with_fingerprint(docs: DataFrame, k: int, name: str) -> DataFrame:
    """``docs`` with the fingerprint of its text's set, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                h, o = shingles.sets(part.column("text").to_pylist(), k)
                empty = shingles.sizes(o, part.num_rows) == 0
                prints = [None if e else p for e, p in zip(empty, shingles.fingerprints(h, o, part.num_rows))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.binary())], names=[*part.schema.names, name])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def shingle_sets(k: int):
    """A map from (num, text) to (num, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                h, o = shingles.sets(part.column("text").to_pylist(), k)
                ends = np.concatenate([[0], np.cumsum(shingles.sizes(o, part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("num"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["num", "shingles"])

    return run


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(key, num): of each set (num, shingles) its rarest shingles, one more than it may lack of a set at the threshold.

    Two sets of the wanted similarity have one of these in common.  Shingles are ranked by ``COUNTERS``
    hashed counts; any order would be right, and a rare shingle that shares a counter with a common one only makes larger groups.
    All are counted, in as many tasks as they are work for, however many files the sets are in.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().view(np.uint64) % np.uint64(COUNTERS)
            total += np.bincount(values.astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])

    tasks = math.ceil((sets.agg(F.sum(F.size("shingles"))).first()[0] or 1) / COUNTED)
    counts = mapped(sets.select("shingles").coalesce(tasks), counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[np.asarray(counts["counter"])] = np.asarray(counts["n"])
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            own, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            n = shared.value[(own.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)]
            order = np.lexsort((own, n, owner))
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            take = size + (-percent * size) // 100 + 1
            rare = order[place < np.repeat(take, size)]
            yield pa.RecordBatch.from_arrays([pa.array(own[rare]), pa.array(batch.column("num").to_numpy()[owner[rare]])], names=["key", "num"])

    return mapped(sets.select("num", "shingles"), run, "key long, num long")


def _overlaps(values: np.ndarray, owner: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Intersection sizes of each asking set with each other set of a cell; ``owner`` is ascending."""
    _, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
    use = counts[ids] > 1
    place = np.cumsum(counts > 1) - 1  # shared shingles, numbered
    ids, owner = place[ids[use]], owner[use]
    row = np.where(ask, np.cumsum(ask) - 1, np.cumsum(~ask) - 1)
    out = np.zeros((int(ask.sum()), int((~ask).sum())), dtype=np.float32)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, 2048):
        a, b = np.searchsorted(ids, [lo, lo + 2048])
        own, column = owner[a:b], ids[a:b] - lo
        sides = []
        for which, n in ((ask[own], out.shape[0]), (~ask[own], out.shape[1])):
            m = np.zeros((n, 2048), dtype=np.float32)
            m[row[own[which]], column[which]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between asking members of each cell and its others, as many as join their components.

    All pairs of a cell are judged, about ``CELL_PAIRS`` at a time; those that links of earlier ones have joined already are left out of the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                flat = members.values
                num, label, ask = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("num", "label", "ask"))
                lists = flat.field("shingles")
                size = np.asarray(lists.value_lengths()).astype(np.int64)
                ask = ask.astype(bool)
                both = _overlaps(lists.flatten().to_numpy(), np.repeat(np.arange(len(num)), size), ask)
                asks, rows = np.flatnonzero(ask), np.flatnonzero(~ask)
                _, group = np.unique(label, return_inverse=True)  # components, numbered
                root = list(range(len(num)))

                def top(x: int, root: list[int] = root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                found = []
                step = max(1, CELL_PAIRS // max(1, len(rows)))
                for lo in range(0, len(asks), step):
                    own, shared = asks[lo : lo + step], both[lo : lo + step].astype(np.int64)
                    near = 100 * shared >= percent * (size[own][:, None] + size[rows][None, :] - shared)
                    near &= group[own][:, None] != group[rows][None, :]
                    i, j = (x[y] for x, y in zip((own, rows), np.nonzero(near)))
                    _, first = np.unique(group[i] * len(num) + group[j], return_index=True)
                    for x, y in zip(i[first].tolist(), j[first].tolist()):
                        a, b = top(int(group[x])), top(int(group[y]))
                        if a != b:
                            root[a] = b
                            found.append((int(min(num[x], num[y])), int(max(num[x], num[y]))))
                    if len(first):
                        group = np.array([top(x) for x in range(len(num))])[group]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return mapped(cells.select("members"), run, "a long, b long").distinct()


def confirm(pairs: DataFrame, total: int, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the ``total`` candidate pairs of classes that are linked, by the full shingle sets of ``texts`` (num, text)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text_a", "text_b"):
                n_a, n_b, both = shingles.common(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), k)
                yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * (n_a + n_b - both)))

    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    for c in ("b", "a"):
        counts = pairs.groupBy(c).agg(F.count("*").alias("n"))
        own = texts.select(F.col("num").alias(c), F.col("text").alias(f"text_{c}"))
        joined = dealt(pairs if c == "b" else joined, own, [c], counts=counts, total=total, n_one=size["n"], width=40 + (size["bytes"] or 0) // max(1, size["n"]))
    return mapped(joined.select("a", "b", "text_a", "text_b"), linked, "a long, b long")


class _Join:
    """The state of one join: classes, the components that links have made so far, and how many links each class has."""

    def __init__(self, classes: DataFrame, docs: DataFrame, k: int, percent: int, trees: int):
        self.nameless = not classes.where("cid IS NULL AND n > 0").isEmpty()
        self.classes, self.docs, self.k, self.percent, self.trees = classes, docs, k, percent, trees
        self.sketches = classes.select("num", "n", "sketch")
        self.labels: DataFrame | None = None
        self.n_labels = 0
        #: Nodes that the last ``mixed`` found, and how many of them are large.
        self.n_keys = self.n_large = 0
        self.links: list[DataFrame] = []

    def labelled(self, nodes: DataFrame, hot: bool = False) -> DataFrame:
        """``nodes`` with each class's component; before any link it is a component of its own.

        ``hot``: a class may have very many of the rows, which are a written table.
        """
        if self.labels is None:
            return nodes.withColumn("label", F.col("num"))
        return self.linked(nodes, hot).withColumn("label", F.coalesce("label", "num"))

    def linked(self, nodes: DataFrame, hot: bool = False) -> DataFrame:
        """As ``labelled``, but null for a class that no link was found of."""
        labels = self.labels.select(F.col("node").alias("num"), "label")
        small = self.n_labels * 16 <= BROADCAST_BYTES
        return dealt(nodes, labels, ["num"], "left", n_one=self.n_labels, width=16) if hot or small else nodes.join(labels, "num", "left")

    def named(self, ids: DataFrame) -> DataFrame:
        """(cls, label, component_id) for all classes ``ids`` (num, cls, cid); only linked ones need to meet their components' other classes."""
        alone = (F.col("cls"), F.col("num").alias("label"), F.col("cid").alias("component_id"))
        if self.labels is None:
            return ids.select(*alone)
        member = written(self.linked(ids), "members")
        linked = member.where("label IS NOT NULL")
        smallest = linked.groupBy("label").agg(F.min("cid").alias("component_id"))
        return dealt(linked, smallest, ["label"], total=self.n_labels).select("cls", "label", "component_id").union(member.where("label IS NULL").select(*alone))

    def with_degree(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with how many links of the class were found so far."""
        if not self.links:
            return nodes.withColumn("degree", F.lit(0).cast("long"))
        ends = reduce(DataFrame.union, self.links).select(F.explode(F.array("a", "b")).alias("num")).groupBy("num").agg(F.count("*").alias("degree"))
        return nodes.join(ends, "num", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))

    def add(self, candidates: DataFrame) -> None:
        pairs = written(candidates, "candidates")
        total = pairs.count()
        if total:
            self.link(confirm(pairs, total, self.texts(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct(), 2 * total), self.k, self.percent))

    def texts(self, ends: DataFrame, most: int) -> DataFrame:
        return found_texts(ends, most, self.classes, self.nameless, self.docs, self.k)

    def link(self, confirmed: DataFrame) -> None:
        """Takes links in: what they join of the components so far is joined, by a graph of those alone."""
        new = written(confirmed, "confirmed")
        self.links.append(new)
        one = self.labelled(new.select(F.col("a").alias("num"), "b"), hot=True).select(F.col("label").alias("a"), F.col("b").alias("num"))
        if self.labels is not None and new.count() > FEW_ROWS:
            one = written(one, "ends")
        joined = components(self.labelled(one, hot=True).select("a", F.col("label").alias("b")).where("a <> b").distinct())
        if self.labels is None:
            self.labels, self.n_labels = joined, joined.count()
            return
        to = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
        old = dealt(self.labels, to, ["label"], "left").select("node", F.coalesce("to", "label").alias("label"))
        self.labels = written(old.union(joined.join(self.labels, "node", "left_anti")), "labels")
        self.n_labels = self.labels.count()

    def mixed(self, nodes: DataFrame) -> DataFrame:
        """The rows of nodes (key, num) with several components, with the node's size and the row's component."""
        own = written(self.labelled(nodes.select("key", "num")), "placed")
        stats = own.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("size > 1")
        stats = written(stats.select("key", "size", (F.col("low") != F.col("high")).alias("several")), "sizes")
        several = stats.where("several").select("key", "size")
        found = several.agg(F.count("*").alias("keys"), F.count_if(F.col("size") > LEAF).alias("large")).first()
        self.n_keys, self.n_large = found["keys"], found["large"]
        return written(dealt(own, several, ["key"], n_one=self.n_keys, width=16, counts=stats.select("key", F.col("size").alias("n"))), "nodes")

    def stars(self, nodes: DataFrame) -> None:
        """Compares the classes of each node with its pivots: one, or ``PIVOTS`` in a large node.

        A pivot is, of its share of the node, the class with the most links so far; so
        in a cloud of copies the middle comes up.
        """
        large = F.col("size") > LEAF
        members = nodes.join(self.sketches, "num")
        share = F.when(large, F.pmod(F.xxhash64("num", "key"), F.lit(PIVOTS))).otherwise(0)
        draw = F.when(large, F.xxhash64("key", "num")).otherwise(-F.col("num"))
        best = F.struct("degree", draw.alias("draw"), "num", "label", "n", "sketch")
        ranked = self.with_degree(members).select("key", share.alias("share"), best.alias("best"))
        each = ranked.groupBy("key").agg(*[F.max(F.when(F.col("share") == i, F.col("best"))).alias(f"p{i}") for i in range(PIVOTS)])
        pivots = each.select("key", F.array_compact(F.array(*[F.when(F.col(f"p{i}").isNotNull(), F.struct(*[F.col(f"p{i}.{c}").alias(c) for c in ("num", "label", "n", "sketch")])) for i in range(PIVOTS)])).alias("pivots"))
        met = dealt(members, pivots, ["key"], counts=nodes.groupBy("key").agg(F.count("*").alias("n")), total=nodes.count(), n_one=self.n_keys, width=PIVOTS * (SKETCH + 60))
        self.add(pivot_pairs(met, self.percent))

    def leaves(self, nodes: DataFrame) -> None:
        """Compares all classes of each node (key, num, label, tree)."""
        slots = F.array(*[F.coalesce(F.max(F.when(F.col("tree") == t, F.col("key"))), F.lit(0)).cast("long") for t in range(self.trees)])
        keys = nodes.groupBy("num").agg(slots.alias("keys"))
        full = nodes.join(self.sketches, "num").join(keys, "num")
        member = F.struct("num", "label", "n", "sketch", "tree", "keys")
        self.add(leaf_pairs(full.groupBy("key").agg(F.collect_list(member).alias("members")), self.percent, self.trees))

    def rest(self, nodes: DataFrame) -> None:
        """Compares what large nodes (key, num) of the last level still mix, so that no similar pair of a node is missed."""
        ends = nodes.select("num").distinct()
        sets = written(mapped(self.texts(ends, nodes.count()), shingle_sets(self.k), "num long, shingles array<long>"), "sets")
        groups = self.mixed(written(rare_shingles(sets, self.percent), "rare"))
        # The groups are of one kind, so none counts as another's earlier tree.
        self.leaves(groups.where(f"size <= {LEAF}").withColumn("tree", F.lit(0)))
        if self.n_large:
            groups = self.mixed(groups.where(f"size > {LEAF}"))
        if self.n_large:
            hard = groups.select("num").distinct()
            self.blocks(self.mixed(written(nodes.select("key", "num").join(hard, "num", "left_semi"), "hard")), sets)

    def blocks(self, nodes: DataFrame, sets: DataFrame) -> None:
        """Compares, in each node, what is outside the main component with all, in blocks, on full sets.

        The main component is that of the class with the most links.  A block holds
        about ``BLOCK_SETS`` sets and ``BLOCK_SHINGLES`` shingles at most, or one longer set; every block of the
        outside meets every block of the node in a cell of its own.
        """
        own = written(self.with_degree(nodes).join(self.sketches.select("num", "n"), "num"), "linked")
        best = own.groupBy("key").agg(F.max(F.struct("degree", "label")).alias("best")).select("key", F.col("best.label").alias("main"))
        own = written(dealt(own, best, ["key"]).withColumn("ask", F.col("label") != F.col("main")), "asking")

        def count(use):
            return F.ceil(F.greatest(F.sum(F.when(use, F.col("n"))) / BLOCK_SHINGLES, F.count_if(use) / BLOCK_SETS)).cast("long")

        grid = own.groupBy("key").agg(count(F.lit(True)).alias("rows"), count(F.col("ask")).alias("asks"))
        own = written(dealt(own, grid, ["key"]).select("key", "num", "label", "ask", "rows", "asks"), "blocks")
        sides = []
        for ask, members, mine, other in ((False, own, "rows", "asks"), (True, own.where("ask"), "asks", "rows")):
            block = F.pmod(F.xxhash64("num"), F.col(mine))
            placed = members.select("key", "num", "label", block.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("y"))
            cell = F.struct("key", "y", "x") if ask else F.struct("key", "x", "y")
            sides.append(placed.select(F.xxhash64(cell).alias("cell"), "num", "label", F.lit(ask).alias("ask")))
        full = dealt(written(sides[0].union(sides[1]), "cells"), sets, ["num"])
        cells = full.groupBy("cell").agg(F.collect_list(F.struct("num", "label", "ask", "shingles")).alias("members"))
        self.link(cell_links(cells, self.percent))

    def run(self) -> None:
        parted = F.expr(f"posexplode(transform(sequence(0, {self.trees - 1}), t -> path[t * {DEPTH}]))")
        first = self.classes.where("n > 0").select("num", parted).select((F.col("pos").cast("long") * (1 << 32) + F.col("col")).alias("key"), "num")
        nodes = self.mixed(first)
        if self.n_keys:
            self.stars(nodes)
            nodes = self.mixed(nodes)
        if self.n_large:
            self.stars(nodes.where(f"size > {LEAF}"))
            nodes = self.mixed(nodes)
        for depth in range(DEPTH):
            treed = nodes.withColumn("tree", self.tree_of(depth).cast("int"))
            small, large, n_large = treed.where(f"size <= {LEAF}"), treed.where(f"size > {LEAF}"), self.n_large
            if self.n_keys > n_large:
                self.leaves(small)
            if not n_large:
                return
            if depth + 1 < DEPTH:
                token = F.expr(f"path[tree * {DEPTH} + {depth + 1}]")
                branched = large.select("num", "key", "tree").join(self.classes.select("num", "path"), "num")
                nodes = self.mixed(branched.select(self.child(token).alias("key"), "num"))
            else:
                left = self.mixed(large)
                if self.n_keys:
                    self.rest(left)

    @staticmethod
    def tree_of(depth: int):
        """The tree of a node, which every key holds in its bits 32 and up."""
        return F.shiftright("key", 32) if depth == 0 else F.shiftrightunsigned("key", 58)

    @staticmethod
    def child(token):
        """A child's key: its tree in the upper six bits, a hash of its path below."""
        return F.col("tree").cast("long") * (1 << 58) + F.shiftrightunsigned(F.xxhash64("key", token), 6)


def classes_of(rows: DataFrame) -> DataFrame:
    """(num, cls, cid, n, path, sketch): one row for each distinct set, numbered; cid is its smallest doc_id."""
    one = rows.groupBy("cls").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n"), F.any_value("path").alias("path"), F.any_value("sketch").alias("sketch"))
    return written(one.withColumn("num", F.monotonically_increasing_id()), "classes")


def _judged(docs: DataFrame, k: int, percent: int, recall: float) -> DataFrame:
    """(doc_id, n, cls, label, component_id) for every row of ``docs``; label numbers the component (null: an empty set)."""
    small_batches(docs.sparkSession)
    trees = trees_for(recall, percent)
    rows = written(signatures(docs, k, trees), "signatures")
    classes = classes_of(rows)
    join = _Join(classes, docs.select("doc_id", "text"), k, percent, trees)
    join.run()
    ids = classes.where("n > 0").select("num", "cls", "cid")
    sizes = rows.groupBy("cls").agg(F.count("*").alias("n"))
    full = dealt(rows.where("n > 0").select("doc_id", "n", "cls"), join.named(ids), ["cls"], counts=sizes, total=rows.count(), n_one=ids.count())
    empty = rows.where("n = 0").select("doc_id", "n", "cls", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "cls", "label", "component_id").union(empty)


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Links are between texts whose sets of ``k``-word shingles have a similarity of
    ``percent`` % or more; ``component_id`` is the smallest doc_id that links reach.
    """
    return _judged(docs, k, percent, recall).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_rows(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component, and every row without words.

    It is the row with the smallest id, of those the one of the smallest fingerprint, and of repeated rows any one.
    """
    with scratch(docs.sparkSession):
        rows = written(_judged(docs, k, percent, recall).groupBy("label", "doc_id", "cls").agg(F.count("*").alias("n")), "rows", keep=True)
    linked, alone = rows.where("label IS NOT NULL"), rows.where("label IS NULL")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "cls")
    best = linked.groupBy("label").agg(F.min(order).alias("best")).select("label", F.col("best.doc_id").alias("best_id"), F.col("best.cls").alias("best_cls"))
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("cls") == F.col("best_cls"))
    told = dealt(linked, best, ["label"]).select("doc_id", "cls", "n", stays.alias("stays"))
    fates = written(told.union(alone.select("doc_id", "cls", F.lit(1).cast("long"), F.lit(True))), "fates")
    by_id = written(fates.groupBy("doc_id").agg(F.max("stays").alias("some_stay"), F.max(~F.col("stays") | (F.col("n") > 1)).alias("some_go")), "fates_by_id")
    gone, both = by_id.where("NOT some_stay").select("doc_id"), by_id.where("some_stay AND some_go").select("doc_id")
    if both.isEmpty():
        return without(docs, gone)
    # Rows of one id that do not share a fate are told apart by their sets.
    plain = without(docs, by_id.where("some_go").select("doc_id"))
    (prints,) = fresh(docs, "fingerprint")
    mixed = with_fingerprint(without(docs, both, "left_semi"), k, prints)
    one = mixed.where(F.col(prints).isNotNull()).dropDuplicates(["doc_id", prints])
    left = without(one, fates.where("stays").join(both.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", F.col("cls").alias(prints)), "left_semi")
    return plain.unionByName(left.drop(prints)).unionByName(mixed.where(F.col(prints).isNull()).drop(prints))


#: Shingles from a window over words, links by counting common ones, components as the closure of the links; for small tables.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
each_word AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words),
four AS (SELECT doc_id, n, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM each_word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, d) AS x FROM four WHERE d IS NOT NULL OR (n < 4 AND i = 1)),
shingles AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id)
SELECT l.a AS doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, l.a = l.component_id AS kept FROM low l LEFT JOIN sizes s ON l.a = s.doc_id
"""
