"""Set operators over logs of operations (``NODES`` rows).

A state is a set of operations keyed by id, so merging is a union, the frontier an
anti-join, admission a fixpoint and the text a pure function of the set.  All joins
are on (doc_id, id); ids are hashes, so a hot document spreads over partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellog.functions import document
from tessellog.functions.hashing import node_id_column

from .store import saved

KEY = ["doc_id", "node_id"]
INSERTS = "op <> 'remove'"


def with_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``node_id`` computed from their content, by the SHA-256 profile."""
    return rows.withColumn("node_id", node_id_column(F.col("op"), F.col("anchor"), F.col("ch"), F.col("extra_deps"), F.col("targets")))


def deps(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, dep_id): extra dependencies, anchor and remove targets, once each."""
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("extra_deps", none), F.array_compact(F.array("anchor")), F.coalesce("targets", none)))
    return nodes.select(*KEY, F.explode(every).alias("dep_id"))


def edges(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, dep_id, kind): after, before, remove and dependency edges."""
    anchor = nodes.where("anchor IS NOT NULL").select(*KEY, F.col("anchor").alias("dep_id"), F.col("op").alias("kind"))
    target = nodes.select(*KEY, F.explode("targets").alias("dep_id"), F.lit("remove").alias("kind"))
    extra = nodes.select(*KEY, F.explode("extra_deps").alias("dep_id"), F.lit("dependency").alias("kind"))
    return anchor.unionByName(target).unionByName(extra)


def merge(*logs: DataFrame) -> DataFrame:
    """The union of logs; an operation that several hold counts once."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates(KEY)


def tips(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id) of the operations nothing depends on."""
    used = deps(nodes).select("doc_id", F.col("dep_id").alias("node_id"))
    return nodes.select(*KEY).join(used, KEY, "left_anti")


def frontier(nodes: DataFrame) -> DataFrame:
    """(doc_id, tips): the ordered frontier; two states are equal if theirs are."""
    return tips(nodes).groupBy("doc_id").agg(F.array_sort(F.collect_set("node_id")).alias("tips"))


def tips_minus(frontiers: DataFrame, anchor: str = "anchor") -> DataFrame:
    """The extra dependencies of a new operation on column ``anchor``."""
    return frontiers.withColumn("extra_deps", F.array_except("tips", F.array(anchor)))


def missing(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, dep_id) for dependencies that the log lacks."""
    have = nodes.select("doc_id", F.col("node_id").alias("dep_id"))
    return deps(nodes).join(have, ["doc_id", "dep_id"], "left_anti").select("doc_id", "node_id", "dep_id")


def invalid(nodes: DataFrame) -> DataFrame:
    """Insertions anchored on a removal: no text could hold them."""
    removals = nodes.where("op = 'remove'").select("doc_id", F.col("node_id").alias("anchor"))
    return nodes.where(INSERTS).join(removals, ["doc_id", "anchor"], "left_semi").select(*nodes.columns)


def waiting(log: DataFrame) -> DataFrame:
    """(doc_id, node_id) of operations that lack a dependency, or depend on one that waits or is invalid.

    An operation with one dependency shares that one's fate.  Doubling the reach of such pointers, each round a table of its own,
    leads every operation in log n rounds to the nearest one that has several dependencies, or none, or waits by itself;
    only among those rounds follow dependencies, two levels each.
    """
    links = saved(deps(log), "deps")
    start = saved(missing(log).select(*KEY).union(invalid(log).select(*KEY)).distinct(), "waiting")
    single = links.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("dep_id").alias("to")).where("n = 1").join(start, KEY, "left_anti")
    reach = saved(single.select(*KEY, "to"), "reach")
    while True:
        ahead = reach.select("doc_id", F.col("node_id").alias("to"), F.col("to").alias("beyond"))
        further = saved(reach.join(ahead, ["doc_id", "to"], "left").select(*KEY, F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "reach")
        reach = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    # Of the operations with several dependencies: each dependency's last pointer.
    joints = links.join(reach.select(*KEY), KEY, "left_anti").join(start, KEY, "left_anti")
    last = reach.select("doc_id", F.col("node_id").alias("dep_id"), "to")
    joints = saved(joints.join(last, ["doc_id", "dep_id"], "left").select(*KEY, F.coalesce("to", "dep_id").alias("dep_id")).distinct(), "joints")
    fresh = held = start
    while not fresh.isEmpty():
        on = lambda nodes: joints.join(nodes.select("doc_id", F.col("node_id").alias("dep_id")), ["doc_id", "dep_id"], "left_semi").select(*KEY)
        near = on(fresh)
        fresh = saved(near.union(on(near)).distinct().join(held, KEY, "left_anti"), "fresh")
        held = saved(held.union(fresh), "held")
    return held.union(reach.join(held.select("doc_id", F.col("node_id").alias("to")), ["doc_id", "to"], "left_semi").select(*KEY))


def admit(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted, pending, invalid) parts of a log in any order, with repetitions."""
    log = saved(log.dropDuplicates(KEY), "log")
    bad = invalid(log)
    held = saved(waiting(log), "held")
    return log.join(held, KEY, "left_anti"), log.join(held, KEY, "left_semi").join(bad.select(*KEY), KEY, "left_anti"), bad


def tombstones(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id) that some removal targets."""
    return nodes.select("doc_id", F.explode("targets").alias("node_id")).distinct()


def siblings(nodes: DataFrame) -> DataFrame:
    """(doc_id, anchor, op, node_id, rank, next_id): insertions at one place in their order."""
    same = W.partitionBy("doc_id", "anchor", "op").orderBy("node_id")
    return nodes.where(INSERTS).select("doc_id", "anchor", "op", "node_id", F.row_number().over(same).alias("rank"), F.lead("node_id").over(same).alias("next_id"))


def linearize(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, place, last): the canonical order, tombstones included; one document fits a task.

    ``last`` is the place of the last insertion that follows from the node by
    insertions after it, so b comes causally after a if place(a) < place(b) <= last(a).
    """

    def fold(group: pa.Table) -> pa.Table:
        ids = [x.to_pylist() for x in (group["node_id"], group["op"], group["anchor"])]
        placed, end = document.order(zip(*ids, strict=True))
        return pa.table({"doc_id": pa.array([group["doc_id"][0].as_py()] * len(placed), pa.int64()), "node_id": pa.array(placed, pa.string()), "place": pa.array(range(len(placed)), pa.int64()), "last": pa.array([end[n] for n in placed], pa.int64())})

    return nodes.where(INSERTS).select("doc_id", "node_id", "op", "anchor").groupBy("doc_id").applyInArrow(fold, "doc_id long, node_id string, place long, last long")


def linearize_large(nodes: DataFrame) -> DataFrame:
    """The result of ``linearize`` for documents of any size, by list ranking.

    Each insertion is three stops of a walk: its start, itself, its end.  Windows
    over siblings give every stop its successor; doubling the successors' reach, each
    round a table of its own, gives every stop its distance to the end in log n rounds.
    """
    inserts = nodes.where(INSERTS).select("doc_id", "node_id", "op", "anchor")
    group = W.partitionBy("doc_id", "anchor", "op").orderBy("node_id")
    ranked = saved(inserts.withColumn("next_id", F.lead("node_id").over(group)).withColumn("rank", F.row_number().over(group)), "siblings")
    first = ranked.where("rank = 1 AND anchor IS NOT NULL").groupBy(F.col("doc_id"), F.col("anchor").alias("node_id")).agg(
        F.min(F.when(F.col("op") == "before", F.struct("node_id"))).alias("before"), F.min(F.when(F.col("op") == "after", F.struct("node_id"))).alias("after")
    )
    own = ranked.join(first, KEY, "left")
    stop = lambda kind, node: F.concat(F.lit(kind), node)
    up = F.when(F.col("op") == "before", stop("1", F.col("anchor"))).when(F.col("op") == "after", stop("2", F.col("anchor")))
    stops = own.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(stop("0", F.col("node_id")).alias("at"), F.coalesce(stop("0", F.col("before.node_id")), stop("1", F.col("node_id"))).alias("to")),
                F.struct(stop("1", F.col("node_id")).alias("at"), F.coalesce(stop("0", F.col("after.node_id")), stop("2", F.col("node_id"))).alias("to")),
                F.struct(stop("2", F.col("node_id")).alias("at"), F.coalesce(stop("0", F.col("next_id")), up).alias("to")),
            )
        ).alias("s"),
    ).select("doc_id", "s.at", "s.to", F.when(F.substring("s.at", 1, 1) == "1", 1).otherwise(0).cast("long").alias("n"))
    walk = saved(stops, "walk")
    while not walk.where("to IS NOT NULL").isEmpty():
        ahead = walk.select("doc_id", F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("n").alias("more"))
        walk = saved(walk.join(ahead, ["doc_id", "to"], "left").select("doc_id", "at", F.col("beyond").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "walk")
    node = F.substring("at", 2, 100)
    left = walk.groupBy("doc_id", node.alias("node_id")).agg(F.max(F.when(F.substring("at", 1, 1) == "1", F.col("n"))).alias("here"), F.max(F.when(F.substring("at", 1, 1) == "2", F.col("n"))).alias("behind"))
    total = left.groupBy("doc_id").agg(F.max("here").alias("total"))
    return left.join(total, "doc_id").select("doc_id", "node_id", (F.col("total") - F.col("here")).alias("place"), (F.col("total") - F.col("behind") - 1).alias("last"))


def visible(nodes: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, ch, pos): visible characters at their positions.

    Tombstones go after ordering, as they hold up what was inserted at them.
    """
    order = linearize(nodes) if order is None else order
    left = order.join(tombstones(nodes), KEY, "left_anti")
    numbered = left.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("place")).cast("long") - 1)
    return numbered.join(nodes.select(*KEY, "ch"), KEY).select(*KEY, "ch", "pos")


def text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text, length): each document's visible text; a document with nothing left has the empty one."""
    shown = visible(nodes).groupBy("doc_id").agg(F.expr("listagg(ch) WITHIN GROUP (ORDER BY pos)").alias("text"), F.count("*").alias("length"))
    every = nodes.select("doc_id").distinct().join(shown, "doc_id", "left")
    return every.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def length(nodes: DataFrame) -> DataFrame:
    """(doc_id, length, is_empty): how many characters of each document are visible; nothing is ordered for it."""
    gone = tombstones(nodes).withColumn("gone", F.lit(True))
    left = nodes.select(*KEY, "op").join(gone, KEY, "left")
    shown = F.count_if((F.col("op") != "remove") & F.col("gone").isNull())
    return left.groupBy("doc_id").agg(shown.alias("length")).withColumn("is_empty", F.col("length") == 0)


def neighbours(shown: DataFrame) -> DataFrame:
    """``shown`` (see ``visible``) with the ids to its left and right."""
    by_place = W.partitionBy("doc_id").orderBy("pos")
    return shown.withColumns({"left_id": F.lag("node_id").over(by_place), "right_id": F.lead("node_id").over(by_place)})


def contains(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``ids`` whose operation the log holds."""
    return ids.join(nodes.select(*KEY), KEY, "left_semi")


def characters_of(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``ids`` (doc_id, node_id) with the character ``ch`` that the operation inserts, removed since or not; null if it inserts none."""
    return ids.join(nodes.where(INSERTS).select(*KEY, "ch"), KEY, "left")


def inserted(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``ids`` whose operation the log holds and is an insertion."""
    return contains(ids, nodes.where(INSERTS))


def equal_states(one: DataFrame, two: DataFrame) -> DataFrame:
    """(doc_id, equal): whether two logs have reached the same state, which is whether their frontiers are equal.

    What still waits counts for nothing, so each log should be an admitted one; a document that one log lacks differs.
    """
    sides = frontier(one).withColumnRenamed("tips", "one").join(frontier(two).withColumnRenamed("tips", "two"), "doc_id", "full")
    return sides.select("doc_id", F.col("one").eqNullSafe(F.col("two")).alias("equal"))


def synchronise(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both replicas after each has sent the other what it had before: (admitted, pending) of the exchange, which is the same for both."""
    admitted, pending, _ = admit(merge(one, two))
    return admitted, pending


def causally_after(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, a, b) with whether b follows from a by an insertion after a and any more."""
    one = order.select("doc_id", F.col("node_id").alias("a"), F.col("place").alias("place_a"), F.col("last").alias("last_a"))
    two = order.select("doc_id", F.col("node_id").alias("b"), F.col("place").alias("place_b"))
    joined = pairs.join(one, ["doc_id", "a"], "left").join(two, ["doc_id", "b"], "left")
    follows = (F.col("place_b") > F.col("place_a")) & (F.col("place_b") <= F.col("last_a"))
    return joined.select("doc_id", "a", "b", F.coalesce(follows, F.lit(False)).alias("follows"))


def first_difference(pairs: DataFrame) -> DataFrame:
    """(doc_id, at): the first position where texts ``a`` and ``b`` differ; null if they are equal.

    A null text is no text, so it differs from any other, the empty one too, at 0.
    """
    chars = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    zipped = F.arrays_zip(chars("a").alias("a"), chars("b").alias("b"))
    at = F.array_position(F.transform(zipped, lambda z: ~z["a"].eqNullSafe(z["b"])), True)
    return pairs.select("doc_id", F.when(~F.col("a").eqNullSafe(F.col("b")), F.greatest(at - 1, F.lit(0)).cast("long")).alias("at"))
