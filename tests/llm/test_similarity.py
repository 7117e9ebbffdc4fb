import random
import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest_llm import EDGE, table_of

from tessellog.llm import common, near_dedup, shingles
from tessellog.llm.components import components

PAIRS = [(d, t) for d, _, t in EDGE]


def check(spark, rows, k):
    got = near_dedup.near_dedup(table_of(spark, [(d, "s", t) for d, t in rows]), k).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, plain.components(rows, k)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return got


def test_sets_equal_plain_ones():
    texts = [t for _, t in PAIRS] + ["a\x0bb\x0cc d  e\r\nf", "É é", "\x1c x"]
    for k in (4, 5):
        h, o = shingles.sets(texts, k)
        assert shingles.sizes(o, len(texts)).tolist() == [len(plain.shingle_set(t, k)) for t in texts]
    a, b, both = shingles.common(texts[:-1], texts[1:], 4)
    assert both.tolist() == [len(plain.shingle_set(x, 4) & plain.shingle_set(y, 4)) for x, y in zip(texts, texts[1:])]


def test_edges(spark, empty):
    check(spark, PAIRS, 4)
    assert near_dedup.near_dedup(empty, 4).count() == 0
    assert near_dedup.near_dedup(table_of(spark, [(1, "s", None)]), 4).collect()[0].component_id == 1


def test_one_id_with_two_texts(spark):
    check(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u")], 4)


@pytest.mark.parametrize("leaf", [64, 4])
def test_random_families(spark, leaf, monkeypatch):
    """Families of edited copies around the threshold, with a shared passage; small leaves force deep trees and blocks, and nothing is broadcast."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    if leaf == 4:
        for module in (common, near_dedup):
            monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
            monkeypatch.setattr(module, "FEW_ROWS", 20)
        monkeypatch.setattr(common, "HOT_ROWS", 5)
    rnd = random.Random(leaf)
    passage = [f"p{i}" for i in range(25)]
    rows, n = [], 0
    for f in range(12):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(400)) for _ in range(60)]
        if f % 3 == 0:
            base[10:35] = passage
        for _ in range(rnd.choice([1, 2, 3, 25 if f == 3 else 6])):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(60)] = f"new{rnd.randrange(5)}"
            rows.append((n, " ".join(own)))
            n += 1
    rnd.shuffle(rows)
    check(spark, rows, 4)


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100


def test_few_links_are_one_task_and_many_take_rounds(spark, monkeypatch):
    rnd = random.Random(3)
    links = spark.createDataFrame([(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(600, 600), (401, 400)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    few = sorted(map(tuple, components(links).collect()))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    spark.sparkContext.setJobGroup("other", "")
    monkeypatch.setitem(components.__globals__, "FEW_LINKS", 0)
    assert few == sorted(map(tuple, components(links).collect())) and (440, 400) in few and 600 not in dict(few)
    assert 0 < len(jobs) <= 8
    assert components(links.where("a = b")).count() == 0


def test_rows_without_an_id_are_linked(spark):
    words = [f"w{i}" for i in range(24)]
    check(spark, [(None, " ".join(words)), (1, " ".join([*words, "end"])), (None, "p q r s t u v"), (None, "p q r s t u v"), (None, "")], 4)


def test_many_short_texts_that_share_most_words(spark, monkeypatch):
    """Thousands of five-word texts with four words in common and one longer family: large mixed nodes, no similar pair among the short."""
    made = []
    monkeypatch.setattr(near_dedup, "cell_links", lambda cells, percent, f=near_dedup.cell_links: made.append(cells.selectExpr("size(members) AS n").collect()) or f(cells, percent))
    rows = [(i, f"one two three four end{i}") for i in range(4000)] + [(5000 + i, "one two three four " + " ".join(f"v{j}" for j in range(60)) + f" x{i}") for i in range(5)]
    got = near_dedup.near_dedup(table_of(spark, [(d, "s", t) for d, t in rows]), 4).where("doc_id <> component_id").collect()
    assert sorted(r.doc_id for r in got) == [5001, 5002, 5003, 5004]
    assert all(r.n <= 3 * near_dedup.BLOCK_SETS for cells in made for r in cells)


def test_a_cloud_takes_a_few_candidates_a_class(spark, monkeypatch):
    """One large group of near copies: the pairs that become rows are a few for each class, not one for each tree's pivots."""
    made = []
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, total, *a, f=near_dedup.confirm: made.append(total) or f(pairs, total, *a))
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(500):
        own = list(base)
        for _ in range(2):
            own[rnd.randrange(120)] = f"new{n}"
        rows.append((n, " ".join(own)))
    got = check(spark, rows, 4)
    assert {r.component_id for r in got} == {0}
    assert 499 <= sum(made) <= 2 * near_dedup.BEST * 500


def groups(links):
    """Sets of what links connect."""
    out = []
    for pair in links:
        met = [g for g in out if g & {*pair}]
        out = [g for g in out if g not in met] + [{*pair}.union(*met)]
    return sorted((g for g in out if len(g) > 1), key=min)


def cell_of(sets, labels, asks):
    """A batch of one cell, as ``blocks`` makes them."""
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
    flat = pa.StructArray.from_arrays([pa.array(range(len(sets))), pa.array(labels), pa.array(asks), lists], names=["num", "label", "ask", "shingles"])
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), flat)], names=["members"])


@pytest.fixture
def links_of(monkeypatch):
    """What the map of ``cell_links`` finds in one cell."""
    runs = []
    monkeypatch.setattr(near_dedup, "mapped", lambda df, run, schema: runs.append(run) or df)
    near_dedup.cell_links(MagicMock(), 80)
    return lambda cell: [tuple(r.values()) for b in runs[0](iter([cell])) for r in b.to_pylist()]


def test_a_full_cell_of_near_copies_takes_little_memory(links_of):
    """All pairs of two blocks are similar and of two components: a million pairs, of which a link for each set is made."""
    n, rng = near_dedup.BLOCK_SETS, np.random.default_rng(3)
    base = np.arange(150)
    sets = [np.sort(np.concatenate([base[rng.permutation(150)[:145]], 1000 + 5 * i + np.arange(5)])) for i in range(2 * n)]
    cell = cell_of(sets, list(range(2 * n)), [i < n for i in range(2 * n)])
    tracemalloc.start()
    try:
        links = links_of(cell)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(links) == 2 * n - 1 and len(groups(links)) == 1
    assert peak < 64 << 20


@pytest.mark.parametrize("pairs", [1, 40, 100_000])
def test_cells_join_what_is_similar(links_of, monkeypatch, pairs):
    """However many pairs are judged at a time, the links are similar pairs, as many as join the components and no more."""
    monkeypatch.setattr(near_dedup, "CELL_PAIRS", pairs, raising=False)
    rnd = random.Random(pairs)
    for _ in range(30):
        bases = [rnd.sample(range(60), rnd.randrange(5, 20)) for _ in range(3)]
        sets = [sorted({*rnd.choice(bases), *rnd.sample(range(60), rnd.randrange(3))}) for _ in range(rnd.randrange(2, 30))]
        labels, asks = [rnd.randrange(12) for _ in sets], [rnd.random() < 0.4 for _ in sets]
        near = {(i, j) for i in range(len(sets)) for j in range(i) if asks[i] != asks[j] and 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
        links = links_of(cell_of([np.array(s) for s in sets], labels, asks))
        assert {(b, a) for a, b in links} <= near
        joined = [groups([(labels[a], labels[b]) for a, b in x]) for x in (links, near)]
        assert joined[0] == joined[1] and len(links) == sum(len(g) - 1 for g in joined[0])


def test_rarest_shingles_meet(spark):
    rnd = random.Random(1)
    sets = [sorted(rnd.sample(range(40), rnd.randrange(1, 30))) for _ in range(60)]
    near = spark.createDataFrame(list(enumerate(sets)), "num long, shingles array<long>")
    rare = {}
    for r in near_dedup.rare_shingles(near, 80).collect():
        rare.setdefault(r.num, set()).add(r.key)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len({*a} & {*b})
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert rare[i] & rare[j]


def test_only_linked_classes_meet_their_components(spark, monkeypatch):
    """Beyond a broadcast, the join that names components has the linked classes alone; all others are named by themselves."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    made = []

    def seen(rows, one, keys, *a, f=near_dedup.dealt, **b):
        if one.columns == ["label", "component_id"]:
            made.append((rows.count(), one.count()))
        return f(rows, one, keys, *a, **b)

    monkeypatch.setattr(near_dedup, "dealt", seen)
    words = [f"w{i}" for i in range(40)]
    near = [(n, " ".join([*words, f"end{n}"])) for n in (7, 3, 9)] + [(20, " ".join([*words[::-1], "a"])), (11, " ".join([*words[::-1], "b"]))]
    check(spark, near + [(n, f"alone {n} b{n} c{n} d{n}") for n in range(100, 160)] + [(None, "p q r s t u"), (170, ""), (171, "alone 101 b101 c101 d101")], 4)
    assert made == [(5, 2)]


def test_few_shingles_are_counted_together(spark, monkeypatch):
    """Sets in many files: every task would give a row for each counter it meets, so few shingles are one task's, more are several tasks'."""
    made = []

    def seen(df, run, schema, f=near_dedup.mapped):
        out = f(df, run, schema)
        if schema == "counter long, n long":
            made.append((out.groupBy("counter").sum("n").count(), out.count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(near_dedup, "mapped", seen)
    rnd = random.Random(2)
    sets = spark.createDataFrame([(i, rnd.sample(range(300), 40)) for i in range(160)], "num long, shingles array<long>").repartition(16)
    few = sorted(map(tuple, near_dedup.rare_shingles(sets, 80).collect()))
    monkeypatch.setattr(near_dedup, "COUNTED", 2000)
    assert few == sorted(map(tuple, near_dedup.rare_shingles(sets, 80).collect()))
    assert made[0] == (300, 300, 1) and made[1][0] == 300 and made[1][2] == 4
    assert near_dedup.rare_shingles(sets.where("num < 0"), 80).count() == 0


def test_trees_follow_recall():
    assert near_dedup.trees_for(0.9998, 80) == 12 < near_dedup.trees_for(0.999999, 80) and near_dedup.trees_for(0.9, 80) == 4


def test_one_row_of_a_group_stays_whatever_the_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    other = "k l m n o p q r s"
    rows = [(1, words), (1, words + " end"), (1, words), (2, words + " fin"), (None, other), (None, other + " t"), (None, other), (None, ""), (1, ""), (3, "alone here"), (None, "lonely text")]
    left = near_dedup.keep_rows(table_of(spark, [(d, "s", t) for d, t in rows])).collect()
    got = sorted((str(r.doc_id), r.text) for r in left)
    assert [x for x in got if not x[1]] == [("1", ""), ("None", "")]
    assert sum(w.startswith("w0") for _, w in got) == 1 and ("2", words + " fin") not in got
    assert sum(w.startswith("k l") for _, w in got) == 1 and ("3", "alone here") in got and ("None", "lonely text") in got and len(got) == 6


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i % 3 and 7, i) for i in range(200)] + [(None, 1)], "k long, x long")
    one = spark.createDataFrame([(0, "a"), (7, "b"), (9, "c")], "k long, y string")
    for how in ("inner", "left"):
        got = common.dealt(rows, one, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(one, ["k"], how).collect())) and got.columns == ["k", "x", "y"]


def test_driver_gives_back_what_it_has_freed(spark, monkeypatch):
    monkeypatch.setattr(common, "GIVE_BACK_S", 0, raising=False)
    common.written(spark.range(3), "warm").count()  # a young session collects of itself, as it loads classes
    jvm = spark.sparkContext._jvm
    freed = jvm.java.lang.Object()
    jvm.System.gc()  # makes it old: only a full collection takes it from now on
    seen = jvm.java.lang.ref.WeakReference(freed)
    spark.sparkContext._gateway.detach(freed)
    assert common.written(spark.range(3), "given").count() == 3
    assert seen.get() is None
    assert common.driver_gives_back(spark).startswith("Trim native heap: ")
    monkeypatch.setattr(common, "GIVE_BACK_S", 1000)
    assert common.driver_gives_back(spark) == ""  # it has just done so


def test_keep_rows(edge):
    rows = near_dedup.keep_rows(edge)
    assert rows.columns == edge.columns
    ids = [r.doc_id for r in rows.collect()]
    assert 8 in ids and 9 not in ids and 10 not in ids and {1, 2, 3} <= set(ids)
