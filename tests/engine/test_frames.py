"""DataFrame operators: against the in-memory replica, the given goldens, and DuckDB."""

import gzip
import json
import os
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessellog.functions.peer import Peer
from tessellog.functions.schemas import NODES
from tessellog.operators import codecs, edits, graph, stats
from tessellog.plans import catalog
from tessellog.sources import traces
from tessellog.streaming.admission import admit_stream

# Changes in the coordinates before them, and the texts that they give.
CHANGES = [
    ("hello", [(1, 4, "a")], "hao"),
    ("hd", [(1, 1, "ello worl")], "hello world"),
    ("abcdef", [(1, 2, ""), (4, 5, "")], "acdf"),
    ("abcdef", [(2, 2, "X"), (4, 4, "Y")], "abXcdYef"),
    ("hello world", [(1, 5, "i"), (7, 11, "ow")], "hi wow"),
    ("foo\nbar", [(0, 0, "  "), (4, 4, "  ")], "  foo\n  bar"),
    ("the cat sat on the mat", [(0, 3, "a"), (15, 18, "a")], "a cat sat on a mat"),
    ("aaa", [(1, 1, "X"), (2, 2, "X"), (3, 3, "X")], "aXaXaX"),
    ("abcdef", [(0, 1, ""), (6, 6, "Z")], "bcdefZ"),
]


def frame(spark, peers):
    rows = [(d, n[0].hex(), n[1], n[2].hex() if n[2] else None, n[3], [x.hex() for x in n[4]], [x.hex() for x in n[5]]) for d, p in peers for n in p]
    return spark.createDataFrame(rows, NODES)


def random_peer(seed, steps=25):
    rnd, p = random.Random(seed), Peer()
    for _ in range(steps):
        if rnd.random() < 0.65 or not len(p):
            p.insert(rnd.randint(0, len(p)), "".join(rnd.choice("abcé👍") for _ in range(rnd.randint(1, 4))))
        else:
            p.remove(rnd.randrange(len(p)), rnd.randint(1, 3))
    return p


def test_changes_in_old_coordinates(spark):
    start = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CHANGES)], "doc_id long, text string")
    rows = [(i, 1, k, a, b, s) for i, (_, cs, _) in enumerate(CHANGES) for k, (a, b, s) in enumerate(cs)]
    changes = spark.createDataFrame(rows, "doc_id long, txn long, i long, from_pos long, to_pos long, text string")
    patches = edits.patches_of_text(start).unionByName(edits.in_current_coordinates(changes))
    got = {r.doc_id: r.text for r in edits.linear_text(edits.replay(patches)).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CHANGES)}


def test_merged_logs_equal_merged_replicas(spark):
    pairs = [(random_peer(2 * i), random_peer(2 * i + 1)) for i in range(12)]
    a = frame(spark, [(i, x.nodes.values()) for i, (x, _) in enumerate(pairs)])
    b = frame(spark, [(i, y.nodes.values()) for i, (_, y) in enumerate(pairs)])
    merged = graph.merge(a, b, a)
    admitted, pending, bad = graph.admit(merged)
    assert pending.count() == bad.count() == 0 and admitted.count() == merged.count()
    got = {r.doc_id: (r.text, r.length) for r in graph.text(merged).collect()}
    fronts = {r.doc_id: r.tips for r in graph.frontier(merged).collect()}
    for i, (x, y) in enumerate(pairs):
        x.merge_encoded(y.encode())
        assert got.get(i, ("", 0)) == (x.text, len(x)) and fronts[i] == sorted(t.hex() for t in x.doc.tips)
    assert {r.node_id for r in graph.with_ids(merged.drop("node_id")).collect()} == {r.node_id for r in merged.collect()}
    one, two = (sorted(map(tuple, f(merged).collect())) for f in (graph.linearize, graph.linearize_large))
    assert one == two


def test_waiting_and_invalid_operations(spark):
    p = random_peer(5)
    p.insert(0, "ab")
    p.remove(0, 1)
    removal = next(n for n in p.nodes.values() if n[1] == "remove")
    bad = (b"\x01" * 32, "after", removal[0], "x", [], [])
    on_bad = (b"\x02" * 32, "after", bad[0], "y", [], [])
    lost = next(n for n in p.nodes.values() if n[1] == "root")
    log = frame(spark, [(1, [*p.nodes.values(), bad, on_bad]), (2, [n for n in p.nodes.values() if n != lost])])
    admitted, pending, invalid = graph.admit(log)
    assert [r.node_id for r in invalid.collect()] == [bad[0].hex()]
    assert {(r.doc_id, r.node_id) for r in pending.where("doc_id = 1").collect()} == {(1, on_bad[0].hex())}
    assert admitted.where("doc_id = 1").count() == len(p.nodes)
    # Whatever hangs on the lost root waits.
    left = {n[0]: n for n in p.nodes.values() if n != lost}
    from tessellog.functions import document

    fit = document.admit({i: (n[1], n[2], n[4], n[5]) for i, n in left.items()}, set())
    assert admitted.where("doc_id = 2").count() == len(fit)


def test_stream_admits_in_any_order(spark, tmp_path):
    p, q = random_peer(8), random_peer(9)
    rows = frame(spark, [(1, p.nodes.values()), (2, q.nodes.values())]).toPandas().sample(frac=1, random_state=3)
    parts = [rows.iloc[i::4] for i in range(4)] + [rows.iloc[:5]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, NODES).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    log = spark.readStream.schema(NODES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream = admit_stream(log).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    out = spark.table("admitted")
    assert sorted((r.doc_id, r.node_id) for r in out.collect()) == sorted((d, n.hex()) for d, x in ((1, p), (2, q)) for n in x.nodes)
    got = {r.doc_id: r.text for r in graph.text(out).collect()}
    assert got == {d: x.text for d, x in ((1, p), (2, q))}


@pytest.mark.parametrize("packed", [False, True])
def test_trace_files(spark, tmp_path, packed):
    trace = {"endContent": "hio", "txns": [{"patches": [[0, 0, "hello"], [1, 3, "i"]]}, {"patches": [[3, 1, ""]]}]}
    body = json.dumps(trace).encode()
    name = tmp_path / ("t.json.gz" if packed else "t.json")
    name.write_bytes(gzip.compress(body) if packed else body)
    read = traces.read_traces(spark, str(name))
    patches = traces.patches(read)
    assert [(r.pos, r["del"], r.ins) for r in patches.orderBy("txn", "i").collect()] == [(0, 0, "hello"), (1, 3, "i"), (3, 1, "")]
    assert stats.counts(patches).collect()[0].asDict() == {"patch_count": 3, "op_count": 10}
    right = stats.correctness(edits.linear_text(edits.replay(patches)), read.selectExpr("doc_id", "endContent AS text"))
    assert [r.correct for r in right.collect()] == [True]


def test_a_lost_root_holds_a_long_chain(spark, monkeypatch):
    """Rounds of admission grow with the logarithm of a chain's length; further dependencies take rounds of their own."""
    p = Peer()
    p.insert(0, "r")
    p.insert(1, "a" * 3000)
    p.remove(3, 2)
    p.insert(0, "b")
    rows = [n for n in p.nodes.values() if n[1] != "root"]
    rounds = []
    monkeypatch.setattr(graph, "saved", lambda df, label, f=graph.saved: rounds.append(label) or f(df, label))
    q = random_peer(3)
    log = frame(spark, [(1, rows), (2, q.nodes.values())])
    admitted, pending, _ = graph.admit(log)
    assert admitted.count() == len(q.nodes) and pending.count() == len(rows)
    assert rounds.count("reach") <= 14 and len(rounds) < 32


def test_empty_and_equal_states(spark):
    p, q = Peer(), Peer()
    p.insert(0, "ab")
    p.remove(0, 2)
    q.insert(0, "ab")
    one, two = frame(spark, [(1, p.nodes.values()), (2, q.nodes.values())]), frame(spark, [(1, q.nodes.values()), (2, q.nodes.values()), (3, q.nodes.values())])
    assert {(r.doc_id, r.text, r.length) for r in graph.text(one).collect()} == {(1, "", 0), (2, "ab", 2)}
    assert {tuple(r) for r in graph.length(one).collect()} == {(1, 0, True), (2, 2, False)}
    assert {tuple(r) for r in graph.equal_states(one, two).collect()} == {(1, False), (2, True), (3, False)}
    admitted, pending = graph.synchronise(one, two)
    assert pending.count() == 0 and {tuple(r) for r in graph.length(admitted).collect()} == {(1, 0, True), (2, 2, False), (3, 2, False)}
    differ = spark.createDataFrame([(1, None, ""), (2, "", None), (3, None, None), (4, "ab", "ac"), (5, "ab", "abc"), (6, "", "")], "doc_id long, a string, b string")
    assert {r.doc_id: r.at for r in graph.first_difference(differ).collect()} == {1: 0, 2: 0, 3: None, 4: 1, 5: 2, 6: None}


def test_runs_are_split_and_searched(spark):
    log = edits.replay(edits.patches_of_text(spark.createDataFrame([(1, "xabcd"), (2, "y"), (3, "zé")], "doc_id long, text string")))
    ids = {r.rec_id: r for r in edits.run_ids(log).collect()}
    assert sorted(r.n for r in ids.values()) == [1, 4]
    from pyspark.sql import functions as F

    for at, want in ((2, ["ab", "cd"]), (0, ["abcd"]), (4, ["abcd"]), (9, ["abcd"])):
        rows = sorted((r for r in edits.split_run(log, F.lit(at)).collect() if r.doc_id == 1), key=lambda r: r.part)
        assert [r.text for r in rows] == want
    rows = sorted((r for r in edits.split_run(log, F.lit(2)).collect() if r.doc_id == 1), key=lambda r: r.part)
    nodes = {r.node_id: r for r in edits.expand(log).collect()}
    assert nodes[rows[1].anchor].ch == "b" and nodes[rows[1].rec_id].ch == "c" and rows[1].extra_deps == []
    asked = spark.createDataFrame([(1, i) for i in nodes] + [(1, "00")], "doc_id long, node_id string")
    assert sorted(nodes[r.node_id].ch + str(r.place) for r in edits.find_position(asked, log).collect()) == ["a0", "b1", "c2", "d3"]
    assert sorted(r.ch for r in graph.characters_of(asked, edits.expand(log)).where("ch IS NOT NULL").collect()) == list("abcdx")


def test_snapshots_merge_as_frames(spark):
    p, q = random_peer(11), random_peer(12)
    sent = codecs.encode_snapshots(frame(spark, [(1, q.nodes.values())]))
    merged = codecs.merge_encoded(frame(spark, [(1, p.nodes.values())]), sent)
    check = codecs.section_check(sent).collect()
    assert [(r.whole, r.unused_ids) for r in check] == [(True, 0)]
    p.merge_encoded(q.encode())
    assert [r.text for r in graph.text(merged).collect()] == [p.text]


def test_undecodable_bytes_give_errors(spark):
    data = spark.createDataFrame([(1, bytearray(b"\x01\x09")), (2, bytearray(b"\x00"))], "doc_id long, bytes binary")
    rows = codecs.decode_batches(data).collect()
    assert [(r.doc_id, r.error) for r in rows] == [(1, "tag")]
    with pytest.raises(Exception, match="tag"):
        codecs.decode_batches(data, fail_fast=True).collect()


def test_run_statistics_without_runs(spark):
    none = spark.createDataFrame([], "kind string, text string")
    row = stats.run_sizes(none).collect()[0]
    assert (row.runs, row["min"], row.p99, row["avg"]) == (0, 0, 0, 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], NODES)
    assert graph.text(empty).count() == graph.tips(empty).count() == graph.admit(empty)[0].count() == graph.linearize_large(empty).count() == 0


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    def norm(df):
        df = df[sorted(df.columns)]
        rows = [tuple("null" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)]
        return sorted(rows)

    return sorted(a.columns) == sorted(b.columns) and norm(a) == norm(b)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_queries_equal_their_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        assert same(got.astype(object), duck.execute(catalog.ORACLE_SQL[name]).df().astype(object))
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
