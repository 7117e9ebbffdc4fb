"""What works on compact logs, against the same of all their operations."""

import random

import pytest

from tessellog.functions import codec, document
from tessellog.functions.peer import Peer


def patched(rnd, steps, doc=None):
    doc = doc or document.Document()
    for _ in range(steps):
        n = len(doc.visible)
        if rnd.random() < 0.6 or not n:
            doc.insert(rnd.randint(0, n), "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))))
        else:
            doc.remove(rnd.randrange(n), rnd.choice((1, 1, 1, 3)))
    return doc


def bare(records):
    return [{k: v for k, v in r.items() if k in ("rec_id", "kind", "anchor", "text", "extra_deps", "targets")} for r in records]


@pytest.mark.parametrize("seed", range(60))
def test_folding_equals_compacting_all_operations(seed):
    rnd = random.Random(seed)
    records = patched(rnd, 15).records
    if seed % 3:  # another site's log, and parts cut in other places
        records = records + patched(rnd, 9).records + document.compact(list(document.expand(records)))
    if seed % 6 == 5:
        records = records[::2]
    nodes = {n[0]: n for n in document.expand(records)}
    want = document.compact(list(nodes.values()))
    whole = len(document.admit({i: (n[1], n[2], n[4], n[5]) for i, n in nodes.items()}, set())) == len(nodes)
    folded = document.fold(records)
    assert whole or folded is None
    if folded:
        assert bare(folded[0]) == bare(want)
        assert codec.write_snapshot(codec.Layout.of(*folded)) == codec.encode_snapshot(nodes.values())
        spots = {x: (r["rec_id"], k) for r in want if r["kind"] != "remove" for k, x in enumerate(r["ids"])}
        assert folded[1].items() <= spots.items()
    else:
        assert seed % 3


def test_most_logs_fold_without_all_operations():
    assert all(document.fold(patched(random.Random(seed), 30).records) for seed in range(20))


def test_a_run_that_begins_inside_another_is_left_to_all_operations():
    doc = document.Document()
    doc.insert(0, "abcd")
    third = next(n[0] for n in document.expand(doc.records) if n[3] == "c")
    own = {"kind": "run", "anchor": third, "extra_deps": [], "targets": []}
    assert document.fold([*doc.records, own | {"text": "dx"}]) is None
    assert sorted(r["text"] for r in document.fold([*doc.records, own | {"text": "x"}])[0] if r["kind"] == "run") == ["bc", "d", "x"]


@pytest.mark.parametrize("seed", range(20))
def test_snapshots_are_read_to_records(seed):
    p = Peer()
    rnd = random.Random(seed)
    for r in patched(rnd, 25).records:
        p.apply(document.expand([r]))
    own, orphans = codec.decode_records(p.encode())
    assert {n[0] for n in document.expand(own)} == set(p.nodes) and not orphans
    assert codec.encode_snapshot(codec.decode_snapshot(p.encode())[0]) == p.encode()


@pytest.mark.parametrize("seed", range(20))
def test_removals_are_named_late_and_equal(seed):
    """The text asks for no id; records that are asked for after each edit are those that are asked for at the end."""
    late, early = document.Document(), document.Document()
    for doc in (late, early):
        rnd = random.Random(seed)
        for _ in range(20):
            patched(rnd, 1, doc)
            if doc is early:
                assert doc.records is not None
    assert late.records == early.records and late.tips == early.tips
    assert late.text() == early.text() == document.by_character(late.records, "sha256")


def test_a_removal_is_not_hashed_for_the_text(monkeypatch):
    doc = document.Document()
    doc.insert(0, "x" * 5000)
    monkeypatch.setattr(document, "follow", lambda *_: pytest.fail("an id was hashed"))
    doc.remove(3000, 2000)
    doc.remove(0, 3000)
    assert doc.text() == ""


def rows_of(*steps):
    doc = document.Document()
    for at, cut, text in steps:
        doc.remove(at, cut)
        doc.insert(at, text)
    return doc.records


def test_a_state_has_one_digest_however_its_log_is_cut():
    from tessellog.operators import codecs

    records = rows_of((0, 0, "abcdefgh"), (1, 3, "xyz"), (2, 1, ""), (0, 0, "Z"))
    nodes = list(document.expand(records))
    for other in (document.compact(nodes), document.compact(nodes[:4]) + records):
        assert codecs._state(other, "sha256", document.fold(other)) == codecs._state(records, "sha256", document.fold(records)) == codecs._state(other, "sha256", None)
    fewer = document.compact([n for n in nodes if n[1] != "remove"])
    assert codecs._state(fewer, "sha256", document.fold(fewer)) != codecs._state(records, "sha256", document.fold(records))


def test_texts_of_emptied_documents_make_no_log(spark):
    """One grouped map: no removed character's id is shuffled."""
    from tessellog.operators import edits
    from tessellog.functions.schemas import PATCHES

    rows = [(1, 0, 0, 0, 0, "abc" * 50), (1, 1, 0, 100, 50, ""), (1, 2, 0, 0, 150, ""), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, "xyz"), (3, 1, 0, 1, 1, "é")]
    found = edits.texts(spark.createDataFrame(rows, PATCHES))
    assert sorted(map(tuple, found.collect())) == [(1, "", 0), (2, "", 0), (3, "xéz", 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


def site_records(spark, texts):
    from tessellog.operators import edits

    logs = [edits.replay(edits.patches_of_text(spark.createDataFrame([(d, t)], "doc_id long, text string"))) for d, t in texts]
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


SITES = [(1, "abcd"), (1, "abxy"), (1, "abcd"), (1, "ab"), (2, "q"), (2, "qrs"), (3, "z")]


def test_a_state_counts_each_operation_once(spark):
    from tessellog.operators import codecs, edits, graph

    log = site_records(spark, SITES)
    once, twice = ({r.doc_id: (r.n_nodes, r.digest) for r in codecs.states(x).collect()} for x in (log, log.unionByName(log)))
    assert once == twice
    assert {d: n for d, (n, _) in once.items()} == {r.doc_id: r["count"] for r in graph.merge(edits.expand(log)).groupBy("doc_id").count().collect()}


def test_the_frontier_of_compact_logs_is_that_of_their_operations(spark):
    from tessellog.operators import edits, graph

    log = site_records(spark, SITES)
    want = {tuple(r) for r in graph.tips(graph.merge(edits.expand(log))).collect()}
    assert {tuple(r) for r in edits.frontier(log).collect()} == want and edits.frontier(log).count() == len(want)


def test_ids_come_to_the_runs_that_they_are_searched_in(spark):
    """What leaves a document's task is what is found, not a row for each character."""
    from tessellog.operators import edits

    log = site_records(spark, [(1, "abcdef"), (2, "q")])
    last = edits.run_ids(log).select("doc_id", "last_id").collect()[0]
    asked = spark.createDataFrame([(1, last.last_id, "x"), (1, last.last_id, "y"), (2, last.last_id, "z"), (7, "00", "n"), (1, None, "n")], "doc_id long, node_id string, tag string")
    found = edits.find_position(asked, log)
    assert sorted((r.doc_id, r.tag, r.place) for r in found.collect()) == [(1, "x", 4), (1, "y", 4)]
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def hashed(monkeypatch, work):
    """How many ids ``work`` hashes along runs, and whether it makes all operations."""
    n, follow = [0], document.follow

    def counted(ids, *rest):
        before = len(ids)
        follow(ids, *rest)
        n[0] += len(ids) - before

    with monkeypatch.context() as m:
        m.setattr(document, "follow", counted)
        m.setattr(document, "expand", lambda *_: pytest.fail("all operations are made"))
        return work(), n[0]


def test_removals_in_the_middle_are_found_without_all_operations(monkeypatch):
    half = 5000
    records = rows_of((0, 0, "ab" * half), *[(half, 1, "")] * 3, (0, 0, "x"), (half, 1, ""), (half - 1, 1, ""))
    layout, n = hashed(monkeypatch, lambda: codec.Layout.of(*document.fold(records)))
    assert sorted(len(c) for c in layout.chains) == [2, 3] and n <= 2 * half  # the first removal depends on the last character


def test_operations_are_made_and_folded_in_one_task(spark):
    from tessellog.operators import edits

    log = site_records(spark, SITES)
    want = {(r.doc_id, r.rec_id, r.text) for r in edits.compact(edits.expand(log).dropDuplicates(["doc_id", "node_id"])).collect()}
    found = edits.recompact(log)
    assert {(r.doc_id, r.rec_id, r.text) for r in found.collect()} == want


def test_an_edited_text_is_packed_without_all_operations(monkeypatch):
    from tessellog.operators import codecs

    records = rows_of((0, 0, "aé" * 10_000), (1, 3, "abc"), (2, 1, ""), (0, 0, "Z"))
    data, n = hashed(monkeypatch, lambda: codecs._written(records, False, "sha256", document.fold(records)))
    sizes = codec.section_bytes(data)
    assert sizes.pop("unused_ids") == 0 and sum(sizes.values()) == len(data) and n <= 20_010  # the first removal depends on the last character


def test_a_typed_text_is_packed_by_hashing_its_ends(monkeypatch):
    from tessellog.operators import codecs

    records = rows_of((0, 0, "ab" * 10_000))
    data, n = hashed(monkeypatch, lambda: codecs._written(records, False, "sha256", document.fold(records)))
    assert codec.section_bytes(data)["runs_text"] == 19_999 and n == 0


def test_storage_keeps_no_copy_of_the_log(spark, sf_dir, monkeypatch):
    from tessellog.plans import catalog

    monkeypatch.setattr(catalog, "saved", lambda *_: pytest.fail("a copy is written"))
    row = catalog.storage_ratios(spark, sf_dir).agg({"encoded_bytes": "sum", "text_bytes": "sum"}).collect()[0]
    assert row["sum(encoded_bytes)"] > row["sum(text_bytes)"] > 0


@pytest.mark.parametrize("seed", range(40))
def test_ranges_of_removals_are_found_without_ids(seed, monkeypatch):
    rnd, doc = random.Random(seed), document.Document()
    for _ in range(12):
        doc.insert(rnd.randint(0, len(doc.visible)), "abcdefg"[: rnd.randint(1, 7)])
        at, way = rnd.randrange(len(doc.visible)), rnd.choice((0, -1))
        for _ in range(rnd.randint(0, 4)):
            doc.remove(max(0, at), 1)
            at += way
    with monkeypatch.context() as m:
        m.setattr(document, "follow", lambda *_: pytest.fail("an id was hashed"))
        doc.hash = lambda _: pytest.fail("an id was hashed")
        runs, removes = doc.single_removals()
        ranges = lambda linked, chains, name: sorted((name(linked[c[0]][1][0]), linked[c[0]][1][1], linked[c[-1]][1][1], len(c)) for c in chains)
        found = codec.remove_ranges(removes)
    doc.hash = document.PROFILES["sha256"]
    layout = codec.Layout.of(*document.fold(doc.records))
    head = lambda run: doc.id((run[0] << document.SHIFT) + run[1])
    assert ranges(removes, found, head) == ranges(layout.linked, layout.chains, lambda i: layout.runs[i]["rec_id"])
    assert sorted(map(head, runs)) == [r["rec_id"] for r in layout.runs]


def test_the_query_of_ranges_hashes_nothing(spark, sf_dir):
    """Nor does it make a log: one map over sorted patches."""
    from tessellog.plans import catalog

    plan = catalog.remove_chain_ranges(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and plan.count("MapInArrow") == 1


def test_ranges_of_edits_are_those_of_their_log(spark):
    """Also with documents of several batches, without an id, and with a position beyond the end."""
    from tessellog.functions.schemas import PATCHES
    from tessellog.operators import codecs, edits

    rows = [(d, 0, 0, 0, 0, "abcdefghij" * d) for d in range(1, 9)] + [(d, t, 0, 9 - t, 1, "") for d in range(1, 9) for t in range(1, 6)]
    rows += [(None, 0, 0, 0, 0, "xyzuv"), *[(None, t, 0, 2, 1, "") for t in (1, 2)], (9, 0, 0, 0, 0, "ab"), (9, 1, 0, 5, 0, "cdefg"), *[(9, 2, i, 3, 1, "") for i in range(2)]]
    patches = spark.createDataFrame(rows, PATCHES)
    names = ("doc_id", "direction", "first", "last", "length")
    want, found = (sorted(map(str, f.select(*names).collect())) for f in (codecs.remove_ranges(edits.replay(patches)), codecs.edited_ranges(patches)))
    assert found == want and len(found) >= 9


def test_a_long_range_is_kept_whole_until_it_is_edited():
    blocks, plain, rnd = document.Blocks(range(100_000)), list(range(100_000)), random.Random(3)
    assert blocks.blocks == [range(100_000)]
    for _ in range(300):
        at, n = rnd.randint(0, len(plain)), rnd.choice((1, 1, 3, 700))
        if rnd.random() < 0.5:
            items = range(rnd.randrange(10**6), 10**7)[:n]
            blocks.insert(at, items)
            plain[at:at] = items
        else:
            assert blocks.cut(at, n) == plain[at : at + n]
            del plain[at : at + n]
        assert len(blocks) == len(plain) and blocks.get(at) == (plain[at] if at < len(plain) else None)
    assert list(blocks) == plain


@pytest.mark.parametrize("seed", range(30))
def test_edits_are_packed_as_all_their_operations(seed):
    from tessellog.operators import codecs

    doc = patched(random.Random(seed), 25)
    assert codecs._edited(doc, "sha256") == codec.encode_snapshot(document.expand(doc.records))


def test_edits_have_the_sections_of_their_log(spark):
    """In one map, without compressing or shuffling a snapshot; a document without operations has none."""
    from tessellog.functions.schemas import PATCHES
    from tessellog.operators import codecs, edits

    rows = [(d, t, 0, at, cut, ins) for d in (*range(1, 700), None) for t, (at, cut, ins) in enumerate([(0, 0, "héllo wörld"[: (d or 5) % 12]), (1, 3, "abc"), (2, 1, ""), (0, 0, "Z"[: (d or 5) % 2])])]
    rows += [(700, 0, 0, 0, 0, ""), (701, 0, 0, 0, 0, "ab"), (701, 1, 0, 9, 0, "c"), (702, 0, 0, 0, 2, "")]
    patches = spark.createDataFrame(rows, PATCHES)
    found = codecs.edited_sections(patches)
    want = codecs._by_section(codecs.encode_logs(edits.replay(patches)))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.select("doc_id").distinct().count() == 702
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sections_of_typed_texts_take_one_shuffle(spark, sf_dir):
    from tessellog.plans import catalog

    plan = catalog.snapshot_sections(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroupsInArrow" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("seed", range(40))
def test_what_a_document_has_hashed_is_not_hashed_again(seed, monkeypatch):
    doc = patched(random.Random(seed), 25)
    plain = document.fold(doc.records)
    folded, n = hashed(monkeypatch, lambda: document.fold(doc.records, "sha256", doc.hashed()))
    assert folded[0] == plain[0] and folded[1].items() >= plain[1].items()
    assert n <= len(folded[0])  # the character after a cut at most
    assert codec.write_snapshot(codec.Layout.of(*folded)) == codec.write_snapshot(codec.Layout.of(*plain))


def test_an_edited_text_is_hashed_once(monkeypatch):
    from tessellog.operators import codecs

    doc = document.Document()
    for at, cut, text in ((0, 0, "aé" * 10_000), (1, 3, "abc"), (2, 1, ""), (0, 0, "Z")):
        doc.remove(at, cut)
        doc.insert(at, text)
    data, n = hashed(monkeypatch, lambda: codecs._edited(doc, "sha256"))
    assert n <= 20_010 and data == codec.encode_snapshot(document.expand(doc.records))


@pytest.mark.parametrize("profile", ["sha256", "blake3"])
def test_ids_along_a_chain_are_those_of_its_operations(profile):
    doc = document.Document(profile)
    doc.insert(0, "aé😀" * 5)
    assert [doc.id(k) for k in range(15)] == [n[0] for n in document.expand(doc.records, profile)]
