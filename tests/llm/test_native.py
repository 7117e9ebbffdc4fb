import hashlib
import os
from collections import Counter

import plain
import pytest
from conftest_llm import EDGE, table_of
from pyspark.sql import functions as F

from tessellog.llm import exact_dedup, licenses, mixing, quality, sharding, url_filters

PAIRS = [(d, t) for d, _, t in EDGE]


def test_exact_dedup_edges(spark, edge, empty):
    rows = exact_dedup.dedup(edge).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == plain.exact(PAIRS)
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in rows})
    assert exact_dedup.dedup(empty).count() == 0
    low = exact_dedup.dedup(edge, keep="min").where("kept").select("doc_id").collect()
    assert {r.doc_id for r in low} >= {1, 4, 8}


def test_byte_verification_tells_clashing_digests_apart(spark, edge):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.char_length(text) % 3), 2, "0"))
    rows = exact_dedup.dedup(edge, digest=weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == plain.exact(PAIRS)
    assert set(Counter(r.text_sha256 for r in rows if r.kept).values()) == {1}


def index_of(spark, memtables, ratio=2):
    index = exact_dedup.DigestIndex(spark, 1000, ratio=ratio)
    for rows in memtables:
        index.insert(spark.createDataFrame(rows, "digest binary, doc_id long, row long"))
    return index


def test_levels_are_compacted_by_ratio(spark):
    """Five memtables on levels of two: the fifth stays on level 0, four went to level 2; the merged counts are those of all."""
    memtables = [[(hashlib.sha256(b"%d" % (i % (7 + m))).digest(), 100 * m + i, i) for i in range(20)] for m in range(5)]
    index = index_of(spark, memtables)
    assert [len(level) for level in index.levels] == [1, 0, 1]
    want = {}
    for rows in memtables:
        for digest, doc_id, _ in rows:
            best, n = want.get(digest, (0, 0))
            want[digest] = max(best, doc_id), n + 1
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in index.close().collect()} == want


def test_filters_and_key_ranges_pass_runs_over(spark):
    digest = lambda x: hashlib.sha256(b"%d" % x).digest()
    mixed = index_of(spark, [[(digest(i), i, i) for i in range(300)], [(digest(i), i, i) for i in range(290, 590)]])
    passed, merged = mixed.probed[0]
    assert 20 <= merged < 60 and passed + merged == 600  # the ten shared digests, and few others that the filters take for shared
    low = [(b"\x01" + digest(i), i, i) for i in range(100)]
    apart = index_of(spark, [low, [(b"\x02" + d[1:], i, j) for d, i, j in low]])
    assert apart.probed == [(200, 0)]
    assert mixed.close().where("group_size = 2").count() == 10 and apart.close().count() == 200


def test_repeated_rows_and_sql_agree(spark, edge):
    import duckdb

    documents = edge.select("doc_id", "text").union(edge.where("doc_id > 8").select("doc_id", "text")).union(spark.createDataFrame([(None, "One"), (None, None)], "doc_id long, text string"))
    got = exact_dedup.dedup(documents).collect()
    c = duckdb.connect()
    c.register("documents", documents.toArrow())
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = c.execute(f"SELECT {', '.join(names)} FROM ({exact_dedup.SQL})").fetchall()
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == sorted(str(r) for r in want)


def test_keep_rows(edge):
    rows = exact_dedup.keep_rows(edge)
    assert rows.columns == edge.columns
    assert sorted(r.doc_id for r in rows.collect()) == [2, 3, 5, 6, 7, 9, 10, 11, 12, 13, 14]


def test_mixing_edges(spark, edge, empty):
    rows = mixing.plan(edge).collect()
    want, target = plain.uses(EDGE)
    got = Counter((r.doc_id, r.size, r.copies) for r in rows)
    assert got == Counter((d, len(plain.WORDS(t or "")), n) for (d, _, t), n in zip(EDGE, want))
    assert all(r.taken <= 2 * r.size for r in rows)
    by_target = Counter()
    for r in rows:
        by_target[round(r.target, 6)] += r.taken
    assert sum(by_target.values()) == pytest.approx(sum(target.values()), abs=len(target))
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p < 1 for p in placed)
    assert mixing.plan(empty).count() == 0
    assert [r.position for r in mixing.plan(edge).collect()] == [r.position for r in rows]


def test_mix_repeats_rows(spark, edge):
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    n = Counter(r.doc_id for r in mixed.collect())
    want = {}
    for (d, _, _), k in zip(EDGE, plain.uses(EDGE)[0]):
        want[d] = max(want.get(d, 0), k)
    rows = Counter(d for d, _, _ in EDGE)
    assert n == Counter({d: k * rows[d] for d, k in want.items() if k})


def test_mix_gives_every_use_its_own_position(spark):
    rows = [(i, "abcd"[i % 7 % 4] if i % 11 else None, " ".join(["w"] * (1 + i * i % 17))) for i in range(150)]
    want = plain.use_positions(rows, mixing.SLOPES)
    assert any(n > 1 for n in Counter(d for _, d, _ in want).values())
    got = [r.doc_id for r in mixing.mix(table_of(spark, rows)).collect()]
    assert got == [d for _, d, _ in want]


def test_each_fifth_of_the_mix_follows_the_schedules(spark):
    """Source shares of each fifth of the mix against the integral of the weight schedules."""
    rows = [(i, "abc"[i % 3], "w w w w") for i in range(600)]
    target = plain.uses(rows)[1]
    got = [r.source for r in mixing.mix(table_of(spark, rows)).collect()]
    ends = []
    for fifth in range(5):
        lo, hi = fifth / 5, (fifth + 1) / 5
        ends.append({s: target[s] / 4 * ((1 - k) * (hi - lo) + k * (hi * hi - lo * lo)) for s, k in zip("abc", mixing.SLOPES)})
    start = 0
    for want in ends:
        n = round(sum(want.values()))
        found = Counter(got[start : start + n])
        assert all(abs(found[s] - want[s]) <= 3 for s in "abc")
        start += n


def test_mix_uses_rows_of_one_id_by_their_own_plan(spark):
    rows = [(7 if i % 3 else i, "abcd"[i % 4], " ".join([f"w{i}"] * i)) for i in range(60)]
    want = [rows[i][2] for _, _, i in plain.use_positions(rows, mixing.SLOPES)]
    assert [r.text for r in mixing.mix(table_of(spark, rows)).collect()] == want


@pytest.mark.parametrize("bucket", [4096, 2])
def test_crowded_buckets_are_cut_in_the_same_order(spark, monkeypatch, bucket):
    """A third of the rows has no id and a third one id; sizes repeat."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = [((None, 7, i)[i % 3], "ab"[i % 5 > 0], " ".join(["w"] * (i % 4))) for i in range(240)]
    plan = mixing.plan(table_of(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.size, r.taken, round(r.target, 6)) for r in plan)
    monkeypatch.setattr(mixing, "BUCKET", 100_000)
    assert got == sorted((str(r.doc_id), r.size, r.taken, round(r.target, 6)) for r in mixing.plan(table_of(spark, rows)).collect())
    places = [r.position for r in plan if r.position is not None]
    assert places == sorted(places) and len(plan) == 240


def test_mix_meets_targets_where_ids_are_null(spark):
    rows = [(None if i % 3 else i, "ab"[i % 5 > 0], " ".join([f"w{i}"] * (i % 13))) for i in range(90)]
    used = Counter(r.source for r in mixing.mix(table_of(spark, rows)).select("source", F.explode(F.split("text", " "))).collect())
    for source, target in plain.uses(rows)[1].items():
        assert target - 1 < used[source] < target + 13


def test_quality_edges(edge, empty):
    rows = {(r.doc_id): r for r in quality.judge(edge).collect()}
    for d, t in PAIRS:
        words = plain.WORDS(t or "")
        assert (rows[d].n_words, rows[d].n_repeat_words, rows[d].word_chars) == (len(words), plain.repeat_words(words), sum(map(len, words)))
    assert rows[14].n_dup_lines == 1 and rows[14].n_symbols == 4 + 6
    assert rows[1].base_failed and not rows[1].kept and rows[8].kept and rows[6].n_words == 60_000
    assert quality.judge(empty).count() == 0


def test_line_cleaning(spark):
    bad = ["home | about | news | jobs", "A good line of text here.", "Cookie policy", "Mentions légales", "$$a $$b $$c", "Start » Shop » Men » Shoes", "More items", "see http://a.b/c www.d.e and that"]
    text = "\n".join(["A good line of text here.", *bad, "", "Last line.", "", "Five words without an end"])
    out = quality.clean(table_of(spark, [(1, "a", text), (2, "a", None), (3, "a", "x.\n" * 30_000)])).orderBy("doc_id").collect()
    assert out[0].text == "A good line of text here.\n\nLast line.\n\nFive words without an end" and out[1].text is None and out[2].text == "x.\n"
    judged = quality.judge(table_of(spark, [(1, "a", text)])).first()
    assert judged.n_words - judged.n_lost_words == 6 + 2 + 5


def test_license_edges(spark, edge, empty):
    rows = {r.doc_id: r for r in licenses.scan(edge).collect()}
    hit = rows[11]
    assert hit.n_base == 4 and hit.first_word == 7 and hit.last_word == 17
    assert hit.base_labels == "cc-by,gpl,reserved" and hit.labels == "cc-by,gpl,gpl-3.0,reserved" and hit.score == 1.0
    assert rows[1].n_words == 0 and rows[1].first_word is None and rows[1].labels == "" and rows[6].n_base == 0
    assert licenses.scan(empty).count() == 0
    moved = " ".join(["license", "the", "apache", "under", "licensed"])
    one = licenses.scan(table_of(spark, [(1, "a", moved), (2, "a", "x Licensed under the Apache License, Version 2.0 y"), (3, "a", "cc by cc by")])).orderBy("doc_id").collect()
    assert one[0].labels == "" and one[1].labels == "apache-2.0"
    assert (one[2].n_base, one[2].first_word, one[2].last_word) == (2, 0, 2)


def test_license_labels_equal_plain_templates(docs):
    """On the synthetic texts a licence line is whole or absent, so a plain search finds the same labels."""
    for r in licenses.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        norm = " " + " ".join(w for w in "".join(c if c.isalnum() else " " for c in (r.text or "").lower()).split()) + " "
        want = {label for phrase, label in licenses.PHRASES if f" {phrase} " in norm} | {label for label, template, _ in licenses.TEMPLATES if f" {template} " in norm}
        assert set(filter(None, r.labels.split(","))) == want


def test_sharding_edges(spark, edge, empty):
    for limit in (50, 1000, 1 << 20):
        rows = sharding.assign(edge, limit).collect()
        assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in PAIRS)
        size, n = Counter(), Counter()
        for r in rows:
            size[r.shard] += r.bytes
            n[r.shard] += 1
        assert all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or n[r.shard] == 1) and len(r.shard) == r.depth for r in rows)
        names = sorted(n)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
        for s in names:  # only oversized buckets split
            if s:
                assert sum(v for k, v in size.items() if k.startswith(s[:-1])) > limit
    assert sharding.assign(empty).count() == 0
    same = sharding.assign(table_of(spark, [(1, "a", "x" * 100)] * 40), 1000).collect()
    assert len(same) == 40 and max(r.shard_bytes for r in same) <= 1000


def test_directory_finds_the_shard_of_every_id(spark, empty):
    docs = table_of(spark, [(i, "a", "x" * (i % 90)) for i in range(300)] + [(5, "a", "y" * 80)] * 30)
    rows = sharding.assign(docs, 1000)
    entries = sharding.directory(rows)
    assert entries.agg(F.sum("n_rows")).first()[0] == 330 and entries.where("shard_bytes > 1000").count() == 0
    shards = {}
    for r in rows.collect():
        shards.setdefault(r.doc_id, set()).add(r.shard)
    found = sharding.look_up(spark.range(400).withColumnRenamed("id", "doc_id"), entries).collect()
    assert len(found) == 400 and all(r.shard in shards[r.doc_id] for r in found if r.doc_id in shards)
    assert sharding.look_up(docs.select("doc_id"), sharding.directory(sharding.assign(empty))).where("shard IS NOT NULL").count() == 0


def test_shards_are_written_whole(spark, edge, tmp_path):
    sharding.write(edge, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(EDGE)
    assert len(os.listdir(tmp_path / "s")) > 3


def test_rows_of_one_id_are_written_to_their_own_shards(spark, tmp_path):
    docs = table_of(spark, [(1 if i % 2 else None, "a", f"{i:03d}" + "x" * 97) for i in range(60)] + [(i, "b", f"{i:03d}") for i in range(100, 130)]).drop("shard")
    sharding.write(docs, str(tmp_path / "s"), 1000)
    rows = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(r.text for r in rows) == sorted(r.text for r in docs.collect())
    size = Counter()
    for r in rows:
        size[r.shard] += len(r.text)
    assert max(size.values()) <= 1000
    assert size == Counter({f"b{r.shard}": r.shard_bytes for r in sharding.assign(docs, 1000).collect()})


URLS = [
    (1, None),
    (2, "no scheme"),
    (3, "http://Example.COM/en/7?x"),
    (4, "https://a.example.com/en/9#f"),
    (5, "http://b.net/de/1"),
    (6, "http://x.example.net/de/81"),
    (7, "http://org/es/"),
    (8, "ftp://u@h.org:80/fr"),
    (9, "http://notexample.com"),
    (10, "http://h.io?q=/en/"),
    (10, "http://h.io?q=/en/"),
    (11, "://"),
]


def test_url_edges(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = {r.page_id: r for r in url_filters.judge(pages, none).collect()}
    assert [(rows[i].host, rows[i].path) for i in (1, 2, 11)] == [("", "")] * 3
    assert (rows[3].host, rows[3].path, rows[3].rule, rows[3].verdict) == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert (rows[4].rule, rows[4].verdict) == ("com/en/", "block")
    assert (rows[5].rule, rows[5].verdict) == ("net/de/", "allow")
    assert (rows[6].rule, rows[6].verdict) == ("example.net/de/8", "block")
    assert (rows[7].rule, rows[7].verdict) == ("org/es/", "block")
    assert (rows[8].host, rows[8].path, rows[8].rule, rows[8].verdict) == ("u@h.org:80", "/fr", None, "allow")
    assert (rows[10].host, rows[10].path) == ("h.io", "")
    assert url_filters.judge(pages.limit(0), none).count() == 0


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    rows = [(i, f"http://bad.x.com/{i}", 1) for i in range(60)] + [(100 + i, f"http://good{i % 20}.y.com/{i}", int(i % 10 == 0)) for i in range(400)] + [(900, "http://new.y.com/", 1), (901, "http://never.y.com/", None)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, _, b in rows] + [(0, None), (0, 0)], "page_id long, bad int")
    got = {r.host: r.verdict for r in url_filters.judge(pages, outcomes).collect()}
    assert got["bad.x.com"] == "block" and got["good1.y.com"] == "allow" and got["new.y.com"] == "allow" and got["never.y.com"] == "allow"


def test_domains_follow_public_suffixes(spark):
    """Forty bad hosts under one registrant of co.uk do not touch another one; addresses stand alone."""
    rows = [(i, f"http://h{i % 40}.a.co.uk/{i}", 1) for i in range(200)] + [(1000 + i, f"http://g{i % 40}.com/{i}", 0) for i in range(400)]
    rows += [(2000 + i, "http://good.b.co.uk/", 0) for i in range(3)] + [(2100, "http://new.good.co.uk/", None), (2101, "http://unseen.a.co.uk./", None)]
    rows += [(2200 + i, "http://10.0.0.1:80/", 1) for i in range(60)] + [(2300, "http://10.0.0.2/", None), (2301, "http://u@[2001:db8::1]:8080/", None)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(3000, "http://x.io/" + "a" * 300_000)], "page_id long, url string")
    got = {r.host: r for r in url_filters.judge(pages, spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad int")).collect()}
    assert {h: got[h].verdict for h in ("h1.a.co.uk", "good.b.co.uk", "new.good.co.uk", "unseen.a.co.uk.", "10.0.0.1:80", "10.0.0.2", "u@[2001:db8::1]:8080", "g1.com")} == {
        "h1.a.co.uk": "block",
        "good.b.co.uk": "allow",
        "new.good.co.uk": "allow",
        "unseen.a.co.uk.": "block",
        "10.0.0.1:80": "block",
        "10.0.0.2": "allow",
        "u@[2001:db8::1]:8080": "allow",
        "g1.com": "allow",
    }
    assert len(got["x.io"].path) == 300_001


def test_url_edges_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_HOSTS", 1)
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    assert url_filters.judge(pages, spark.createDataFrame([(3, 1)], "page_id long, bad int")).count() == len(URLS)
