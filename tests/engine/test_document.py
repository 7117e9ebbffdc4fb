"""The fold, the canonical order, codecs and replicas, without Spark."""

import random
import time

import pytest

from tessellog.functions import codec, document
from tessellog.functions.hashing import blake3, preimage, sha256
from tessellog.functions.peer import Peer


def made(steps, profile="sha256"):
    p = Peer(profile)
    for step in steps:
        if step[0] == "+":
            p.insert(step[1], step[2])
        else:
            p.remove(step[1], *step[2:])
    return p


# Edits and the texts that any implementation of the model gives.
ONE_SITE = [
    ("append", [("+", 0, "a"), ("+", 1, "b"), ("+", 2, "c")], "abc"),
    ("before then middle", [("+", 0, "a"), ("+", 0, "b"), ("+", 1, "c")], "bca"),
    ("batch in the middle", [("+", 0, "a"), ("+", 1, "z"), ("+", 1, "bcd")], "abcdz"),
    ("same front", [("+", 0, "a"), ("+", 0, "a")], "aa"),
    ("insert again", [("+", 0, "a"), ("-", 0), ("+", 0, "a")], "a"),
    ("remove both", [("+", 0, "a"), ("+", 0, "a"), ("-", 0), ("-", 0)], ""),
    ("c1", [("+", 0, "c"), ("+", 0, "b"), ("+", 1, "a")], "bac"),
    ("c2", [("+", 0, "a"), ("+", 0, "b"), ("+", 1, "c"), ("+", 2, "d")], "bcda"),
    ("c3", [("+", 0, "c"), ("+", 1, "c"), ("+", 2, "c"), ("-", 1), ("+", 1, "b")], "cbc"),
    ("c4", [("+", 0, "a"), ("+", 1, "a"), ("+", 2, "a"), ("+", 3, "a"), ("+", 3, "a"), ("+", 3, "d")], "aaadaa"),
    ("c5", [("+", 0, "a"), ("+", 0, "a"), ("-", 0), ("+", 1, "b")], "ab"),
    ("c6", [("+", 0, "a"), ("+", 1, "b"), ("+", 0, "c"), ("-", 2)], "ca"),
    ("c7", [("+", 0, "a"), ("+", 0, "b"), ("-", 1)], "b"),
    ("c8", [("+", 0, "a"), ("+", 0, "b"), ("+", 1, "c"), ("-", 0), ("+", 2, "d")], "cad"),
    ("c9", [("+", 0, "a"), ("+", 1, "a"), ("+", 1, "b"), ("+", 1, "a"), ("-", 2)], "aaa"),
    ("c10", [("+", 0, "a"), ("+", 0, "b"), ("+", 1, "c"), ("-", 2)], "bc"),
    ("c11", [("+", 0, "a"), ("+", 0, "b"), ("+", 0, "c"), ("+", 0, "d"), ("-", 3)], "dcb"),
    ("c12", [("+", 0, "a"), ("+", 0, "a"), ("-", 0), ("-", 0), ("+", 0, "a"), ("-", 0)], ""),
    ("c13", [("+", 0, "a"), ("+", 1, "a"), ("+", 1, "a"), ("+", 1, "b")], "abaa"),
    ("nul and wide", [("+", 0, "\0"), ("+", 1, "\0"), ("+", 2, "\0"), ("+", 3, "\u0080")], "\0\0\0\u0080"),
    ("backspaces", [("+", 0, "abcdefghij"), *[("-", 9 - i) for i in range(5)]], "abcde"),
    ("astral", [("+", 0, "a👍🏽b"), ("-", 1), ("+", 3, "c")], "a🏽bc"),
]


@pytest.mark.parametrize("name,steps,want", ONE_SITE, ids=[c[0] for c in ONE_SITE])
@pytest.mark.parametrize("profile", ["sha256", "blake3"])
def test_one_site(name, steps, want, profile):
    p = made(steps, profile)
    assert p.text == want and len(p) == len(want)
    q = Peer(profile)
    q.merge_encoded(p.encode())
    assert q.text == want and q == p and q.encode() == p.encode() and not q.orphans


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(1025))
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert blake3(data[:1024]).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3(data).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


# Orders that BLAKE3 ids decide.
@pytest.mark.parametrize(
    "a,b,want",
    [
        ("we wrote", "this together ", "this together we wrote"),
        ("hello my name is david", "hello my name is zameena", "hello my name is zameenadavid"),
        ("aba", "aza", "azaba"),
        ("aaab", "aaac", "aaabc"),
    ],
)
def test_merges_by_blake3(a, b, want):
    one, two = made([("+", 0, a)], "blake3"), made([("+", 0, b)], "blake3")
    bytes_one, bytes_two = one.encode(), two.encode()
    one.merge_encoded(bytes_two)
    two.merge_encoded(bytes_one)
    assert one.text == two.text == want and one == two


def test_preimage_sizes():
    d, i = [b"d" * 32], b"i" * 32
    assert len(preimage("root", None, "x", [], ())) == 24 and len(preimage("root", None, "x", d, ())) == 57
    assert len(preimage("after", i, "x", [], ())) == 58 and len(preimage("before", i, "x", d, ())) == 92
    assert len(preimage("remove", None, None, [], [i])) == 54
    many = [bytes([k]) * 32 for k in range(40)]
    assert len(preimage("remove", None, None, [], many)) > 1024 and len(blake3(preimage("remove", None, None, [], many))) == 32


def sites(seed, n, profile="sha256"):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        p = Peer(profile)
        for _ in range(rnd.randrange(12)):
            if rnd.random() < 0.7 or not len(p):
                p.insert(rnd.randint(0, len(p)), "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))))
            else:
                p.remove(rnd.randrange(len(p)), rnd.randint(1, 3))
        out.append(p)
    return out


def merged(*peers):
    out = Peer(peers[0].profile)
    for p in peers:
        out.merge_encoded(p.encode())
    return out


@pytest.mark.parametrize("seed", range(25))
def test_merge_properties(seed):
    a, b, c = sites(seed, 3)
    assert merged(a, a) == a and merged(a, a).text == a.text
    ab, ba = merged(a, b), merged(b, a)
    assert ab == ba and ab.text == ba.text
    assert merged(ab, c).text == merged(a, merged(b, c)).text == merged(c, b, a).text
    for p in (a, b, c):  # a site's order is kept
        rest = iter(merged(a, b, c).text)
        assert all(ch in rest for ch in p.text) or any(n[1] == "remove" for x in (a, b, c) for n in x.nodes.values())


@pytest.mark.parametrize("seed", range(25))
def test_edits_after_a_merge_hit_what_the_text_shows(seed):
    rnd = random.Random(seed)
    m = merged(*sites(seed, 3))
    model = list(m.text)
    for _ in range(20):
        if rnd.random() < 0.6 or not model:
            at, s = rnd.randint(0, len(model)), rnd.choice(["x", "yz"])
            m.insert(at, s)
            model[at:at] = s
        else:
            at, n = rnd.randrange(len(model)), rnd.randint(1, 3)
            m.remove(at, n)
            del model[at : at + n]
        assert m.text == "".join(model)
    again = Peer()
    again.apply(rnd.sample(list(m.nodes.values()), len(m.nodes)))
    assert again.text == m.text and again == m and not again.orphans


@pytest.mark.parametrize("seed", range(25))
def test_rendering_equals_the_text_of_all_operations(seed):
    """Also where sites' logs cut the same characters into different runs."""
    rnd = random.Random(seed)
    sha = document.PROFILES["sha256"]
    records = []
    for p in sites(seed, 3) + sites(7, 1):
        nodes = list(p.nodes.values())
        records += document.compact(nodes) + document.compact(rnd.sample(nodes, len(nodes) * 2 // 3))
    typed = "abcabcabcd"
    for cut in (3, 6, 10):
        doc = document.Document()
        doc.insert(0, typed[:cut] + "xyz"[: rnd.randrange(4)])
        records += doc.records
    assert document.render(records) == document.by_character(records, "sha256")
    assert {r["rec_id"] for r in document.apart(records, sha)} >= {r["rec_id"] for r in records}


def test_orphans_drain():
    root = next(document.expand([{"kind": "root", "anchor": None, "text": "b", "extra_deps": [], "targets": []}]))
    after, before = (next(document.expand([{"kind": k, "anchor": root[0], "text": "a", "extra_deps": [], "targets": []}])) if k == "before" else next(document.expand([{"kind": "run", "anchor": root[0], "text": "a", "extra_deps": [], "targets": []}])) for k in ("after", "before"))
    p = Peer()
    seen = []
    for node in (after, before, root):
        p.apply([node])
        seen.append(len(p.orphans))
    assert seen == [1, 2, 0] and p.text == "aba" and len(p) == 3
    q = Peer()
    q.apply([(sha256(preimage("remove", None, None, [], [root[0]])), "remove", None, None, [], [root[0]])])
    assert len(q.orphans) == 1
    r = Peer()
    r.merge_encoded(q.encode())
    assert len(r.orphans) == 1
    r.apply([root])
    assert not r.orphans and r.text == ""


def test_a_removal_of_several_characters_survives_a_snapshot():
    p = made([("+", 0, "hello"), ("-", 1, 3), ("+", 1, "a")])
    q = merged(p)
    assert q.text == "hao" and not q.orphans
    with pytest.raises(ValueError):
        p.encode(strict=True)
    empty = made([("+", 0, "a"), ("-", 5, 2)])
    assert merged(empty) == empty and len(merged(empty).nodes) == 2


def test_removals_along_a_run_become_ranges():
    p = made([("+", 0, "abcdefghij"), *[("-", 9 - i) for i in range(5)], *[("-", 1) for _ in range(3)]])
    rows, _, _ = codec._sections(p.encode(strict=True))
    assert len(rows["backward_remove_runs"]) == 1 and len(rows["forward_remove_runs"]) == 1 and not rows["single_run_removes"]
    assert merged(p).text == p.text == "ae"
    sizes = codec.section_bytes(p.encode())
    assert sizes.pop("unused_ids") == 0 and sum(sizes.values()) == len(p.encode())


def test_an_insertion_on_a_removal_is_ignored():
    p = made([("+", 0, "ab"), ("-", 0)])
    removal = next(n for n in p.nodes.values() if n[1] == "remove")
    bad = next(document.expand([{"kind": "run", "anchor": removal[0], "text": "x", "extra_deps": [], "targets": []}]))
    p.apply([bad])
    assert p.text == "b" and bad[0] not in p.nodes


def test_out_of_range_and_empty_edits():
    p = made([("+", 0, "ab"), ("+", 9, "z")])
    assert sorted(p.text) == ["a", "b", "z"] and p.text in ("abz", "zab")
    assert sum(n[1] == "root" for n in p.nodes.values()) == 2
    n = len(p.nodes)
    p.insert(0, "")
    p.remove(0, 0)
    assert len(p.nodes) == n
    long = made([("+", 0, "The quick brown fox jumps over the lazy dog. " * 10)])
    records = document.compact(list(long.nodes.values()))
    assert [r["kind"] for r in records if r["kind"] != "run"] == ["root"] and sum(len(r["text"]) for r in records) == 450


def test_batches_and_their_errors():
    doc = document.Document()
    doc.insert(0, "héllo")
    doc.insert(2, "x")
    doc.remove(0, 2)
    data = codec.encode_batch(doc.records)
    back = codec.decode_batch(data)
    assert {n[0] for n in document.expand(back)} == {n[0] for n in document.expand(doc.records)} and codec.encode_batch(back) == data
    for broken, kind in ((data[:-1], "eof"), (b"\x01\x09", "tag"), (b"\xff" * 12, "varint"), (b"\x01\x01\x00\xff", "utf8"), (b"\x01\x00" + b"i" * 32 + b"\x00\x00", "empty_run"), (b"", "eof"), (b"\xff\xff\x7f", "eof")):
        with pytest.raises(codec.DecodeError) as e:
            codec.decode_batch(broken)
        assert e.value.kind == kind
    with pytest.raises(codec.DecodeError) as e:
        codec.decode_snapshot(b"\x00\x01\x01\x05a")
    assert e.value.kind == "index"
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert codec.Reader(codec.varint(n)).num() == n


@pytest.mark.parametrize("seed", range(10))
def test_a_batch_equals_single_insertions(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("abc") for _ in range(12))
    whole, parts = made([("+", 0, text)]), made([("+", 0, text[:5]), ("+", 5, text[5:])])
    assert whole == parts and document.compact(list(whole.nodes.values())) == document.compact(list(parts.nodes.values()))


@pytest.mark.parametrize("seed", range(20))
def test_order_equals_its_definition(seed):
    rnd = random.Random(seed)
    nodes = []
    for i in range(40):
        anchor = rnd.choice(nodes)[0] if nodes and rnd.random() < 0.9 else None
        nodes.append((sha256(bytes([seed, i])), rnd.choice(["before", "after"]) if anchor else "root", anchor))

    def lin(n):
        side = lambda op: [x for c in sorted(c for c, o, a in nodes if a == n and o == op) for x in lin(c)]
        return [*side("before"), n, *side("after")]

    want = [x for r in sorted(n for n, o, _ in nodes if o == "root") for x in lin(r)]
    placed, end = document.order(nodes)
    assert placed == want
    for n, _, _ in nodes:
        below = [x for c in (c for c, o, a in nodes if a == n and o == "after") for x in lin(c)]
        assert set(want[want.index(n) + 1 : end[n] + 1]) == set(below)


def exchanged(one, two):
    """Both replicas after each has sent the other what it had before."""
    sent = one.encode(), two.encode()
    one.merge_encoded(sent[1])
    two.merge_encoded(sent[0])
    assert one == two and one.text == two.text and one.encode() == two.encode()
    return one.text


def test_concurrent_typing():
    got = exchanged(made([("+", 0, "hello "), ("+", 6, "there")]), made([("+", 0, "good "), ("+", 5, "day")]))
    assert got in ("hello theregood day", "good dayhello there")


def test_concurrent_common_prefix():
    got = exchanged(made([("+", 0, "the cat sat")]), made([("+", 0, "the cap fell")]))
    assert got in ("the cat satp fell", "the cap fellt sat")


def test_insertion_before_inside_code_after_a_sync():
    one, two = made([("+", 0, "f(x)")]), Peer()
    exchanged(one, two)
    one.insert(2, "a, ")
    two.insert(0, "return ")
    assert exchanged(one, two) == "return f(a, x)"


def test_fork_and_merge_of_a_list():
    one, two = made([("+", 0, "milk\neggs\n")]), Peer()
    exchanged(one, two)
    one.insert(10, "tea\n")
    two.remove(0, 5)
    two.insert(0, "oats\n")
    assert exchanged(one, two) == "oats\neggs\ntea\n"


def test_concurrent_roots():
    one, two, three = (made([("+", 0, t)]) for t in ("one.", "two!", "6 x 3"))
    exchanged(one, two)
    got = exchanged(one, three)
    exchanged(two, three)
    assert two.text == got and all(t in got for t in ("one.", "two!", "6 x 3")) and len(got) == 13


def test_blocks_are_a_list():
    rnd, plain, blocks = random.Random(4), list(range(3000)), document.Blocks(range(3000))
    for _ in range(1500):
        at, n = rnd.randint(0, len(plain)), rnd.choice([0, 1, 3, 700])
        if rnd.random() < 0.5:
            blocks.insert(at, list(range(n)))
            plain[at:at] = range(n)
        else:
            assert blocks.cut(at, n) == plain[at : at + n]
            del plain[at : at + n]
        k = rnd.randint(-1, len(plain) + 1)
        assert len(blocks) == len(plain) and blocks.get(k) == (plain[k] if 0 <= k < len(plain) else None)
    assert list(blocks) == plain
    assert blocks.cut(0, len(plain)) == plain and len(blocks) == 0 and blocks.get(0) is None


@pytest.mark.parametrize("where", ["middle", "second", "end", "front"])
def test_insertions_take_time_in_proportion(where):
    def seconds(n):
        doc, start = document.Document(), time.perf_counter()
        for i in range(n):
            doc.insert({"middle": i // 2, "second": min(i, 1), "end": i, "front": 0}[where], "x")
        return time.perf_counter() - start

    assert min(seconds(12_000) for _ in range(3)) < 3.5 * min(seconds(6_000) for _ in range(3))


def test_bytes_of_a_snapshot():
    """The layout, byte by byte: dictionary, then sections of counted rows."""
    p = made([("+", 0, "ab")])
    root = next(n[0] for n in p.nodes.values() if n[1] == "root")
    roots, runs = bytes([1, 0]) + b"a", bytes([1, 0, 0, 1]) + b"b"
    assert p.encode() == bytes([1]) + root + roots + runs + bytes(7)
    p.insert(0, "é")
    before = next(n for n in p.nodes.values() if n[1] == "before")
    ids = sorted([root, *before[4]])
    befores = bytes([1, 1, ids.index(before[4][0]), ids.index(root)]) + "é".encode()
    assert p.encode() == bytes([2]) + b"".join(ids) + roots + bytes([1, ids.index(root), 0, 1]) + b"b" + befores + bytes(6)
