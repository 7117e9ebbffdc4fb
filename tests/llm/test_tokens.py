import base64
import random

import numpy as np
import pytest
from conftest_llm import EDGE

from tessellog.llm import bpe_codec, queries, token_counts

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    alphabet = "ab e\n 0▁éthTHE日𝒳\x00.'s"
    some = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(120))) for _ in range(800)]
    return [t for _, _, t in EDGE] + some + ["a" * 3000, " " * 200, "<s> </s> <0x0A> <unk> <|endoftext|>", "aaaa" * 9 + "▁▁ ▁x"]


def test_encoding_equals_the_library(texts):
    import tiktoken

    ranks = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    own = bpe_codec.ByteBpe(ranks, queries.pattern())
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs, special_tokens={})
    ids = own.encode_all(texts)
    assert ids == [np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes() for t in texts]
    assert [own.decode(i) for i in ids] == [(t or "").encode() for t in texts]


def test_forgetting_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(bpe_codec, "MEMO_ENTRIES", 3)
    monkeypatch.setattr(bpe_codec, "CHUNK_CHARS", 50)
    ranks = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    own = bpe_codec.ByteBpe(ranks, queries.pattern())
    assert [own.decode(i) for i in own.encode_all(texts)] == [(t or "").encode() for t in texts]


def test_counts_equal_the_library(texts):
    import sentencepiece

    model = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert token_counts.PieceCounter(model).count_all(texts) == [len(library.encode(t or "")) for t in texts]


def test_merges_that_undercut_their_own_rank():
    """A made-up vocabulary in which a late merge enables an early one."""
    scores = {c: -100.0 for c in "abcd"} | {"cd": -5.0, "bcd": -1.0, "ab": -3.0, "aa": -4.0, "aaa": -2.0}
    counter = token_counts.PieceCounter.__new__(token_counts.PieceCounter)
    counter._build(scores)

    def plain(text):
        parts = list(text)
        while True:
            found = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
            if not found:
                return len(parts)
            i = -max(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))) for _ in range(2000)]
    assert counter.count_distinct(words).tolist() == [plain(w) for w in words]


def test_frames(spark, edge, empty):
    ranks, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pattern()
    coded = bpe_codec.decode(bpe_codec.encode(edge, ranks, pattern), ranks, pattern)
    rows = coded.select("doc_id", "text", "token_ids", "decoded").collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _, _ in EDGE)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe_codec.encode(empty, ranks, pattern).count() == bpe_codec.round_trip(empty, ranks, pattern).count() == 0
    at_once = bpe_codec.round_trip(edge, ranks, pattern).select("doc_id", "text", "token_ids", "decoded").collect()
    assert sorted(map(str, at_once)) == sorted(map(str, rows))
    model = queries.vocabulary("piece_bpe_32k.model")
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(edge, model).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] > 0
    assert token_counts.count_tokens(empty, model).count() == 0


def test_queries_equal_the_libraries(spark, sf_dir):
    """Every column of the two registered queries."""
    import hashlib

    import sentencepiece
    import tiktoken

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.vocabulary("byte_bpe_multi_50k.tiktoken").splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs, special_tokens={})
    want = []
    for d, t in texts.items():
        ids = library.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = queries.QUERIES["op1_bpe_codec"](spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.select(*got.columns[:4]).collect())) == sorted(want)
    model = sentencepiece.SentencePieceProcessor(model_proto=queries.vocabulary("piece_bpe_32k.model"))
    want = [(d, len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in texts.items()]
    got = queries.QUERIES["op2_token_counts"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
