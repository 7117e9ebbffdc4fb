import base64

import numpy as np
import plain
from conftest_llm import table_of
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessellog.llm import mixing, queries, toxicity


def test_pipeline_equals_brute_force(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = toxicity.train(docs, queries.chain_labels(spark, sf_dir), queries.CATEGORIES)
    rows = []
    for r in docs.collect():
        p = []
        for m in models:
            p.append(m.predict(toxicity.text_features(r.text), p))
        if p[-1] < 0.5 or not toxicity.text_features(r.text):
            rows.append((r.doc_id, r.source, r.text))
    keep = {k for _, k, _, _ in plain.exact([(d, t) for d, _, t in rows])}
    rows = [r for r in rows if r[0] in keep]
    near = {d for d, _, c in plain.components([(d, t) for d, _, t in rows], 5) if c == d}
    rows = [r for r in rows if r[0] in near]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.vocabulary("byte_bpe_multi_50k.tiktoken").splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {d: np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes() for d, _, t in rows}
    source = {d: s for d, s, _ in rows}
    want = [(d, source[d], ids[d]) for _, d, _ in plain.use_positions(rows, mixing.SLOPES)]
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "source", "position", "token_ids", "n_tokens", "round_trip"]
    got = sorted(got.collect(), key=lambda r: r.position)
    assert len({r.position for r in got}) == len(got) and [(r.doc_id, r.source, bytes(r.token_ids)) for r in got] == want
    assert all(r.round_trip and r.n_tokens * 4 == len(r.token_ids) for r in got)


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, "a", None), (2, None, ""), (3, "b", "some words here"), (3, "b", "some words here"), (4, "b", "some words here")]
    docs = table_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, docs.limit(0), docs.withColumns({c: F.lit("x") for c in ("text_sha256", "toxic", "stays", "kept", "mix_id", "dropped_doc_id")})):
        out = frame
        kept = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf_dir)
            assert out.columns == frame.columns and out.dtypes == frame.dtypes
            kept.append(sorted(r.doc_id for r in out.select("doc_id").collect()))
        last = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, out, sf_dir).collect())
        if frame.isEmpty():
            assert kept == [[]] * 4 and last == []
        else:  # of three equal texts the largest id stays; null and empty texts are equal, and the mix takes none of them; 4 is used twice at most
            assert kept[:3] == [[1, 2, 3, 3, 4], [2, 4], [2, 4]] and {*kept[3]} == {4} and [d for d, _ in last] == kept[3] and all(n > 0 for _, n in last)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
