"""Nulls in every column: each operator gives one row for each row."""

from conftest_llm import table_of

import corpus_pipeline
from tessellog.llm import bpe_codec, exact_dedup, licenses, mixing, near_dedup, quality, queries, sharding, token_counts, toxicity, url_filters

ROWS = [(None, None, None), (None, "a", "one two three four five six"), (1, None, "One two three four five six"), (1, "a", None), (2, "b", "seven")]


def test_null_ids_sources_and_texts(spark, sf_dir):
    docs = table_of(spark, ROWS)
    ranks, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pattern()
    none = spark.createDataFrame([(None, None, None), (1, None, 1)], "doc_id long, low_quality int, toxic int")
    models = toxicity.train(docs, none, queries.CATEGORIES)
    made = [
        bpe_codec.encode(docs, ranks, pattern),
        token_counts.count_tokens(docs, queries.vocabulary("piece_bpe_32k.model")),
        toxicity.score(docs, models, queries.CATEGORIES),
        near_dedup.near_dedup(docs, 4),
        mixing.plan(docs),
        quality.judge(docs),
        licenses.scan(docs),
        sharding.assign(docs),
        exact_dedup.dedup(docs),
    ]
    assert [df.count() for df in made] == [len(ROWS)] * len(made)
    pages = spark.createDataFrame([(None, None), (None, "http://a.b/"), (1, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(None, 1), (1, None)], "page_id long, bad int")
    assert url_filters.judge(pages, outcomes).count() == 3
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
    assert out.count() > 0
