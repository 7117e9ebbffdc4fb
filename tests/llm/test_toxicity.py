import tracemalloc

import numpy as np
import plain
from conftest_llm import table_of

from tessellog.llm import queries, toxicity


def test_chain_learns_stems(spark):
    bad = ["grumpol", "snarvik"]
    rows = [(i, "s", f"alpha beta {'grumpolen' if i % 8 == 0 else 'snarvika' if i % 8 == 4 else 'gamma'} w{i % 13} v{i % 7}") for i in range(400)]
    docs = table_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 4 == 0)) for i in range(300)] + [(0, 0, 0), (1, None, 0)], "doc_id long, low_quality int, toxic int")
    models = toxicity.train(docs, labels, ["low_quality", "toxic"])
    got = toxicity.score(docs, models, ["low_quality", "toxic"]).collect()
    assert len(got) == 400 and all(r.toxic == (r.doc_id % 4 == 0) for r in got)
    other = toxicity.score(table_of(spark, [(1, "s", f"x {bad[0]}isch y"), (2, "s", None), (3, "s", "")]), models, ["low_quality", "toxic"]).collect()
    assert [r.toxic for r in other] == [True, False, False]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), queries.chain_labels(spark, sf)
    models = toxicity.train(docs, labels.where("doc_id % 3 > 0"), queries.CATEGORIES)
    rows = toxicity.score(docs, models, queries.CATEGORIES).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = sum(r.found == (r.toxic == 1) for r in rows)
    assert right / len(rows) > 0.9 and not models[1].chain == []


def test_few_or_no_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    models = toxicity.train(edge, none, queries.CATEGORIES)
    assert not any(r.toxic for r in toxicity.score(edge, models, queries.CATEGORIES).collect())
    one = spark.createDataFrame([(4, 1, 0), (8, 1, 0)], "doc_id long, low_quality int, toxic int")
    models = toxicity.train(edge, one, queries.CATEGORIES)
    assert toxicity.score(edge, models, queries.CATEGORIES).where("toxic").count() == 0
    assert toxicity.score(empty, models, queries.CATEGORIES).count() == 0


def test_rows_without_one_label_train_the_other_categories(spark):
    rows = [(i, "s", f"alpha beta {'grumpolen' if i % 4 == 0 else 'gamma'} w{i % 13} v{i % 7}") for i in range(400)]
    docs = table_of(spark, rows)
    schema = "doc_id long, low_quality int, toxic int"
    on_toxic = [(i, None if i % 4 == 0 else i % 2, int(i % 4 == 0)) for i in range(300)]
    nowhere = [(i, None, int(i % 4 == 0)) for i in range(300)]
    for made in (on_toxic, nowhere):
        models = toxicity.train(docs, spark.createDataFrame([*made, (None, 1, 1), (399, None, None)], schema), queries.CATEGORIES)
        got = toxicity.score(docs, models, queries.CATEGORIES).collect()
        assert all(r.toxic == (r.doc_id % 4 == 0) for r in got)


def test_sample_holds_rows_of_each_category(spark):
    rows = [(i, "s", f"alpha {'grumpolen' if i % 4 == 0 else 'gamma'} w{i % 13}") for i in range(600)]
    docs = table_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, None if i < 400 else int(i % 4 == 0)) for i in range(600)], "doc_id long, low_quality int, toxic int")
    models = toxicity.train(docs, labels, queries.CATEGORIES, train_rows=200)
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in toxicity.score(docs, models, queries.CATEGORIES).collect())


def test_later_models_see_out_of_fold_probabilities():
    rows = toxicity.Rows.of([np.array([i % 2, 100 + i % 11], dtype=np.uint32) for i in range(200)])
    labels = np.array([[i % 2, i % 2] for i in range(200)], dtype=float)
    models = toxicity.fit_chain(rows, labels)
    assert len(models[0].chain) == 0 and len(models[1].chain) == 1 and models[1].chain[0] > 0
    assert models[1].predict({1}, [0.9]) > 0.5 > models[1].predict({0}, [0.1])


def test_query_equals_a_plain_chain(spark, sf_dir):
    """The registered query's columns against dense models over feature strings, with the query's sample and folds."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: (r.low_quality, r.toxic) for r in queries.chain_labels(spark, sf_dir).collect() if r.doc_id in texts}
    first = sorted(labels, key=lambda d: (d * 2654435761 % 2**32, d))
    order = first + sorted(texts.keys() - labels.keys())
    want = plain.toxic_chain([texts[d] for d in order], [labels[d] for d in first], toxicity.MAX_FEATURES, toxicity.MIN_Z, toxicity.FOLDS, toxicity.L2)
    got = {r.doc_id: r for r in queries.QUERIES["op3_toxicity"](spark, sf_dir).collect()}
    assert got.keys() == set(order)
    for d, (low, bad) in zip(order, want):
        assert abs(got[d].p_low_quality - low) < 1e-5 and abs(got[d].p_toxic - bad) < 1e-5 and got[d].toxic == (bad >= 0.5)


def test_scores_at_the_threshold_and_of_repeated_rows(spark):
    models = [toxicity.Linear(bias=-1.0), toxicity.Linear(words={f: 0.25 for f in toxicity.word_features("bad")}, chain=[0.0], bias=-0.5)]
    docs = table_of(spark, [(1, "s", "bad"), (1, "s", "bad"), (2, "s", "good"), (3, "s", "123"), (4, "s", "bad " * 200_000)])
    rows = sorted(toxicity.score(docs, models, ["low_quality", "toxic"]).collect(), key=lambda r: r.doc_id)
    assert [(r.p_toxic == 0.5, r.toxic) for r in rows] == [(True, True), (True, True), (False, False), (False, False), (True, True)]
    assert rows[3].p_toxic == 0.0


def test_repeated_ids_and_labels_without_documents(spark):
    """Labels without documents do not use up the sample, and an id with many rows trains once."""
    docs = table_of(spark, [(i, "s", f"alpha {'grumpolen' if i % 4 == 0 else 'gamma'} w{i % 13}") for i in range(200)] + [(7, "s", f"omega v{i}") for i in range(300)])
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(5000)], "doc_id long, low_quality int, toxic int")
    models = toxicity.train(docs, labels, queries.CATEGORIES, train_rows=150)
    got = toxicity.score(docs, models, queries.CATEGORIES).where("text LIKE 'alpha%'").collect()
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in got)


def test_training_holds_little_besides_the_sample():
    """The driver's memory at the peak: the sample (4 bytes a feature, 4 its owner), a fold of it, and counters of fixed size."""
    rng = np.random.default_rng(2)
    n, each = 2000, 2000
    rows = toxicity.Rows.of([np.sort(rng.integers(0, 50_000, each)).astype(np.uint32) for _ in range(n)])
    labels = rng.integers(0, 2, (n, 2)).astype(float)
    tracemalloc.start()
    models = toxicity.fit_chain(rows, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(models) == 2 and rows.owner.tolist() == np.repeat(np.arange(n), each).tolist()
    assert peak <= 23 * n * each
