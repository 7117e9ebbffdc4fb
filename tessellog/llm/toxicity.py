"""Toxicity by a classifier chain of linear models.

The chain's categories are label columns in a fixed order.  The model of each
category is a logistic regression over word-start features and over the earlier
categories' probabilities.  While training, those probabilities come from models
that did not see the row (out-of-fold); while scoring, from the earlier models.

Features of a text are its distinct words' starts of 3 to 6 letters and the whole
words, so that inflected forms of one stem share features.  Each model keeps the
``MAX_FEATURES`` most telling ones.  It is trained on the driver from the rows that
have its label; the sample holds ``TRAIN_ROWS`` of these for each category (those whose
ids hash lowest), whatever the input's size; scoring reads every whole text where it lies, without a shuffle.

Null and empty texts, like all without letters, have no features and probability 0.  Rows whose labels
are all null do not train; where one label is null, the row trains the other categories,
and the model that did not see it gives its probability to the later ones; without any labelled row every probability is 0; a
category with one class only gets its constant rate.  A labelled id that has
several rows trains once, by the larger labels and the row with the smallest features.  A score that equals the threshold is toxic.  Repeated rows score alike; a very long text is scored whole.  Extra
columns pass through; those with a result's name are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, mapped, parts, small_batches

#: Labelled rows that training takes at most for each category.
TRAIN_ROWS = 6000
#: Features that each linear model keeps at most.
MAX_FEATURES = 256
#: Numbers that features hash to; a text's features so take 4 bytes each on the driver.
SPACE = 1 << 21
#: Standard errors by which a kept feature's shares differ at least.
MIN_Z = 5
FOLDS = 5
L2 = 0.3
WORDS = re.compile(r"[^\W\d_]+").findall
#: Words whose features a worker remembers; beyond, it forgets them all and goes on.
MEMO_ENTRIES = 50_000
#: Features that training counts at a time.
PIECE = 1 << 19


def word_features(word: str) -> list[int]:
    """Starts of 3 to 6 letters and the whole word, each as a number below ``SPACE``."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SPACE for f in (*(f"{word[:k]}*" for k in range(3, 7) if len(word) >= k), word)]


def text_features(text: str | None) -> set[int]:
    return {f for word in set(WORDS((text or "").lower())) for f in word_features(word)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """A logistic regression: weights by feature, weights of earlier probabilities, bias."""

    words: dict[int, float] = field(default_factory=dict)
    chain: list[float] = field(default_factory=list)
    bias: float = -30.0

    def predict(self, features: set[int], earlier: list[float]) -> float:
        z = self.bias + sum(self.words[f] for f in sorted(features & self.words.keys())) + sum(a * b for a, b in zip(self.chain, earlier, strict=True))
        return float(_sigmoid(np.array(z)))


class Scorer:
    """A chain's models over the features that any of them uses, as arrays, in one process."""

    def __init__(self, chain: list[Linear]):
        self.chain = chain
        self.used = {f: i for i, f in enumerate(sorted(set().union(*(m.words.keys() for m in chain))))}
        self.weights = [np.array([m.words.get(f, 0.0) for f in self.used]) for m in chain]
        self.memo: dict[str, list[int]] = {}

    def places(self, word: str) -> list[int]:
        """The used features of ``word``, by number."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            found = self.memo[word] = [self.used[f] for f in word_features(word) if f in self.used]
        return found

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One row of probabilities for each of ``texts``; zeros for a text without letters."""
        some = np.zeros(len(texts), dtype=bool)
        each = []
        for i, text in enumerate(texts):
            words = set(WORDS((text or "").lower()))
            some[i] = bool(words)
            each.append({f for word in words for f in self.places(word)})
        owner = np.repeat(np.arange(len(texts)), list(map(len, each)))
        place = np.fromiter((f for own in each for f in sorted(own)), dtype=np.int64, count=len(owner))
        out = np.zeros((len(texts), len(self.chain)))
        for k, (model, weights) in enumerate(zip(self.chain, self.weights, strict=True)):
            z = np.bincount(owner, weights[place], len(texts)) + out[:, :k] @ np.array(model.chain) + model.bias
            out[:, k] = np.where(some, _sigmoid(z), 0.0)
        return out


@dataclass
class Rows:
    """The features of many texts: ``features[i]`` is one of text ``owner[i]``."""

    features: np.ndarray
    owner: np.ndarray
    n: int

    @classmethod
    def of(cls, each: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*each, np.zeros(0, np.uint32)]).astype(np.uint32), np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each]), len(each))

    def take(self, rows: np.ndarray) -> Rows:
        new = np.full(self.n, -1, dtype=np.int32)
        new[rows] = np.arange(len(rows))
        at = new[self.owner]
        keep = at >= 0
        return Rows(self.features[keep], at[keep], len(rows))

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Features and owners, ``PIECE`` at a time: what is derived from them is larger than they are."""
        for lo in range(0, len(self.features), PIECE):
            yield self.features[lo : lo + PIECE], self.owner[lo : lo + PIECE]

    def matrix(self, names: np.ndarray) -> np.ndarray:
        """Presence of each of ``names``, which are sorted."""
        out = np.zeros((self.n, len(names)))
        for features, owner in self.pieces() if len(names) else ():
            at = np.minimum(np.searchsorted(names, features), len(names) - 1)
            hit = names[at] == features
            out[owner[hit], at[hit]] = 1
        return out


def select(rows: Rows, y: np.ndarray) -> np.ndarray:
    """The features whose share differs most between the classes, by a two-sample z score; sorted."""
    n1, n0 = y.sum(), len(y) - y.sum()
    a, b = np.zeros(SPACE, dtype=np.int32), np.zeros(SPACE, dtype=np.int32)
    for features, owner in rows.pieces():
        one = y[owner] > 0
        a += np.bincount(features[one], minlength=SPACE).astype(np.int32)
        b += np.bincount(features[~one], minlength=SPACE).astype(np.int32)
    names = np.flatnonzero(a + b >= 3)
    a, b = a[names], b[names]
    share = (a + b + 1) / (n1 + n0 + 2)
    z = np.abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    best = np.lexsort((names, -z))[:MAX_FEATURES]
    return np.sort(names[best[z[best] >= MIN_Z]])


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """One ridge-penalised logistic regression by Newton steps."""
    k = earlier.shape[1]
    if len(y) == 0:
        return Linear(chain=[0.0] * k)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return Linear(chain=[0.0] * k, bias=float(np.log(rate / (1 - rate))))
    names = select(rows, y)
    x = np.column_stack([rows.matrix(names), earlier, np.ones(rows.n)])
    w = np.zeros(x.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(x.shape[1], L2)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(dict(zip(names.tolist(), w.tolist(), strict=False)), w[len(names) : len(names) + k].tolist(), float(w[-1]))


def probabilities(model: Linear, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    names = np.array(sorted(model.words), dtype=np.int64)
    return _sigmoid(rows.matrix(names) @ np.array([model.words[f] for f in names.tolist()]) + earlier @ np.array(model.chain) + model.bias)


def fit_chain(rows: Rows, labels: np.ndarray) -> list[Linear]:
    """A model for each column of ``labels`` (NaN: not labelled), later ones trained with predictions of the earlier.

    The predictions are out-of-fold for rows that have the earlier label; the others' come from the earlier model itself.
    """
    fold = np.arange(rows.n) % FOLDS
    earlier, models = np.zeros((rows.n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        labelled = ~np.isnan(y)
        has = np.flatnonzero(labelled)
        models.append(fit(rows.take(has), earlier[has], y[has]))
        if k + 1 < labels.shape[1]:
            held_out = probabilities(models[-1], rows, earlier)
            for n in range(FOLDS):
                seen, own = np.flatnonzero(labelled & (fold != n)), np.flatnonzero(labelled & (fold == n))
                held_out[own] = probabilities(fit(rows.take(seen), earlier[seen], y[seen]), rows.take(own), earlier[own])
            earlier = np.column_stack([earlier, held_out])
    return models


def train(docs: DataFrame, labels: DataFrame, categories: list[str], train_rows: int = TRAIN_ROWS) -> list[Linear]:
    """Models of the chain; ``labels`` has doc_id and a 0/1 column for each category (null: not labelled)."""
    ys = [f"y{i}" for i in range(len(categories))]
    by_id = (
        labels.select("doc_id", *[F.col(c).cast("int").alias(y) for c, y in zip(categories, ys, strict=True)])
        .where("doc_id IS NOT NULL")
        .dropna("all", subset=ys)
        .groupBy("doc_id")
        .agg(*[F.max(y).alias(y) for y in ys])
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    lowest = [by_id.where(F.col(y).isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for y in ys]
    ready = reduce(DataFrame.union, lowest).distinct()
    small_batches(docs.sparkSession)
    # The sample has at most train_rows ids for each category, which bounds what is broadcast and what comes to the driver.
    texts = docs.select("doc_id", "text").join(F.broadcast(ready), "doc_id")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(y, T.IntegerType()) for y in ys], T.StructField("features", T.BinaryType())])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text")):
            t = pa.Table.from_batches([batch])
            found = [np.array(sorted(text_features(x)), dtype="<u4").tobytes() for x in t["text"].to_pylist()]
            yield from t.select(["doc_id", *ys]).append_column("features", pa.array(found, pa.binary())).to_batches()

    # Of an id's rows the one with the smallest features trains, so a repeated id sends one row.
    got = mapped(texts, featurise, schema).groupBy("doc_id", *ys).agg(F.min("features").alias("features")).toArrow()
    ids, found = np.asarray(got["doc_id"]), got["features"].to_pylist()
    # In an order that does not follow the ids, so that folds are alike.
    order = sorted(range(len(ids)), key=lambda i: (int(ids[i]) * 2654435761 % 2**32, int(ids[i])))
    rows = Rows.of([np.frombuffer(found[i], dtype="<u4") for i in order])
    y = np.array([np.asarray(got[c], dtype=float)[order] for c in ys]).T.reshape(rows.n, len(ys))
    del got, found
    models = fit_chain(rows, y)
    del rows
    give_back()
    return models


def score(docs: DataFrame, models: list[Linear], categories: list[str], threshold: float = 0.5, prefix: str = "p_", toxic: str = "toxic") -> DataFrame:
    """Adds ``p_<category>`` for each category, and ``toxic``: whether the last one reaches ``threshold``."""
    names = [f"{prefix}{c}" for c in categories]
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.col(c) for c in docs.columns if c not in (*names, toxic)])
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names], T.StructField(toxic, T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in (p for b in batches for p in parts(b, "text")):
            found = scorer.score(batch.column(at).to_pylist())
            verdicts = pa.array(found[:, -1] >= threshold, pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64()) for x in found.T], verdicts], names=[*batch.schema.names, *names, toxic])

    return mapped(docs, run, schema)
