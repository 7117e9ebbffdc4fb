"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

The model file is read field by field: pieces, scores, types and the normaliser's
flags.  A text is cut wherever no piece spans the two neighbouring characters, so
no merge can cross the cut; the parts are its pre-tokens.  The distinct pre-tokens
of a chunk become one ragged numpy array of symbols.  Each round finds the
lowest-rank pair of every sequence and applies it to all of them at once; symbols
that are left are the tokens.  A symbol outside the vocabulary counts its UTF-8
bytes, as byte fallback gives them.

Where a merge could make a pair of a lower rank than its own, or several pieces
share a score, only the leftmost pair of a sequence is merged in a round; both
cases are found from the vocabulary when it is read.  Nulls and empty texts have
no tokens; a very long text is counted whole, by its distinct pre-tokens.  Rows are independent of each other, so
repeated rows count alike; extra columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, parts, small_batches

#: Pre-tokens, and characters of them, whose counts a worker remembers; beyond either, it forgets them all and goes on.
MEMO_ENTRIES, MEMO_CHARS = 150_000, 4_000_000
#: Characters of text that are split and counted at a time; a longer text is a chunk of its own.
CHUNK_CHARS = 1_000_000
NONE = np.int64(1) << 60
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]


class PieceCounter:
    """Counts tokens of one model, in one process."""

    def __init__(self, model: bytes):
        pieces, self.dummy_prefix = [], True
        kind_of_model = 1
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, 1)))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                own = dict(_fields(value))
                self.dummy_prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("only an identity normaliser that keeps and escapes white space is supported")
        if kind_of_model != 2 or not any(kind == 6 for _, _, kind in pieces) or any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("only a BPE model with byte fallback and without user-defined or unused pieces is supported")
        normal = {text: score for text, score, kind in pieces if kind == 1}
        self._build(normal)

    def _build(self, normal: dict[str, float]) -> None:
        chars = sorted({c for text in normal for c in text})
        symbols = {c: i for i, c in enumerate(chars)}
        for text in normal:
            symbols.setdefault(text, len(symbols))
        self.n = len(symbols) + 1  # the last symbol is any character that no piece holds
        self.char_ids = {ord(c): i for i, c in enumerate(chars)}
        #: Tokens that a surviving symbol counts as; characters that are no pieces fall back to bytes.
        self.weight = np.ones(self.n, dtype=np.int64)
        for c in chars:
            if c not in normal:
                self.weight[symbols[c]] = len(c.encode())
        scores = {score: rank for rank, score in enumerate(sorted({*normal.values()}, reverse=True))}
        ties = np.zeros(len(scores), dtype=np.int64)
        keys, ranks, results, backward = [], [], [], np.zeros(len(scores), dtype=bool)
        for text, score in normal.items():
            rank = scores[score]
            ties[rank] += 1
            for cut in range(1, len(text)):
                left, right = text[:cut], text[cut:]
                if left in symbols and right in symbols:
                    keys.append(symbols[left] * self.n + symbols[right])
                    ranks.append(rank)
                    results.append(symbols[text])
                    for part in (left, right):
                        if part in normal and len(part) > 1 and scores[normal[part]] > rank:
                            backward[scores[normal[part]]] = True
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.results = np.array(results, dtype=np.int64)[order]
        self.leftmost_only = backward | (ties > 1)
        bigrams = {text[i : i + 2] for text in normal for i in range(len(text) - 1)}
        self.bigrams = np.array(sorted(symbols[b[0]] * self.n + symbols[b[1]] for b in bigrams), dtype=np.int64)
        inner_space = any(a != SPACE and b == SPACE for a, b in bigrams)
        newline = any("\n" in b for b in bigrams)
        self.split = (lambda text: [text]) if inner_space else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if newline else f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+").findall
        self.memo: dict[str, int] = {}
        self.held = 0

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.ranks[at], NONE), self.results[at]

    def count_distinct(self, words: list[str]) -> np.ndarray:
        """Tokens of each of ``words``, which are pre-tokens."""
        total = np.zeros(len(words), dtype=np.int64)
        if not words:
            return total
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        kinds, back = np.unique(points, return_inverse=True)
        known = np.array([self.char_ids.get(int(p), self.n - 1) for p in kinds], dtype=np.int64)
        symbols = known[back]
        byte_length = np.array([1 if p < 0x80 else 2 if p < 0x800 else 3 if p < 0x10000 else 4 for p in kinds], dtype=np.int64)[back]
        unknown = symbols == self.n - 1
        np.add.at(total, owner[unknown], byte_length[unknown])
        # Sequences: parts of a word that some merge could join; an unknown character is a cut by itself.
        pair = symbols[:-1] * self.n + symbols[1:]
        joined = (owner[:-1] == owner[1:]) & np.isin(pair, self.bigrams)
        seq = np.concatenate([[0], np.cumsum(~joined)])
        keep = ~unknown
        symbols, seq, owner = symbols[keep], seq[keep], owner[keep]
        while len(symbols):
            same = seq[:-1] == seq[1:]
            rank, made = self._lookup(symbols[:-1], symbols[1:])
            rank[~same] = NONE
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(np.append(rank, NONE), starts)  # the last pair of a sequence is void
            sizes = np.diff(np.append(starts, len(symbols)))
            done = lowest == NONE
            ended = np.repeat(done, sizes)
            np.add.at(total, owner[ended], self.weight[symbols[ended]])
            live = np.flatnonzero(~ended)
            if not len(live):
                break
            rank_all, made_all = np.append(rank, NONE), np.append(made, 0)
            low = np.repeat(lowest, sizes)
            hit = (rank_all == low) & ~ended
            # Of overlapping pairs every other one, from the left.
            at = np.flatnonzero(hit)
            chain = np.concatenate([[True], np.diff(at) > 1])
            first = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            single = self.leftmost_only[rank_all[at]]
            if single.any():
                fresh = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
                at = at[~single | fresh]
            symbols = symbols.copy()
            symbols[at] = made_all[at]
            stay = ~ended
            stay[at + 1] = False
            symbols, seq, owner = symbols[stay], seq[stay], owner[stay]
        return total

    def _count_chunk(self, texts: list[str]) -> list[int]:
        split = [self.split(text) for text in texts]
        if len(self.memo) > MEMO_ENTRIES or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        unseen = [word for word in set().union(*split) if word not in self.memo]
        self.held += sum(map(len, unseen))
        self.memo.update(zip(unseen, self.count_distinct(unseen).tolist(), strict=True))
        return [sum(map(self.memo.__getitem__, words)) for words in split]

    def count_all(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        chunk: list[str] = []
        held = 0
        for text in texts:
            text = (text or "").replace(" ", SPACE)
            chunk.append(SPACE + text if text and self.dummy_prefix else text)
            held += len(text)
            if held >= CHUNK_CHARS:
                out += self._count_chunk(chunk)
                chunk, held = [], 0
        return out + (self._count_chunk(chunk) if chunk else [])


def count_tokens(df: DataFrame, model: bytes, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Adds ``count``, the tokens of ``text``; ``model`` is the model file's content, broadcast to the workers.

    A column that has the name already is replaced; the others pass through.
    """
    small_batches(df.sparkSession)
    df = df.select(*[F.col(c) for c in df.columns if c != count])
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(count, T.LongType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in (p for b in batches for p in parts(b, text)):
            counts = pa.array(counter.count_all(batch.column(at).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, count])

    return mapped(df, run, schema)
