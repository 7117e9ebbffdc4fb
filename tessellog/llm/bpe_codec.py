"""Byte-level BPE encoding and decoding over a serialised sentencepiece model.

A rank file (one base64 token and its rank a line) becomes a sentencepiece BPE
model without any training: each byte is one character of a 256-character
alphabet, each token the string of its bytes' characters, scored by its negative
rank, under an identity normaliser.  Text is split by the vocabulary's pattern;
every pre-token is encoded by itself and a pre-token that is itself a token is
taken whole, as the public byte-level encoders do.  Decoding is the inverse
mapping from ids to bytes.

Nulls and empty texts encode to no tokens.  Rows are independent: repeated rows,
ties and extra columns pass through unchanged, but for a column that has the
result's name, which the result replaces.  A very long text is encoded whole, by its distinct
pre-tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, parts, small_batches

#: Characters that stand for bytes 0 to 255; none of them has a meaning to sentencepiece.
ALPHABET = [chr(0x100 + b) for b in range(256)]
#: Pre-tokens, and characters of them, whose ids a worker remembers; beyond either, it forgets them all and goes on.
MEMO_ENTRIES, MEMO_CHARS = 100_000, 4_000_000
#: Characters of text that are split and encoded at a time; a longer text is a chunk of its own.
CHUNK_CHARS = 1_000_000


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank, from the lines of a rank file."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto; id 0 is the unknown piece, id r + 1 the token of rank r."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _flag(3, kind))

    out = [piece("<unk>", 0.0, 2)]
    out += [piece("".join(ALPHABET[b] for b in token), float(-rank), 1) for rank, token in enumerate(tokens)]
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1) + _flag(41, 0xFFFFFFFFFFFFFFFF) + _flag(42, 0xFFFFFFFFFFFFFFFF)
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary, in one process."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(rank_file)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.whole = {token: struct.pack("<I", rank) for rank, token in enumerate(self.tokens)}
        self.to_alphabet = dict(enumerate(ALPHABET))
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def encode_chunk(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(text) for text in texts]
        if len(self.memo) > MEMO_ENTRIES or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        memo, unseen = self.memo, []
        for word in set().union(*split):
            if word not in memo:
                self.held += len(word)
                raw = word.encode()
                if raw in self.whole:
                    memo[word] = self.whole[raw]
                else:
                    unseen.append((word, raw.decode("latin-1").translate(self.to_alphabet)))
        if unseen:
            for (word, _), ids in zip(unseen, self.model.encode([x for _, x in unseen], num_threads=1), strict=True):
                memo[word] = (np.array(ids, dtype="<u4") - 1).astype("<u4").tobytes()
        return [b"".join(map(memo.__getitem__, words)) for words in split]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        chunk: list[str] = []
        held = 0
        for text in texts:
            chunk.append(text or "")
            held += len(chunk[-1])
            if held >= CHUNK_CHARS:
                out += self.encode_chunk(chunk)
                chunk, held = [], 0
        return out + (self.encode_chunk(chunk) if chunk else [])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _with_column(df: DataFrame, source: str, target: str, make, work) -> DataFrame:
    """``df`` with binary column ``target``, which ``work(make(), values)`` gives for a list of ``source``'s values.

    A column that has the name already is replaced.
    """
    small_batches(df.sparkSession)
    df = df.select(*[F.col(c) for c in df.columns if c != target])
    at = df.columns.index(source)
    schema = T.StructType([*df.schema.fields, T.StructField(target, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = make()
        for batch in (p for b in batches for p in parts(b, source)):
            values = pa.array(work(tool, batch.column(at).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, target])

    return mapped(df, run, schema)


def encode(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds ``ids``: the tokens of ``text`` as packed little-endian unsigned 32-bit integers.

    ``rank_file`` is the file's content: the driver reads it once and each worker
    gets it by broadcast, so its size is that of the vocabulary.
    """
    shared = df.sparkSession.sparkContext.broadcast((rank_file, pattern))
    return _with_column(df, text, ids, lambda: ByteBpe(*shared.value), ByteBpe.encode_all)


def decode(df: DataFrame, rank_file: bytes, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the bytes that ``ids`` stand for (null: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(rank_file)

    def work(tokens: list[bytes], values: list[bytes | None]) -> list[bytes]:
        return [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in values]

    return _with_column(df, ids, decoded, lambda: read_ranks(shared.value), work)


def round_trip(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds what ``encode`` and then ``decode`` add, by one worker for each task."""
    small_batches(df.sparkSession)
    df = df.select(*[F.col(c) for c in df.columns if c not in (ids, decoded)])
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])
    shared = df.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe(*shared.value)
        for batch in (p for b in batches for p in parts(b, text)):
            encoded = codec.encode_all(batch.column(at).to_pylist())
            back = [codec.decode(x) for x in encoded]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoded, pa.binary()), pa.array(back, pa.binary())], names=[*batch.schema.names, ids, decoded])

    return mapped(df, run, schema)
