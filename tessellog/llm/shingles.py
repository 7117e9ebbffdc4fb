"""Word-shingle sets of texts, as 64-bit hashes in numpy arrays.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, after A-Z are
lower-cased.  A set holds a text's distinct shingles of k consecutive words; a text
of fewer words has one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # 5 mod 8: its powers have the longest period
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Multipliers of the minwise functions.
_FUNCTIONS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and of each the number of its text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    hashes = _mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners): the distinct shingles of each text, sorted by text and hash."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=np.int64)
    found, owners = [], []
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(texts) else np.zeros(0, dtype=np.int64)
    for n in range(1, k + 1):
        at = np.flatnonzero(owner[: max(0, len(owner) - k + 1)] == owner[k - 1 :]) if n == k else first[counts == n]
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + words[at + j])
        found.append(h)
        owners.append(owner[at])
    h, o = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[fresh], o[fresh]


def sizes(owners: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owners, minlength=n).astype(np.int64) if len(owners) else np.zeros(n, dtype=np.int64)


def fingerprints(hashes: np.ndarray, owners: np.ndarray, n: int) -> list[bytes]:
    """128 bits of each set: two sums, over differently mixed members."""
    out = np.zeros((n, 2), dtype=np.uint64)
    if len(hashes):
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        for c, salt in enumerate((0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)):
            out[owners[starts], c] = np.add.reduceat(_mix(hashes ^ np.uint64(salt)), starts)
    return [row.tobytes() for row in out]


def minima(hashes: np.ndarray, owners: np.ndarray, n: int, functions: int) -> np.ndarray:
    """Minwise values, 32 bits each, one row for each text (zeros for an empty set)."""
    out = np.zeros((n, functions), dtype=np.uint32)
    if len(hashes):
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        for f in range(functions):
            low = np.minimum.reduceat(hashes * _FUNCTIONS[f], starts)
            out[owners[starts], f] = (_mix(low) >> np.uint64(32)).astype(np.uint32)
    return out


def common(a: list[str | None], b: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of texts: the sizes of both sets and of their intersection."""
    n = len(a)
    ha, oa = sets(a, k)
    hb, ob = sets(b, k)
    h, o = np.concatenate([ha, hb]), np.concatenate([oa, ob])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    twice = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return sizes(oa, n), sizes(ob, n), sizes(o[1:][twice], n)
