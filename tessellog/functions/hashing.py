"""Content addresses of operations, in two hash profiles.

``sha256`` runs inside the JVM as well (see ``node_id_column``); ``blake3`` is pure
Python from the published BLAKE3 specification, with its chunk tree for inputs over
1,024 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the BLAKE3 specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turn(x: int, n: int) -> int:
    return (x >> n | x << 32 - n) & _MASK


def _compress(chain: tuple, block: bytes, counter: int, length: int, flags: int) -> tuple:
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, length, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for word, right, left in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & _MASK
                v[d] = _turn(v[d] ^ v[a], right)
                v[c] = (v[c] + v[d]) & _MASK
                v[b] = _turn(v[b] ^ v[c], left)
        m = [m[i] for i in _ORDER]
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def _words(chain: tuple) -> bytes:
    return b"".join(x.to_bytes(4, "little") for x in chain)


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 digest."""

    def chunk(piece: bytes, number: int, root: int) -> tuple:
        blocks = [piece[i : i + 64] for i in range(0, len(piece), 64)] or [b""]
        chain = _IV
        for i, block in enumerate(blocks):
            flags = (_CHUNK_START if i == 0 else 0) | ((_CHUNK_END | root) if i == len(blocks) - 1 else 0)
            chain = _compress(chain, block.ljust(64, b"\0"), number, len(block), flags)
        return chain

    def tree(lo: int, hi: int, root: int) -> tuple:
        if hi - lo == 1:
            return chunk(data[lo * 1024 : hi * 1024], lo, root)
        middle = lo + (1 << (hi - lo - 1).bit_length() - 1)
        return _compress(_IV, _words(tree(lo, middle, 0)) + _words(tree(middle, hi, 0)), 0, 64, _PARENT | root)

    return _words(tree(0, max(1, -(-len(data) // 1024)), _ROOT))


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


PROFILES: dict[str, Callable[[bytes], bytes]] = {"sha256": sha256, "blake3": blake3}


def preimage(op: str, anchor: bytes | None, ch: str | None, extra: Iterable[bytes], targets: Iterable[bytes]) -> bytes:
    """The bytes whose hash names an operation; id sets go in ascending order, once each."""
    head = b"extra_deps" + b"".join(b"$" + d for d in sorted(set(extra))) + b"op"
    if op == "remove":
        body = b"remove" + b"".join(sorted(set(targets)))
    else:
        body = op.encode() + (anchor + b"$" if op != "root" else b"") + ord(ch).to_bytes(4, "little")
    return head + body + b"done"


def code_point(ch: Column) -> Column:
    """A character's code point as eight hex digits, little-endian."""
    big = F.lpad(F.hex(F.ascii(ch)), 8, "0")
    return F.lower(F.concat(F.substring(big, 7, 2), F.substring(big, 5, 2), F.substring(big, 3, 2), F.substring(big, 1, 2)))


def _ascii(text: str) -> Column:
    return F.lit(text.encode().hex())


def node_id_column(op: Column, anchor: Column, ch: Column, extra: Column, targets: Column) -> Column:
    """The SHA-256 id (lower hex) from columns of hex ids, without leaving the JVM."""
    ordered = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    deps = F.array_join(F.transform(ordered(extra), lambda d: F.concat(_ascii("$"), d)), "")
    insert = F.concat(anchor, _ascii("$"), code_point(ch))
    body = (
        F.when(op == "root", F.concat(_ascii("root"), code_point(ch)))
        .when(op == "after", F.concat(_ascii("after"), insert))
        .when(op == "before", F.concat(_ascii("before"), insert))
        .otherwise(F.concat(_ascii("remove"), F.array_join(ordered(targets), "")))
    )
    return F.sha2(F.unhex(F.concat(_ascii("extra_deps"), deps, _ascii("op"), body, _ascii("done"))), 256)


def chain_tip(head: Column, text: Column) -> Column:
    """The id at the end of a run: each character of ``text`` inserted after the one before, from ``head`` on."""
    step = lambda previous, c: F.sha2(F.unhex(F.concat(_ascii("extra_depsopafter"), previous, _ascii("$"), code_point(c), _ascii("done"))), 256)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), head, step)
