"""Numpy kernels over the UTF-8 bytes of many texts at once.

Every kernel works on a block: one uint8 buffer that holds whole texts back to
back, and int64 offsets that bound them. Nulls count as empty texts. Hashes are
64-bit polynomials modulo 2**64 over random byte codes, finished by a mixer, so
equal byte strings get equal hashes at any place in any block or task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 20
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODES_LOWER = _CODES[_LOWER]

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        seed = np.full(size, base, np.uint64)
        seed[0] = 1
        have = _powers[base] = np.multiply.accumulate(seed)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = np.array(x, np.uint64)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + at)[at:] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) of runs of whole texts of about `most` bytes."""
    buf, off = utf8(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_sums(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """S such that (S[b] - S[a]) * M**a depends on the bytes a..b alone."""
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_CODES_LOWER if lower else _CODES)[buf] * powers(_M_INV, len(buf)), out=s[1:])
    return s


def range_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges a..b of the block that prefix_sums() got."""
    return mix((s[b] - s[a]) * powers(_M, len(s))[a] + (b - a).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes in `table`, never across texts."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = False
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off[1:], starts, "right")


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends and text numbers of the words of a block."""
    a, b, doc = spans(buf, off, table)
    return range_hashes(prefix_sums(buf, lower), a, b), a, b, doc


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that begin at each word; the caller checks that a window stays in its text."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * U(pow(_M, 2 * i + 3, 1 << 64))
    return mix(out)
