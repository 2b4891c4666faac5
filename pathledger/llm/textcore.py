"""Vectorised text primitives on Arrow string columns: words, rolling hashes and grams over raw UTF-8 bytes.

Everything works on chunks of whole documents of about CHUNK bytes (one longer document is a chunk of its own),
so memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_RNG = np.random.default_rng(20240607)
TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
PLACES = _RNG.integers(0, 2**64, 64 * 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), or of its inverse, modulo 2**64; grown by doubling and kept."""
    key = "i" if inverse else "p"
    have = _pow.get(key, np.ones(1, np.uint64))
    root = pow(BASE, -1, 2**64) if inverse else BASE
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(root, len(have), 2**64))])
    _pow[key] = have if len(have) <= 4 * CHUNK else have[: 4 * CHUNK]
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole documents."""
    data, offs = views(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of maximal runs of member bytes; a run never crosses a document."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of each word, A-Z lower-cased if asked. Equal words have equal 64-bit hashes.

    Tabulation: a sum of random numbers, one for each byte and place in the word. Unlike a polynomial modulo 2**64
    it has no structure that a repetitive word could meet.
    """
    starts, ends, doc = word_bounds(data, offs, member)
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64), doc, starts, ends
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    low = data[place + np.repeat(starts, size)]
    low = LOWER[low] if lower else low
    value = PLACES[(place & 63) << 8 | low]
    if size.max() > 64:
        value *= mix((place >> 6).astype(np.uint64) * GRAM[50]) | U(1)
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64)), doc, starts, ends


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of n words within a document."""
    if len(h) < n:
        return h[:0], doc[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * GRAM[i]
    keep = doc[: len(out)] == doc[n - 1 :]
    return mix(out[keep]), doc[: len(out)][keep]


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes that start at each position (n a power of two, by doubling)."""
    h, step = TABLE[data], 1
    while step < n:
        h = h[:-step] * U(pow(BASE, step, 2**64)) + h[step:] if len(h) > step else h[:0]
        step *= 2
    return mix(h)


def order_free(h: np.ndarray, bounds: np.ndarray, salt: int = 0) -> np.ndarray:
    """Sum of mixed hashes between bounds: a fingerprint of each set; another salt gives an independent one."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ U((0x9E3779B97F4A7C15 + salt * 0xA24BAED4963EE407) & (2**64 - 1))), out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + (bounds[1:] - bounds[:-1]).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
