"""Vectorised scanning of Arrow text columns.

A column is seen as one byte array with document offsets. Words are maximal runs of ASCII letters,
digits and non-ASCII characters. They are identified by 64-bit hashes: the sum of random-looking numbers of each eight bytes at
their place in the word, mixed, so that hashing all words of a megabyte takes a few array operations and no Python loop. (A polynomial modulo
2**64 gives some different words of 1024 letters one hash, whatever its base.) Two given words share a hash with a chance of 2**-64.

Runs of a few words, and short substrings, have polynomial hashes, as they are taken at every place.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD6E8FEB86659FD93
SECOND_BASE = 0xA0761D6478BD642F


def memo(key, make):
    """A value kept for the life of the Python process, not of the task."""
    store = sys.modules.setdefault("_text_scan_memo", types.ModuleType("_text_scan_memo")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base must be odd."""
    size = 1 << max(20, int(n).bit_length())

    def make():
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size + 1, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return tuple(out)

    if size > 1 << 24:
        return make()
    return memo((base, size), make)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def word_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def text_bytes(col, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    buffers = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = 1 << 19):
    """Ranges of whole documents with at most limit bytes, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(x: np.ndarray, base: int) -> np.ndarray:
    p, _ = powers(base, len(x))
    out = np.zeros(len(x) + 1, U)
    np.cumsum(x.astype(U, copy=False) * p[: len(x)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    _, inverse = powers(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def run_hashes(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs from start to end of bytes or code points, eight bytes at a time."""
    if not len(start):
        return np.zeros(0, U)
    wide = x.dtype.itemsize
    size = (end - start) * wide
    buffer = np.zeros(len(x) * wide + 8, np.uint8)
    buffer[:-8] = x.view(np.uint8)
    eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    n = (size + 7) >> 3
    if n.max() == 1:
        at, k, left = start * wide, np.zeros(1, np.int64), size
    else:
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        at, left = np.repeat(start * wide, n) + 8 * k, np.repeat(size, n) - 8 * k
    part = eights[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - (np.minimum(left, 8) << 3).astype(U)))
    value = mix(part ^ mix(k.astype(U) + U(1)))
    total = value if n.max() == 1 else np.add.reduceat(value, first)
    return mix(total + size.astype(U) * U(BASE))


def space_table() -> np.ndarray:
    t = np.ones(256, bool)
    t[9:14] = t[32] = False
    return t


def find_words(data: np.ndarray, off: np.ndarray, i: int, j: int, spaced: bool = False):
    """Of documents i to j: start and end bytes, document and hash of each word, in order.

    spaced: words are runs of anything but ASCII white space.
    """
    x = data[off[i] : off[j]]
    first = off[i:j] - off[i]
    n = len(x)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, U)
    inside = (memo("space_table", space_table) if spaced else memo("word_table", word_table))[x]
    border = np.zeros(n + 1, bool)
    border[first[first < n]] = True
    border[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    doc = np.searchsorted(first, start, "right") - 1 + i
    return start + off[i], end + off[i], doc, run_hashes(x, start, end)


def gram_hashes(h: np.ndarray, doc: np.ndarray, n: int, base: int = WINDOW_BASE) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of n words within a document."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    p = prefix_hash(h, base)
    at = np.arange(len(h) - n + 1)
    at = at[doc[at] == doc[at + n - 1]]
    return at, span_hash(p, at, at + n, base)


def in_sorted(keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each probe is in the sorted keys, and its first place there."""
    at = np.searchsorted(keys, probe)
    if len(keys) == 0:
        return np.zeros(len(probe), bool), at
    return keys[np.minimum(at, len(keys) - 1)] == probe, at


def take_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given byte ranges as a string array."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data[at])]).cast(pa.string())


def distinct_words(data: np.ndarray, off: np.ndarray, i: int, j: int):
    """Of documents i to j, white space between words: (hash of each distinct word in order of hash, a start and an end of it, its count), and
    each word's document and the index of its distinct word."""
    parts = [find_words(data, off, a + i, b + i, spaced=True) for a, b in pieces(off[i : j + 1])]
    start, end, doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return keys, start[first], end[first], n, doc, which
