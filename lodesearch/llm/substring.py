"""Passages that repeat within or across documents, by a count-min prefilter and exact grouping.

A window is `window` consecutive words (case and punctuation ignored). Within each window the least hash of its
`gram`-word runs is its anchor: equal windows have equal anchors, and neighbouring windows mostly share one, so
that only about one word in (window - gram + 2) / 2 is an anchor.

Pass 1: each partition counts its anchors in a count-min sketch of two rows, the sketches are merged by adding,
and the cells of at least 2 are kept as bits. A cell never undercounts, so an anchor that occurs twice has both
its bits set. Pass 2: windows whose anchor has both bits go on, and exactly these are grouped by
their hash of 128 bits (two polynomials of the words' hashes with different bases; at 100 TB, some 1e13 windows, the chance that any two different ones
share it is below 1e-11, so texts aren't compared). Windows that do repeat are never lost; a full sketch only lets more windows reach the grouping.
The sketch has about four cells an anchor up to `sketch_bytes`, which bounds what is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import task_count, with_long_ids
from .textscan import SECOND_BASE, U, find_words, gram_hashes, mix, pieces, text_bytes

WINDOW = 50
GRAM = 25
SKETCH_BYTES = 128 << 20
BLOCK = 1 << 16
ROWS = 2


def sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n] for each i with n elements."""
    if len(x) < n:
        return x[:0]
    have, out = 1, x
    while have * 2 <= n:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < n:
        out = op(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1])
    return out


def windows_of(h: np.ndarray, doc: np.ndarray, window: int, gram: int):
    """First word, hash and anchor of each window, and the hashes of the anchors, each place once."""
    at, whole = gram_hashes(h, doc, window)
    if len(at) == 0:
        return at, whole, whole, whole
    g_at, g = gram_hashes(h, doc, gram)
    grams = np.full(len(h), U(0xFFFFFFFFFFFFFFFF))
    grams[g_at] = g
    t = window - gram + 1
    least = sliding(grams, t, np.minimum)[at]
    # a gram is an anchor if it is the least of any window over it
    most = np.zeros(len(h) + 2 * (t - 1), U)
    most[at + t - 1] = least
    chosen = (sliding(most, t, np.maximum)[: len(h)] == grams) & (grams != U(0xFFFFFFFFFFFFFFFF))
    return at, whole, least, grams[chosen]


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((anchor >> U(30 * row)) & U((1 << bits) - 1)).astype(np.int64)


def sketch_bits(n_bytes: int, sketch_bytes: int) -> int:
    """log2 of a row's cells, for texts of so many bytes."""
    return int(min(max(n_bytes // 20, BLOCK), max(BLOCK, sketch_bytes * 8 // ROWS))).bit_length()


def repeated_cells(texts: DataFrame, bits: int, window: int, gram: int) -> DataFrame:
    """(block, bits): for each block of cells, which have counts of at least 2. Blocks without any are left out."""
    blocks = 1 << (bits - 16)

    def counted(anchors):
        for row in range(ROWS):
            cell, n = np.unique(cells(np.concatenate(anchors), row, bits), return_counts=True)
            cut = np.searchsorted(cell, np.arange(blocks + 1) * BLOCK)
            used = np.flatnonzero(cut[1:] > cut[:-1])
            low, many = (cell % BLOCK).astype(np.uint16), n > 1
            once, twice = [], []
            for b in used:
                part = slice(cut[b], cut[b + 1])
                once.append(low[part][~many[part]].tobytes())
                twice.append(low[part][many[part]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used + row * blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])

    def sketch(batches):
        anchors, n = [], 0
        for b in batches:
            data, off = text_bytes(b.column(0))
            for i, j in pieces(off):
                _, _, doc, h = find_words(data, off, i, j)
                anchors.append(windows_of(h, doc, window, gram)[3])
                n += len(anchors[-1])
            if n > 1 << 22:
                yield from counted(anchors)
                anchors, n = [], 0
        if n:
            yield from counted(anchors)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, once, twice in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                a = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                for x, add in ((once, 1), (twice, 2)):
                    at = np.frombuffer(x, np.uint16)
                    a[at] = np.minimum(a[at] + add, 2)
        out = {k: np.packbits(a >= 2).tobytes() for k, a in sums.items() if (a >= 2).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["block", "bits"])

    return texts.select("t").mapInArrow(sketch, "block long, once binary, twice binary").repartition("block").mapInArrow(merge, "block long, bits binary")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """(doc_id, start_word, n_words, n_windows, n_later): the passages of repeated windows, overlapping windows as one.

    start_word counts the document's words from 0. n_windows repeated windows start in the passage; n_later of them
    have an equal one before, by doc_id and place, so that a passage with n_later = n_windows holds nothing new.
    Rows with a null id or text, and texts of fewer words than the window, give none. Rows that repeat an id are
    each read as a text of its own, whose passages are merged under the one id. Ids may be of any type that has an order. Texts of any
    length are read whole. Other columns aren't read. An empty table gives an empty result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    return with_long_ids(docs.select(id_col, text_col), id_col, lambda own: _repeated_passages(own, id_col, text_col, window, gram, sketch_bytes), ["doc_id"])


def _repeated_passages(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, sketch_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    n_bytes = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = sketch_bits(n_bytes, sketch_bytes)
    size = 1 << bits
    flags = np.zeros((ROWS, size // 8), np.uint8)
    for block, part in repeated_cells(texts, bits, window, gram).toLocalIterator():
        row, k = divmod(block, size // BLOCK)
        flags[row, k * BLOCK // 8 : (k + 1) * BLOCK // 8] = np.frombuffer(part, np.uint8)
    sketch = spark.sparkContext.broadcast(flags)

    def estimated(batches):
        flags = sketch.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, off = text_bytes(b.column(1))
            out = []
            for i, j in pieces(off):
                _, _, doc, h = find_words(data, off, i, j)
                at, whole, anchor, _ = windows_of(h, doc, window, gram)
                kept = np.arange(len(at))
                for row in range(ROWS):
                    c = cells(anchor[kept], row, bits)
                    kept = kept[(flags[row, c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)]
                at, whole = at[kept], whole[kept]
                first = np.searchsorted(doc, doc[at])
                _, second = gram_hashes(mix(h), doc, window, SECOND_BASE)
                out.append((whole.view(np.int64), second[kept].view(np.int64), ids[doc[at]], (at - first).astype(np.int32)))
            if out:
                w, x, d, p = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(x), pa.array(d, pa.int64()), pa.array(p)], ["w", "x", "id", "p"])

    def whole_partition(batches):
        got = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(got) if got else None

    def grouped(batches):
        if (t := whole_partition(batches)) is None:
            return
        w, x, d, p = (t.column(k).to_numpy() for k in range(4))
        o = np.lexsort((p, d, x, w))
        w, x = w[o], x[o]
        later = np.zeros(len(w), bool)
        later[1:] = (w[1:] == w[:-1]) & (x[1:] == x[:-1])
        repeated = later.copy()
        repeated[:-1] |= later[1:]
        o, later = o[repeated], later[repeated]
        yield pa.RecordBatch.from_arrays([pa.array(d[o]), pa.array(p[o]), pa.array(later)], ["id", "p", "later"])

    def merged(batches):
        if (t := whole_partition(batches)) is None:
            return
        d, p, later = (t.column(k).to_numpy() for k in range(3))
        o = np.lexsort((p, d))
        d, p, later = d[o], p[o].astype(np.int64), later[o]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + window)
        cut = np.flatnonzero(first)
        last = np.append(cut[1:], len(d)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(p[cut]), pa.array(p[last] + window - p[cut]), pa.array(last - cut + 1), pa.array(np.add.reduceat(later.astype(np.int64), cut))], ["doc_id", "start_word", "n_words", "n_windows", "n_later"])

    tasks = task_count(spark, n_bytes // 24, 500_000)
    return (
        texts.mapInArrow(estimated, "w long, x long, id long, p int")
        .repartition(tasks, "w")
        .mapInArrow(grouped, "id long, p int, later boolean")
        .repartition(tasks, "id")
        .mapInArrow(merged, "doc_id long, start_word long, n_words long, n_windows long, n_later long")
    )
