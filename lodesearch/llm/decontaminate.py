"""Benchmark items found in training documents, also when edited.

Seeds are runs of `gram` words of an item. Their document counts over all documents say how rare they are: a seed is used if
at most RARE of the documents have it, or at most twice as many as have the item's median seed, so an item that leaked into
many documents still has seeds, those that its edited copies kept among them.
Documents are joined to items on seeds, and the passage around the seeds is aligned with the item by
Smith-Waterman over words (match 2, mismatch -1, gap -1). The score is divided by that of a perfect match.

An item of fewer words than `gram` has one seed, the whole of it.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .shared import id_type, materialise, sized, spread
from .textscan import U, find_words, gram_hashes, in_sorted, pieces, text_bytes

GRAM = 3
THRESHOLD = 0.5
RARE = 0.001
ITEM_WORDS = 1 << 20


def item_words(ids, texts) -> dict[int, list[np.ndarray]]:
    """Word hashes of each item's texts; items without words are left out."""
    data, off = text_bytes(pa.array(texts, pa.string()))
    out: dict[int, list[np.ndarray]] = {}
    for i, j in pieces(off):
        _, _, doc, h = find_words(data, off, i, j)
        for d in np.unique(doc):
            out.setdefault(ids[d], []).append(h[doc == d])
    return out


def grams_of(h: np.ndarray, doc: np.ndarray, n: int):
    at, g = gram_hashes(h, doc, n)
    return at, g + U(n)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment of two word sequences: match 2, mismatch -1, gap -1."""
    k = np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        up = np.zeros(len(b) + 1, np.int64)
        up[1:] = np.maximum(row[:-1] + np.where(b == x, 2, -1), row[1:] - 1)
        np.maximum(up, 0, out=up)
        row = np.maximum.accumulate(up + k) - k
        best = max(best, int(row.max()))
    return best


class Seeds:
    """Items of one pass: words, seeds and where the seeds are in the items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], gram: int):
        self.items, self.gram = items, gram
        key, item, at = [], [], []
        for k, (_, h) in enumerate(items):
            p, g = grams_of(h, np.zeros(len(h), np.int64), min(gram, len(h)))
            key.append(g)
            item.append(np.full(len(g), k))
            at.append(p)
        key, item, at = np.concatenate(key), np.concatenate(item), np.concatenate(at)
        o = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[o], item[o], at[o]
        self.distinct = np.unique(self.key)
        self.sizes = sorted({min(gram, len(h)) for _, h in items})

    def rarer(self, found: np.ndarray, n_docs: int) -> Seeds:
        """With the rare seeds of each item only. found: documents for each distinct seed, of n_docs."""
        n = found[np.searchsorted(self.distinct, self.key)]
        keep = np.zeros(len(n), bool)
        by_item = np.argsort(self.item, kind="stable")
        for own in np.split(by_item, np.flatnonzero(np.diff(self.item[by_item])) + 1):
            keep[own] = n[own] <= max(2 * np.median(n[own]), RARE * n_docs)
        out = object.__new__(Seeds)
        out.items, out.gram, out.sizes = self.items, self.gram, self.sizes
        out.key, out.item, out.at = self.key[keep], self.item[keep], self.at[keep]
        out.distinct = np.unique(out.key)
        return out

    def documents(self, h, doc) -> np.ndarray:
        """How many of the documents have each distinct seed."""
        n = np.zeros(len(self.distinct), np.int64)
        for size in self.sizes:
            at, g = grams_of(h, doc, size)
            ok, place = in_sorted(self.distinct, g)
            pair = np.unique(doc[at[ok]] * len(n) + place[ok])
            n += np.bincount(pair % len(n), minlength=len(n))
        return n

    def aligned(self, h, doc):
        """Yields (document, item, score) for each document and item with a common seed."""
        hits = []
        for size in self.sizes:
            at, g = grams_of(h, doc, size)
            lo, hi = np.searchsorted(self.key, g), np.searchsorted(self.key, g, "right")
            some = np.flatnonzero(hi > lo)
            n = (hi - lo)[some]
            k = np.repeat(lo[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            hits.append((np.repeat(at[some], n), self.item[k], self.at[k]))
        p, item, q = (np.concatenate(x) for x in zip(*hits, strict=True))
        o = np.lexsort((p, item, doc[p]))
        p, item, q = p[o], item[o], q[o]
        d = doc[p]
        words = np.array([len(x) for _, x in self.items])
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1])
        far = np.ones(len(p), bool)
        far[1:] = new[1:] | (p[1:] - p[:-1] > 2 * words[item[1:]])
        cut = np.append(np.flatnonzero(far), len(p))
        best: dict[tuple[int, int], int] = {}
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            m = words[item[a]]
            slack = m // 4 + 2
            lo = max(int((p[a:b] - q[a:b]).min()) - slack, int(np.searchsorted(doc, d[a])))
            hi = min(int((p[a:b] - q[a:b]).max()) + m + slack, int(np.searchsorted(doc, d[a], "right")))
            key = (int(d[a]), int(item[a]))
            best[key] = max(best.get(key, 0), smith_waterman(self.items[item[a]][1], h[lo:hi]))
        for (k, i), score in best.items():
            yield k, self.items[i][0], score / (2 * words[i])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, item_words_a_pass: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, score): documents that hold an item, or an edited copy, with a score of at least the threshold.

    Items with a null id or text, or without words, and documents with a null id or text match nothing. Several texts of
    one item_id, or rows of one doc_id, give one row with the best score. Ids of documents and items keep their types. Texts of any length are read
    whole. Empty tables give an empty result. Other columns aren't read. Items are broadcast in portions of item_words_a_pass words,
    which the driver holds one at a time; a larger benchmark takes more passes over the documents, and each pass's rows are written to the shared folder.
    """
    spark = docs.sparkSession
    kinds = id_type(docs, id_col), id_type(benchmark, item_id)
    texts = docs.select(F.col(id_col).cast(kinds[0]).alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    items = benchmark.select(F.col(item_id).cast(kinds[1]).alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    out = spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, score double")
    own: list[tuple[Any, np.ndarray]] = []
    size, passes = 0, 0
    for k, texts_of in _by_item(items):
        for h in texts_of:
            if own and size + len(h) > item_words_a_pass:
                out = out.unionAll(materialise(_pass(texts, Seeds(own, gram), threshold, kinds), "pass"))
                own, size, passes = [], 0, passes + 1
            own.append((k, h))
            size += len(h)
    if own:
        last = _pass(texts, Seeds(own, gram), threshold, kinds)
        out = out.unionAll(materialise(last, "pass") if passes else last)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _by_item(items: DataFrame):
    """(item, word hashes of its texts), a bounded part of the table at a time."""
    ids, texts = [], []
    for row in items.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        if len(ids) == 10_000:
            yield from item_words(ids, texts).items()
            ids, texts = [], []
    yield from item_words(ids, texts).items()


def _pass(texts: DataFrame, seeds: Seeds, threshold: float, kinds: tuple[str, str]) -> DataFrame:
    spark = texts.sparkSession
    all_seeds = spread(spark, seeds)

    def counted(batches):
        seeds = all_seeds()
        n, rows = np.zeros(len(seeds.distinct), np.int64), 0
        for b in batches:
            rows += b.num_rows
            data, off = text_bytes(b.column(0))
            for i, j in pieces(off):
                _, _, doc, h = find_words(data, off, i, j)
                n += seeds.documents(h, doc)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, len(n))), pa.array(np.append(n[k], rows))], ["k", "n"])

    found = np.zeros(len(seeds.distinct) + 1, np.int64)  # the last for all documents
    for k, n in texts.select("t").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        found[k] = n
    item_kind = to_arrow_type(StructType.fromDDL(f"i {kinds[1]}")[0].dataType)
    rare = spread(spark, seeds.rarer(found[:-1], int(found[-1])))

    def scored(batches):
        seeds = rare()
        for b in batches:
            data, off = text_bytes(b.column(1))
            for i, j in pieces(off):
                _, _, doc, h = find_words(data, off, i, j)
                rows = [x for x in seeds.aligned(h, doc) if x[2] >= threshold]
                if rows:
                    d, item, score = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(item, item_kind), pa.array(score, pa.float64())], ["doc_id", "item_id", "score"])

    return texts.mapInArrow(scored, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were; rows with a null id stay."""
    found = materialise(contaminated(docs, benchmark, id_col, **options).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(sized(found, found.count(), 16), id_col, "left_anti").select(*docs.columns)
