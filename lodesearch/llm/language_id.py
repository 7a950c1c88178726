"""The language of each document by bit-sliced Bloom filters of byte n-grams.

One array of slots serves all languages: bit l of a slot belongs to the filter of language l. An n-gram of a language sets the
language's bit in HASHES slots, and the bitwise AND of an n-gram's slots has the bits of all languages that (seem to) contain it. A
document's n-grams are looked up together, and each language's popcount over them, as a share of all n-grams, is corrected for its
filter's false positives: (share - f) / (1 - f) with f = fill ** HASHES. The language with the greatest corrected share wins.

The filters hold all n-grams of each language in a bounded sample of labelled documents, chosen by a hash of their ids: SAMPLE
documents a language, whole texts. The slots are as many as the largest language needs. Each 64 languages have a mask word of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_type, spread
from .textscan import U, memo, mix, pieces, text_bytes, word_table

GRAM = 4
HASHES = 3
#: Slots for each n-gram of the largest language, at least.
SLOTS_EACH = 8
SAMPLE = 1000
WORD = 64


def byte_grams(data: np.ndarray, off: np.ndarray, i: int, j: int):
    """Codes of the byte n-grams at each byte of documents i to j, which are of use, and each document's first and last + 1."""
    x = data[off[i] : off[j]]
    x = np.where(memo("word_table", word_table)[x], x, np.uint8(32))
    first, last = off[i:j] - off[i], np.maximum(off[i + 1 : j + 1] - off[i] - GRAM + 1, off[i:j] - off[i])
    n = max(0, len(x) - GRAM + 1)
    first, last = np.minimum(first, n), np.minimum(last, n)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, bool), first, last
    code = np.zeros(n, np.uint32)
    spaces = np.zeros(n, np.uint8)
    for k in range(GRAM):
        part = x[k : k + n]
        code = (code << np.uint32(8)) | part
        spaces += part == 32
    double = np.zeros(n, bool)
    for k in range(GRAM - 1):
        double |= (x[k : k + n] == 32) & (x[k + 1 : k + 1 + n] == 32)
    return code, ~double & (spaces < GRAM - 1), first, last


class Filters:
    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        kind = next((k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= n), np.uint64)
        self.mask = (1 << (SLOTS_EACH * max([1, *map(len, grams)])).bit_length()) - 1
        self.slots = np.zeros((max(1, -(-len(languages) // WORD)), self.mask + 1), kind)
        for k, g in enumerate(grams):
            for at in self.places(g):
                self.slots[k // WORD][at] |= kind(1 << k % WORD)
        fill = np.array([np.mean(self.slots[k // WORD] >> kind(k % WORD) & kind(1)) for k in range(len(languages))])
        self.false = fill**HASHES

    def places(self, code: np.ndarray):
        h = mix(code.astype(U))
        step = h >> U(32) | U(1)
        return [(h + U(k) * step & U(self.mask)).astype(np.int64) for k in range(HASHES)]

    def masks(self, code: np.ndarray) -> list[np.ndarray]:
        """For each 64 languages, the bits of those that contain each n-gram."""
        a, b, c = self.places(code)
        return [s[a] & s[b] & s[c] for s in self.slots]

    def shares(self, data, off, i, j) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each document, and corrected shares by document and language."""
        code, use, first, last = byte_grams(data, off, i, j)
        masks = self.masks(code)
        for m in masks:
            m[~use] = 0

        def total(x):
            s = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
            return s[last] - s[first]

        n = total(use)
        if not self.languages:
            return n, np.zeros((j - i, 0))
        one = self.slots.dtype.type(1)
        hits = np.stack([total(masks[k // WORD] >> self.slots.dtype.type(k % WORD) & one) for k in range(len(self.languages))], 1)
        return n, (hits / np.maximum(n, 1)[:, None] - self.false) / (1 - self.false)


def sampled_grams(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, gram): the n-grams of each language in its sample."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where("t is not null and lang is not null")
    counts = dict(own.groupBy("lang").count().collect())
    if not counts:
        return own.sparkSession.createDataFrame([], "lang string, gram long")
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, sample / n) * 1_000_000))))
    chosen = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < shares[F.col("lang")]).select("lang", "t")

    def count(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            data, off = text_bytes(b.column(1))
            for i, j in pieces(off, 1 << 22):
                code, use, first, last = byte_grams(data, off, i, j)
                for lang in set(langs[i:j]):
                    inside = np.zeros(len(code) + 1, np.int32)
                    pick = (langs[i:j] == lang) & (last > first)
                    np.add.at(inside, first[pick], 1)
                    np.add.at(inside, last[pick], -1)
                    g = np.unique(code[(np.cumsum(inside)[: len(code)] > 0) & use])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64))], ["lang", "gram"])

    return chosen.mapInArrow(count, "lang string, gram long").distinct()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from labelled documents; rows with a null language or text are left out. What reaches the driver are the distinct n-grams of the sample."""
    t = sampled_grams(docs, id_col, text_col, lang_col, sample).toArrow()
    lang, gram = t.column(0).combine_chunks().dictionary_encode(), t.column(1).to_numpy().astype(np.uint32)
    which, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
    languages = sorted(names)
    return Filters(languages, [np.sort(gram[which == names.index(k)]) for k in languages])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.0) -> DataFrame:
    """(doc_id, language, n_grams, share): one row for each row of docs.

    language is null for null texts, texts without n-grams, and where no language's corrected share is over least_share; of
    equal shares the first language by name wins. share is the winner's corrected share, null where language is. Ids keep their type, and rows that
    repeat are each judged. Texts of any length are read whole. An empty table gives an empty result. Other columns aren't read.
    """
    kind = id_type(docs, id_col)
    get = spread(docs.sparkSession, filters)

    def run(batches):
        own = get()
        names = np.array(own.languages, object)
        for b in batches:
            data, off = text_bytes(b.column(1))
            parts = [own.shares(data, off, i, j) for i, j in pieces(off)]
            if not parts:
                continue
            n, share = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(names):
                best = share.argmax(1)
                top = share[np.arange(len(n)), best]
            else:
                best, top = np.zeros(len(n), int), np.full(len(n), -1.0)
            none = (n == 0) | ~(top > least_share)
            language = pa.array([None if bad else names[k] for k, bad in zip(best, none, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), language, pa.array(n), pa.array(top, mask=none)], ["doc_id", "language", "n_grams", "share"])

    own = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("t"))
    return own.mapInArrow(run, f"doc_id {kind}, language string, n_grams long, share double")
