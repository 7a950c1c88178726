"""Numbers of tokens by document, without token ids.

Texts are split into pre-tokens (as the byte-level BPE's pattern does, but by array operations). Each document's
pre-token frequencies are joined to a table of the number of pieces of each distinct pre-token, where every distinct pre-token is
encoded once, and summed.

The join has two ways. The most frequent pre-tokens of a share of the documents, at most `hot`, make a table
that is broadcast; frequencies of all others are shuffled by pre-token, and each task encodes its own distinct ones. Which pre-tokens are
broadcast changes no result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_type, spread, task_count
from .textscan import U, in_sorted, memo, pieces, run_hashes, text_bytes

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HOT = 200_000
SAMPLE = 0.02
SAMPLE_LEAST = 1000
PART = 4 << 20
#: Where nothing is shuffled, smaller parts cost no rows.
SMALL_PART = 1 << 20
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)


def kinds() -> np.ndarray:
    import unicodedata

    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[WHITE] = SPACE
    return t


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; cp are code points and first the places where texts begin."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = memo("unicode_kinds", kinds)[cp]
    text = np.zeros(n + 1, bool)
    text[first] = True
    text[n] = True
    begin = text[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    ends = np.empty(n, bool)  # last character of its run
    ends[:-1] = begin[1:]
    ends[-1] = True
    # the last white space before something else in the same text stands alone, or with what follows if it is a blank
    last = np.flatnonzero((kind == SPACE) & ends & ~text[1:])
    begin[last] = True
    blank = last[cp[last] == 32]
    begin[blank + 1] = False
    # 's and the like: an apostrophe alone in its run, with letters after it and no blank that belongs to it
    quote = np.flatnonzero((cp == 39) & begin[:n] & ends & ~text[1:])
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == LETTER]
    one = cp[quote + 1]
    two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
    two[text[np.minimum(quote + 2, n)]] = 0
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    quote, size = quote[size > 0], size[size > 0]
    begin[quote + 1] = False
    after = quote + 1 + size
    begin[after[after < n]] = True
    return np.flatnonzero(begin)


def split(data: np.ndarray, off: np.ndarray, i: int, j: int):
    """Pre-tokens of texts i to j: (code points, start, end, text, hash)."""
    raw = data[off[i] : off[j]]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    first = lead[off[i:j] - off[i]]
    start = token_starts(cp, np.unique(first[first < len(cp)]))
    end = np.append(start, len(cp))[1:]
    text = np.searchsorted(first, start, "right") - 1 + i
    return cp, start, end, text, run_hashes(cp, start, end)


def strings(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = cp.tobytes()
    return [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def frequencies(data, off, part: int = PART):
    """Parts of the texts: (distinct hashes, one pre-token's string for some of them, texts, index of the distinct, frequency)."""
    for i, j in pieces(off, part):
        hashes, where, texts = [], [], []
        for a, b in pieces(off[i : j + 1]):
            cp, start, end, text, h = split(data, off, a + i, b + i)
            hashes.append(h)
            texts.append(text)
            where.append((cp, start, end))
        h, text = np.concatenate(hashes), np.concatenate(texts)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        sizes = np.cumsum([0, *(len(x) for x in hashes)])

        def named(pick: np.ndarray, first=first, sizes=sizes, where=where) -> list[str]:
            """The strings of the distinct pre-tokens at pick."""
            at = first[pick]
            out = np.empty(len(pick), object)
            chunk = np.searchsorted(sizes, at, "right") - 1
            for c in np.unique(chunk):
                own = np.flatnonzero(chunk == c)
                cp, start, end = where[c]
                k = at[own] - sizes[c]
                out[own] = strings(cp, start[k], end[k])
            return out.tolist()

        yield i, j, keys, named, text, which


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Hot:
    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are known, their pieces, 0 for others)."""
        known, at = in_sorted(self.keys, keys)
        return known, np.where(known, self.n[np.minimum(at, max(len(self.n) - 1, 0))] if len(self.n) else 0, 0)


def hot_counts(texts: DataFrame, n: int, ranks: bytes, hot: int, sample: float) -> Hot:
    """Pieces of the most frequent pre-tokens of that share of n documents, or of about SAMPLE_LEAST if that is more, chosen by a hash of their ids."""
    share = int(min(1.0, max(sample, SAMPLE_LEAST / max(n, 1))) * 1_000_000)
    chosen = texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(1), lower=False)
            for _, _, keys, named, _, which in frequencies(data, off):
                n = np.bincount(which, minlength=len(keys))
                pick = np.flatnonzero(n > 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[pick].view(np.int64)), pa.array(named(pick), pa.string()), pa.array(n[pick])], ["k", "token", "n"])

    top = chosen.mapInArrow(run, "k long, token string, n long").groupBy("k", "token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(hot).select("k", "token").toArrow()
    keys, tokens = top.column(0).to_numpy().view(U), top.column(1).to_pylist()
    e = encoder(ranks)
    n = np.array([len(e.encode_ordinary(t)) for t in tokens], np.int64)
    o = np.argsort(keys)
    return Hot(keys[o], n[o])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, hot: int = HOT, sample: float = SAMPLE) -> DataFrame:
    """(doc_id, n_tokens): one row for each id, with the tokens of all texts of its rows.

    A null id is an id like others, and ids keep their type. Empty and null texts have no tokens, and their ids are in the result. Texts of any length
    are read whole. An empty table gives an empty result. ranks: the path of a rank file, read by the driver. Other columns aren't read.
    """
    spark = docs.sparkSession
    table, kind = read(ranks), id_type(docs, id_col)
    texts = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("t"))
    n_docs = texts.count()
    get = spread(spark, hot_counts(texts, n_docs, table, hot, sample))

    def joined(batches):
        own = get()
        for b in batches:
            data, off = text_bytes(b.column(1), lower=False)
            for i, j, keys, named, text, which in frequencies(data, off):
                known, n = own.counts(keys)
                sums = np.bincount(text - i, n[which], minlength=j - i).astype(np.int64)
                yield rows(b, np.arange(i, j), None, sums)
                rare = np.flatnonzero(~known)
                if len(rare):
                    place = np.full(len(keys), -1)
                    place[rare] = np.arange(len(rare))
                    some = np.flatnonzero(~known[which])
                    # rows of a pre-token stand together, where they compress well
                    pair, count = np.unique(place[which[some]] * (j - i) + text[some] - i, return_counts=True)
                    k, t = np.divmod(pair, j - i)
                    names = pa.array(named(rare), pa.string())
                    yield rows(b, t + i, names.take(pa.array(k)), count)

    def rows(b, t, names, n):
        doc = b.column(0).take(pa.array(t))
        return pa.RecordBatch.from_arrays([names if names is not None else pa.nulls(len(t), pa.string()), doc, pa.array(n, pa.int64())], ["token", "id", "n"])

    def summed(batches):
        e = memo(("encoder", hash(table)), lambda: encoder(table))
        known: dict[str, int] = {}
        for b in batches:
            names = b.column(0).dictionary_encode()
            words = names.dictionary.to_pylist()
            for w in words:
                if w not in known:
                    known[w] = len(e.encode_ordinary(w))
            per = np.array([known[w] for w in words] + [1], np.int64)
            which = names.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(b.column(2).to_numpy() * per[which])], ["doc_id", "n"])

    found = texts.mapInArrow(joined, f"token string, id {kind}, n long")
    # what is already counted goes anywhere
    by_token = found.repartition(task_count(spark, n_docs * 60, 1_000_000), F.coalesce("token", F.xxhash64("id", "n").cast("string")))
    return by_token.mapInArrow(summed, f"doc_id {kind}, n long").groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))


def row_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, hot: int = HOT, sample: float = SAMPLE) -> DataFrame:
    """(id, n): the number of tokens of each row's text, null for a null text, in one pass without a shuffle.

    The most frequent pre-tokens are broadcast as above; each part of the texts encodes its other distinct ones once.
    """
    table, kind = read(ranks), id_type(docs, id_col)
    texts = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("t"))
    get = spread(docs.sparkSession, hot_counts(texts, texts.count(), table, hot, sample))

    def run(batches):
        own, e = get(), memo(("encoder", hash(table)), lambda: encoder(table))
        for b in batches:
            data, off = text_bytes(b.column(1), lower=False)
            sums = np.zeros(b.num_rows, np.int64)
            for i, j, keys, named, text, which in frequencies(data, off, SMALL_PART):
                known, n = own.counts(keys)
                rare = np.flatnonzero(~known)
                n[rare] = [len(e.encode_ordinary(w)) for w in named(rare)]
                sums[i:j] = np.bincount(text - i, n[which], minlength=j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, mask=b.column(1).is_null().to_numpy(zero_copy_only=False))], ["id", "n"])
            del data, off
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, f"id {kind}, n long")
