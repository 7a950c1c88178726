"""Log-probability of documents under a unigram model over subword lattices.

The vocabulary is that of an existing SentencePiece model. A piece's score is the logarithm of its share of all pieces of the corpus
(each distinct word counted over all documents, segmented once by the existing model, weighted by its count, plus one). Every
segmentation of a document into pieces weighs in: pieces don't cross white space, so the marginal probability of a document is the product
over its words, and a word's is found by the forward recursion over its lattice in log space. A character that is no piece
is the product of its UTF-8 bytes' pieces.

What is gathered from the corpus is one row for each distinct word of each task; what is broadcast has the fixed size of the vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_type, spread
from .textscan import BASE, U, distinct_words, in_sorted, memo, pieces, prefix_hash, span_hash, take_spans, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PART = 4 << 20
LONG = 200
#: Lattice nodes held at once.
NODES = 1 << 20
FILTER_BITS = 20


def processor(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


class Lattice:
    def __init__(self, proto: bytes, counts: np.ndarray):
        sp = processor(proto)
        size = sp.get_piece_size()
        score = np.log((counts + 1.0) / (counts.sum() + size))
        self.byte_score = np.full(256, -math.inf)
        self.score: dict[str, float] = {}
        for k in range(size):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_score[int(piece[3:5], 16)] = score[k]
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)) and SPACE not in piece[1:]:
                self.score[piece] = float(score[k])
        self.longest = max(map(len, self.score))
        # without byte pieces an unknown character has the unknown piece's score
        self.byte_score[~np.isfinite(self.byte_score)] = math.log(1 / (counts.sum() + size))
        text = [code_points(p) for p in self.score]
        h = np.array([span_hash(prefix_hash(x.astype(U) + U(1), BASE), np.array([0]), np.array([len(x)]), BASE)[0] for x in text], U)
        o = np.argsort(h)
        self.keys, self.values = h[o], np.array(list(self.score.values()))[o]
        self.some = np.zeros(1 << FILTER_BITS, bool)
        self.some[h & U((1 << FILTER_BITS) - 1)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of h that are pieces, their scores)."""
        at = np.flatnonzero(self.some[h & U((1 << FILTER_BITS) - 1)])
        ok, place = in_sorted(self.keys, h[at])
        return at[ok], self.values[place[ok]]

    def fallback(self, cp: np.ndarray) -> np.ndarray:
        """Score of each character as bytes."""
        kinds, which = np.unique(cp, return_inverse=True)
        return np.array([sum(self.byte_score[b] for b in chr(int(c)).encode("utf-8", "replace")) for c in kinds])[which]

    def one(self, word: str) -> float:
        """The forward recursion for one string, in Python."""
        a = [0.0]
        for j in range(1, len(word) + 1):
            terms = []
            for s in range(1, min(j, self.longest) + 1):
                x = self.score.get(word[j - s : j])
                if x is None and s == 1:
                    x = sum(self.byte_score[b] for b in word[j - 1].encode("utf-8", "replace"))
                if x is not None:
                    terms.append(a[j - s] + x)
            top = max(terms)
            a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return a[-1]

    def words(self, words: pa.Array) -> np.ndarray:
        """Log-probability of each word, with the mark of a word's begin before it."""
        marked = pc.binary_join_element_wise(SPACE, words, "")
        size = pc.utf8_length(marked).to_numpy(zero_copy_only=False)
        out = np.zeros(len(size))
        long = np.flatnonzero(size > LONG)
        for k in long:
            out[k] = self.one(marked[int(k)].as_py())
        order = np.argsort(-size, kind="stable")[len(long) :]
        while len(order):
            n = max(1, NODES // (int(size[order[0]]) + 1))
            out[order[:n]] = self.forward(marked.take(pa.array(order[:n])), size[order[:n]])
            order = order[n:]
        return out

    def forward(self, marked: pa.Array, size: np.ndarray) -> np.ndarray:
        """The forward recursion for many strings, longest first; size: their characters."""
        data, _ = text_bytes(marked, lower=False)
        cp = code_points(data.tobytes().decode("utf-8")).astype(np.int64)
        prefix = prefix_hash(cp.astype(U) + U(1), BASE)
        start = np.cumsum(size) - size
        alpha = np.full((int(size[0]) + 1, len(size)), -np.inf)
        alpha[0] = 0
        for j in range(1, int(size[0]) + 1):
            m = int(np.searchsorted(-size, -j, "right"))  # words of at least j characters
            end = start[:m] + j
            row = np.full(m, -np.inf)
            for s in range(1, min(j, self.longest) + 1):
                at, x = self.lookup(span_hash(prefix, end - s, end, BASE))
                row[at] = np.logaddexp(row[at], alpha[j - s, at] + x)
                if s == 1:
                    known = np.zeros(m, bool)
                    known[at] = True
                    other = np.flatnonzero(~known)
                    if len(other):
                        row[other] = alpha[j - 1, other] + self.fallback(cp[end[other] - 1])
            alpha[j, :m] = row
        return alpha[size, np.arange(len(size))]


def word_parts(batches):
    """(distinct words' bytes, counts...) of bounded parts of the batches' last column."""
    for b in batches:
        data, off = text_bytes(b.column(b.num_columns - 1), lower=False)
        for i, j in pieces(off, PART):
            yield b, data, off, i, j


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches):
        for _, data, off, i, j in word_parts(batches):
            _, start, end, n, _, _ = distinct_words(data[off[i] : off[j]], off[i : j + 1] - off[i], 0, j - i)
            for a in range(0, len(start), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([take_spans(data[off[i] : off[j]], start[part], end[part]), pa.array(n[part])], ["word", "n"])

    return texts.select("t").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> Lattice:
    """Piece scores from all texts of docs. model: the path of a SentencePiece model, read by the driver."""
    with open(model, "rb") as f:
        proto = f.read()
    size = processor(proto).get_piece_size()

    def segmented(batches):
        sp = memo(("sentencepiece", hash(proto)), lambda: processor(proto))
        counts = np.zeros(size, np.int64)
        for b in batches:
            n = b.column(1).to_numpy()
            ids = sp.encode(b.column(0).to_pylist(), num_threads=1)
            flat = np.fromiter((x for own in ids for x in own), np.int64, sum(map(len, ids)))
            np.add.at(counts, flat, np.repeat(n, [len(own) for own in ids]))
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[k])], ["piece", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null")
    counts = np.zeros(size)
    for piece, n in word_counts(texts).mapInArrow(segmented, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[piece] = n
    return Lattice(proto, counts)


def score(docs: DataFrame, lattice: Lattice, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_chars, log_prob, bits_per_char): one row for each row with a text.

    n_chars has one for the begin of each word. A text without words has log_prob 0 and no bits_per_char. Rows with a null text give none;
    a null id stays null, and ids keep their type. Texts of any length are read whole, and rows that repeat are scored each. An empty table gives an
    empty result. Other columns aren't read.
    """
    kind = id_type(docs, id_col)
    get = spread(docs.sparkSession, lattice)

    def run(batches):
        own = get()
        for b, data, off, i, j in word_parts(batches):
            data, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            _, start, end, _, doc, which = distinct_words(data, o, 0, j - i)
            words = take_spans(data, start, end)
            value = own.words(words)
            chars = pc.utf8_length(words).to_numpy(zero_copy_only=False) + 1
            n, m, p = (np.bincount(doc, w, minlength=j - i) for w in (None, chars[which], value[which]))
            m, p = m.astype(np.int64), p.astype(np.float64)  # of no words bincount makes integers
            bits = pa.array(-p / math.log(2) / np.maximum(m, 1), mask=m == 0)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(m), pa.array(p), bits], ["doc_id", "n_words", "n_chars", "log_prob", "bits_per_char"])

    own = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    return own.mapInArrow(run, f"doc_id {kind}, n_words long, n_chars long, log_prob double, bits_per_char double")


def score_corpus(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Trains on docs and scores them."""
    return score(docs, train(docs, text_col, model), id_col, text_col)
