import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodesearch.llm import lattice_lm

from .conftest import odd_rows


@pytest.fixture(scope="module")
def proto():
    with open(lattice_lm.MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def lattice(proto):
    size = lattice_lm.processor(proto).get_piece_size()
    return lattice_lm.Lattice(proto, np.random.default_rng(3).integers(0, 1000, size).astype(float))


def by_segmentation(lattice, word):
    """The sum over every segmentation, one by one."""

    def value(piece):
        if piece in lattice.score:
            return lattice.score[piece]
        return sum(lattice.byte_score[b] for b in piece.encode()) if len(piece) == 1 else None

    total = 0.0
    for cuts in range(1 << len(word) - 1):
        parts, at = [], 0
        for k in range(1, len(word) + 1):
            if k == len(word) or cuts >> k - 1 & 1:
                parts.append(word[at:k])
                at = k
        values = [value(p) for p in parts]
        if None not in values:
            total += math.exp(sum(values))
    return math.log(total)


def test_every_segmentation(lattice):
    words = ["the", "letters", "élan", "中文", "x", "zzqzz", "⚡a"]
    np.testing.assert_allclose(lattice.words(pa.array(words)), [by_segmentation(lattice, lattice_lm.SPACE + w) for w in words], rtol=1e-9)


def test_chunks_and_long_words(lattice, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choices("abcdeé中 "[:7], k=r.choice([1, 2, 3, 8, 30, 199, 200, 450]))) for _ in range(120)]
    want = [lattice.one(lattice_lm.SPACE + w) for w in words]
    np.testing.assert_allclose(lattice.words(pa.array(words)), want, rtol=1e-9)
    monkeypatch.setattr(lattice_lm, "NODES", 500)
    np.testing.assert_allclose(lattice.words(pa.array(words)), want, rtol=1e-9)


def words_of(text):
    import re

    return [w for w in re.split(r"[\t\n\x0b\x0c\r ]+", text) if w]


def test_scores_of_whole_documents(spark, proto):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sp = lattice_lm.processor(proto)
    counts = np.zeros(sp.get_piece_size())
    for w, n in Counter(w for t in texts.values() for w in words_of(t)).items():
        for k in sp.encode(w):
            counts[k] += n
    lattice = lattice_lm.Lattice(proto, counts)
    got = {r.doc_id: r for r in lattice_lm.score_corpus(spark, docs).collect()}
    assert got.keys() == texts.keys()
    known: dict[str, float] = {}
    for i, t in texts.items():
        own = words_of(t)
        p = sum(known.setdefault(w, lattice.one(lattice_lm.SPACE + w)) for w in own)
        assert got[i].n_words == len(own) and got[i].n_chars == sum(len(w) + 1 for w in own)
        np.testing.assert_allclose(got[i].log_prob, p, rtol=1e-9)


def test_odd_rows_and_empty(spark, documents, prose, lattice):
    rows = odd_rows(prose)
    got = lattice_lm.score(documents(rows, clashing=True), lattice).collect()
    assert len(got) == len([r for r in rows if r[1] is not None])
    assert all(r.log_prob == 0 and r.bits_per_char is None for r in got if r.n_words == 0) and all(r.log_prob < 0 for r in got if r.n_words)
    assert lattice_lm.score(documents([]), lattice).isEmpty()
    assert lattice_lm.score_corpus(spark, documents([])).isEmpty()


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a-1", "some words"), ("a-1", ""), (None, "x y"), ("b", None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_words) for r in lattice_lm.score_corpus(spark, docs).collect()) == [("None", 2), ("a-1", 0), ("a-1", 2)]
