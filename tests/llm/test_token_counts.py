import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodesearch.llm import token_counts
from lodesearch.llm.textscan import text_bytes

from .conftest import odd_rows

TEXT = st.text(st.one_of(st.sampled_from(list("aszt'lrevdm 's  \n\t1٣é中  .,!-_😀́")), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_pre_tokens(texts):
    data, off = text_bytes(pa.array(texts, pa.string()), lower=False)
    cp, start, end, text, _ = token_counts.split(data, off, 0, len(texts))
    got = [(int(k), s) for k, s in zip(text, token_counts.strings(cp, start, end), strict=True)]
    assert got == [(k, m) for k, t in enumerate(texts) for m in regex.findall(token_counts.PATTERN, t)]


@pytest.fixture(scope="module")
def encoding():
    with open(token_counts.RANKS, "rb") as f:
        return token_counts.encoder(f.read())


@pytest.mark.parametrize("hot", [token_counts.HOT, 0, 50])
def test_against_encoding(spark, encoding, hot):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, hot=hot).collect()} == want


def test_odd_rows_and_empty(documents, prose, encoding):
    rows = [*odd_rows(prose), (20, "it's 'tis  we'll\t\n 12 ½ " * 3), (21, "😀" * 500), (22, "a" * 20_000)]
    want: dict = {}
    for r in rows:
        want[r[0]] = want.get(r[0], 0) + len(encoding.encode_ordinary(r[1] or ""))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(rows, clashing=True)).collect()} == want
    assert token_counts.token_counts(documents([])).isEmpty()
    assert np.array_equal(token_counts.token_starts(np.zeros(0, np.uint32), np.zeros(0, np.int64)), [])


def thue_morse(n, a="a", b="b"):
    own = [0]
    while len(own) < n:
        own += [1 - x for x in own]
    return [b if x else a for x in own[:n]]


def test_words_that_polynomial_hashes_confuse(documents):
    """Thue-Morse words of different letters, many of each, must be told apart."""
    a, b = "".join(thue_morse(2048)), "".join(thue_morse(2048, "b", "a"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents([(1, a), (2, b), (3, f"{a} {b} {a}")])).collect()}
    e = token_counts.encoder(token_counts.read(token_counts.RANKS))
    assert got == {k: len(e.encode_ordinary(t)) for k, t in ((1, a), (2, b), (3, f"{a} {b} {a}"))}


def test_ids_of_other_types_and_rows_alone(spark):
    docs = spark.createDataFrame([("a-1", "some words"), ("a-1", "more"), (None, "x"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {"a-1": 3, None: 1, "b": 0}
    assert sorted((str(r.id), str(r.n)) for r in token_counts.row_tokens(docs).collect()) == [("None", "1"), ("a-1", "1"), ("a-1", "2"), ("b", "None")]
