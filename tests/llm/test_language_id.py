import numpy as np
import pyarrow as pa

from lodesearch.llm import language_id
from lodesearch.llm.textscan import text_bytes

from .conftest import odd_rows


def grams(text):
    b = bytes(c if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 32 for c in text.lower().encode())
    own = [b[k : k + language_id.GRAM] for k in range(len(b) - language_id.GRAM + 1)]
    return [int.from_bytes(g, "big") for g in own if b"  " not in g and g.count(b" ") < language_id.GRAM - 1]


def test_counts_by_gram():
    """Bit-sliced slots against a filter a language, gram by gram."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcde é,.\n"), rng.integers(0, 90))) for _ in range(60)]
    known = [np.array(sorted(set(grams("".join(texts[k::3])))), np.uint32)[:200] for k in range(3)]
    f = language_id.Filters(["a", "b", "c"], known)
    data, off = text_bytes(pa.array(texts))
    n, share = f.shares(data, off, 0, len(texts))
    for k, t in enumerate(texts):
        own = grams(t)
        assert n[k] == len(own)
        for lang in range(3):
            hits = sum(all(f.slots[0][p[0]] >> lang & 1 for p in f.places(np.array([g], np.uint32))) for g in own)
            np.testing.assert_allclose(share[k, lang], (hits / max(len(own), 1) - f.false[lang]) / (1 - f.false[lang]))
            assert hits >= sum(g in set(known[lang].tolist()) for g in own)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trained = language_id.train(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    got = language_id.identify(rest, trained).join(rest.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    right = sum(r.language == r.lang for r in got)
    assert right >= 0.97 * len(got)
    long = [r for r in got if r.n_chars >= 200]
    assert sum(r.language == r.lang for r in long) >= 0.99 * len(long)


def test_odd_rows_and_empty(documents, prose):
    rows = odd_rows(prose)
    f = language_id.train(documents([(1, "the cat and the dog", "en", "s"), (2, "le chat et le chien", "fr", "s"), (3, None, "de", "s"), (4, "x y z", None, "s")]))
    assert f.languages == ["en", "fr"]
    got = language_id.identify(documents(rows, clashing=True), f).collect()
    assert len(got) == len(rows) and all(r.language is None and r.share is None for r in got if r.n_grams == 0)
    assert language_id.identify(documents([]), f).isEmpty()
    none = language_id.train(documents([]))
    assert [r.language for r in language_id.identify(documents([(1, "some words here")]), none).collect()] == [None]
    assert language_id.identify(documents([(1, "The dog"), (2, "le chien")]), f).orderBy("doc_id").select("language").collect() == [("en",), ("fr",)]


def test_more_languages_than_a_mask_word_has_bits(documents, spark):
    def text(k):
        return " ".join(chr(97 + k // 10) * 2 + chr(97 + k % 10) * 2 + c for c in "xyz" * 3)

    docs = documents([(k, text(k), f"l{k:03}", "s") for k in range(150)])
    f = language_id.train(docs)
    assert len(f.languages) == 150 and f.slots.shape[0] == 3
    assert all(r.language == f"l{r.doc_id:03}" for r in language_id.identify(docs, f).collect())


def test_all_grams_are_in_the_filters_and_ties(documents, prose, spark):
    docs = documents([(1, prose(1, 9000), "en", "s")])
    f = language_id.train(docs)
    own = np.array(sorted(set(grams(prose(1, 9000)))), np.uint32)
    assert len(own) > 10_000 and all(m == 1 for m in f.masks(own)[0])
    same = language_id.train(documents([(1, "the same text", "zz", "s"), (2, "the same text", "aa", "s")]))
    ids = spark.createDataFrame([("6f-1c", "the same text")], "doc_id string, text string")
    assert [(r.doc_id, r.language) for r in language_id.identify(ids, same).collect()] == [("6f-1c", "aa")]
