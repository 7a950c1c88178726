import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHES = ["id", "t", "n", "k", "g", "u", "v", "p", "w", "c", "bin", "score", "secret", "entry", "word", "token", "probes", "digests", "keep_id", "rejected", "distance", "__row", "x0"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, lang, source), with clashing columns on request."""

    def make(rows, clashing=False):
        full = [(*r, "en", "s")[:4] if len(r) == 2 else tuple(r) for r in rows]
        full = [(*r, None if r[1] is None else len(r[1])) for r in full]
        df = spark.createDataFrame(full, COLUMNS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"<{c}>") for c in CLASHES})
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented text."""
    import random

    words = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=3 + k % 6)) for k in range(3000)]

    def make(seed, n):
        return " ".join(random.Random(seed).choices(words, k=n))

    return make


#: Nulls in any column, empty and very long texts, ties and repeated rows.
def odd_rows(prose):
    long = prose(1, 150_000)
    return [(1, "", "en", "s"), (2, None, "en", "s"), (None, prose(2, 80), "en", "s"), (3, prose(3, 80), None, None), (4, long, "fr", "s"), (5, "   \n", "en", None), (6, prose(3, 80), "en", "s"), (6, prose(3, 80), "en", "s"), (7, "é中文 ⚡ x", "", ""), (8, "a", "en", "s")]
