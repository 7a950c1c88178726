import re
from collections import defaultdict

import pytest
from conftest import SMALL, duck_rows, spark_rows

from lodesearch.llm import substring
from lodesearch.llm.queries import ORACLE_SQL, QUERIES

from .conftest import odd_rows


def brute(rows, window):
    """All windows compared as strings; rows that repeat an id merge under it."""
    seen = defaultdict(list)
    for i, t in rows:
        if i is not None and t is not None:
            w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
            for p in range(len(w) - window + 1):
                seen[tuple(w[p : p + window])].append((i, p))
    hits = sorted((i, p, k > 0) for at in seen.values() if len(at) > 1 for k, (i, p) in enumerate(sorted(at)))
    out = []
    for i, p, later in hits:
        if out and out[-1][0] == i and p <= out[-1][1] + out[-1][2]:
            last = out[-1]
            out[-1] = (i, last[1], p + window - last[1], last[3] + 1, last[4] + later)
        else:
            out.append((i, p, window, 1, int(later)))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "start_word", "n_words", "n_windows", "n_later").collect())


@pytest.mark.parametrize("sketch_bytes", [substring.SKETCH_BYTES, 0])
@pytest.mark.parametrize(("window", "gram"), [(50, 25), (8, 3), (4, 4)])
def test_brute_force(documents, prose, window, gram, sketch_bytes):
    shared = prose(77, 90)
    rows = [(1, prose(1, 300)), (2, prose(2, 40) + " " + shared + " " + prose(3, 60)), (3, shared), (4, f"{prose(4, 10)}. {shared.upper()}!"), (5, f"{shared} {shared}"), (6, prose(5, window)), (7, "la " * 200)]
    got = substring.repeated_passages(documents(rows, clashing=True), window=window, gram=gram, sketch_bytes=sketch_bytes)
    assert result(got) == brute(rows, window)


def test_odd_rows(documents, prose):
    rows = odd_rows(prose)
    got = substring.repeated_passages(documents(rows))
    own = {(r.doc_id, r.start_word, r.n_words) for r in got.collect()}
    assert {(3, 0, 80), (6, 0, 80)} <= own and {i for i, _, _ in own} == {3, 6}


def test_empty(documents):
    assert substring.repeated_passages(documents([])).isEmpty()


def test_twin(spark, duck):
    assert spark_rows(QUERIES["op8_substring_repeats"](spark, SMALL)) == duck_rows(duck, ORACLE_SQL["op8_substring_repeats"])


def thue_morse(n, a="a", b="b"):
    own = [0]
    while len(own) < n:
        own += [1 - x for x in own]
    return [b if x else a for x in own[:n]]


def test_words_that_polynomial_hashes_confuse(documents, prose):
    a, b = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))
    rest = prose(1, 60).split()
    rows = [(1, " ".join([*rest, a, *rest])), (2, " ".join([*rest[:30], "x", a, *rest[:20]])), (3, " ".join([*rest[:30], "y", b, *rest[:20]]))]
    got = {(r.doc_id, r.start_word) for r in substring.repeated_passages(documents(rows), window=25, gram=9).collect()}
    assert not any(i in (2, 3) and at > 6 for i, at in got)
    assert not substring.repeated_passages(documents([(1, " ".join([a] * 20 + rest[:20])), (2, " ".join([b] * 20 + rest[20:40]))]), window=20, gram=10).collect()


def test_ids_of_other_types(spark, prose):
    docs = spark.createDataFrame([("b", prose(1, 80)), ("a", prose(1, 80)), ("c", prose(2, 80))], "doc_id string, text string")
    assert {(r.doc_id, r.n_windows, r.n_later) for r in substring.repeated_passages(docs).collect()} == {("a", 31, 0), ("b", 31, 31)}
