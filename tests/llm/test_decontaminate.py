import random

import numpy as np

from lodesearch.llm import decontaminate

from .conftest import CLASHES, odd_rows

ITEMS = "item_id long, text string"


def aligned(a, b):
    """Smith-Waterman cell by cell."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_by_cell():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 40))
        assert decontaminate.smith_waterman(a, b) == aligned(a, b)


def edited(words, share, seed):
    r, out = random.Random(seed), []
    for w in words:
        x = r.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["other"] if x < share else [w]
    return out


def test_whole_documents_against_brute_force(spark, documents, prose):
    items = [(k, prose(1000 + k, 15 + 3 * k)) for k in range(8)]
    rows = [(k, prose(k, 150)) for k in range(40)]
    for k in range(8):
        rows.append((100 + k, f"{prose(50 + k, 70)} {' '.join(edited(items[k][1].split(), 0.2, k))} {prose(90 + k, 70)}"))
        rows.append((200 + k, f"{prose(60 + k, 9)} {items[k][1].upper()}"))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(rows, clashing=True), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for i, t in rows:
        for k, x in items:
            score = aligned(x.lower().split(), t.lower().split()) / (2 * len(x.split()))
            if score >= decontaminate.THRESHOLD:
                want[i, k] = score
    assert {k: v for k, v in got.items() if want.get(k) != v} == {} and want.keys() - got.keys() == set()
    assert {(200 + k, k) for k in range(8)} | {(100 + k, k) for k in range(8)} <= got.keys()


def test_passes_change_nothing(spark, documents, prose):
    items = spark.createDataFrame([(k, prose(1000 + k, 30)) for k in range(6)], ITEMS)
    docs = documents([(k, prose(1000 + k % 6, 30) + prose(k, 30)) for k in range(12)])
    one, many = (sorted(map(tuple, decontaminate.contaminated(docs, items, item_words_a_pass=n).collect())) for n in (1 << 20, 40))
    assert one == many and len(one) == 12


def test_odd_rows(spark, documents, prose):
    items = spark.createDataFrame([(None, prose(3, 80)), (1, None), (2, ""), (3, prose(3, 80)), (3, prose(3, 80)), (4, "a"), (5, prose(2, 80))], ITEMS)
    docs = documents(odd_rows(prose), clashing=True)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} >= {(3, 3), (6, 3), (8, 4)}
    kept = decontaminate.drop_contaminated(docs, items)
    assert {1, 2, 5, None} <= {r.doc_id for r in kept.collect()} and not {3, 6, 8} & {r.doc_id for r in kept.collect()} and set(CLASHES) <= set(kept.columns)


def test_empty(spark, documents, prose):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contaminated(documents([]), spark.createDataFrame([(1, "a b c d")], ITEMS)).isEmpty()
    assert decontaminate.contaminated(documents([(1, prose(1, 20))]), none).isEmpty()
    assert decontaminate.drop_contaminated(documents([(1, prose(1, 20))]), none).count() == 1


def test_ids_of_other_types_and_many_passes(spark, prose):
    docs = spark.createDataFrame([("d-1", prose(1, 300)), ("d-2", prose(2, 300))], "doc_id string, text string")
    items = spark.createDataFrame([("i-1", " ".join(prose(1, 300).split()[100:140])), ("i-2", prose(9, 40)), ("i-3", " ".join(prose(2, 300).split()[:30]))], "item_id string, text string")
    for n in (1 << 20, 50):
        got = decontaminate.contaminated(docs, items, item_words_a_pass=n).collect()
        assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [("d-1", "i-1", 1.0), ("d-2", "i-3", 1.0)]
