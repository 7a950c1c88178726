import numpy as np
import pytest

from lodesearch.llm import packing, token_counts

from .conftest import odd_rows


def brute(lengths, capacity):
    """The same rule on a plain list, every pair tried."""
    left, bins = sorted(lengths), []

    def fill(own, gap):
        while fits := [n for n in left if n <= gap]:
            own.append(max(fits))
            left.remove(max(fits))
            gap -= own[-1]
        return gap

    while left:
        own: list[int] = []
        gap = fill(own, capacity)
        if gap:
            least = min(own)
            pairs = [(a + b, b, a) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= gap + least]
            if pairs:
                total, long, short = max(pairs)
                own.remove(least)
                left.remove(long)
                left.remove(short)
                left.append(least)
                left.sort()
                own += [long, short]
                fill(own, gap + least - total)
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_bins_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 120))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 60))) if seed % 2 else np.minimum(capacity, 1 + rng.geometric(0.1, 50))
    assert sorted(sorted(b) for b in packing.pack(lengths, capacity)) == brute(lengths.tolist(), capacity)


def n_tokens(text, e=token_counts.encoder(token_counts.read(token_counts.RANKS))):
    return len(e.encode_ordinary(text or ""))


def check(rows, want, capacity):
    """Every unit of every document is placed once, and no bin overlaps or overflows. want: [(id, length)]."""
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault((r.bin_group, r.bin), []).append((r.place, r.start, r.length))
        pieces.setdefault(r.doc_id, []).append((r.part, r.length))
    for own in bins.values():
        own.sort()
        at = 0
        for k, (place, start, n) in enumerate(own):
            assert place == k and start == at
            at += n
        assert at <= capacity
    total = {}
    for i, n in want:
        total[i] = total.get(i, 0) + n
    assert {i: sum(n for _, n in own) for i, own in pieces.items()} == {i: n for i, n in total.items() if n}
    return bins


def test_every_token_has_one_place(documents, prose):
    rows = [(k, prose(k, 1 + k * 7 % 150)) for k in range(200)]
    got = packing.pack_documents(documents(rows, clashing=True), capacity=64, group_rows=60).collect()
    bins = check(got, [(i, n_tokens(t)) for i, t in rows], 64)
    assert len({g for g, _ in bins}) > 1
    assert sum(n_tokens(t) for _, t in rows) / (64 * len(bins)) > 0.95


def test_odd_rows(documents, prose):
    rows = odd_rows(prose)
    got = packing.pack_documents(documents(rows, clashing=True)).collect()
    check(got, [(r[0], n_tokens(r[1])) for r in rows], packing.CAPACITY)
    assert len([r for r in got if r.doc_id == 4]) == -(-n_tokens(next(r[1] for r in rows if r[0] == 4)) // packing.CAPACITY)


def test_empty(documents):
    assert packing.pack_documents(documents([])).isEmpty()
    assert packing.pack_documents(documents([(1, ""), (2, None)])).isEmpty()
    with pytest.raises(ValueError):
        packing.pack_documents(documents([]), capacity=0)


def test_query(spark):
    from lodesearch.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op4_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    want = [(r.doc_id, n_tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert len(check(got, want, packing.CAPACITY)) <= sum(n for _, n in want) / packing.CAPACITY * 1.02 + 1


def test_the_only_document_of_a_bin_is_exchanged():
    ids, lengths = np.arange(6), np.array([84, 42, 23, 22, 53, 30])
    row, number, *_ = packing.placed(ids, lengths, 100)
    bins = {}
    for r, b in zip(row, number, strict=True):
        bins.setdefault(int(b), []).append(int(lengths[r]))
    assert sorted(sorted(b) for b in bins.values()) == [[22, 23, 30], [42, 53], [84]]
    for seed in range(20):
        lengths = np.random.default_rng(seed).integers(1, 101, 60)
        got = packing.pack(lengths, 100)
        assert sorted(n for b in got for n in b) == sorted(lengths) and all(sum(b) <= 100 for b in got)


def test_one_id_of_all_rows_is_spread_and_other_types(spark, prose):
    texts = [prose(k, 20 + k % 9) for k in range(300)]
    for kind, value in (("long", 7), ("long", None), ("string", "6f1c")):
        docs = spark.createDataFrame([(value, t) for t in texts], f"doc_id {kind}, text string")
        got = packing.pack_documents(docs, capacity=256, group_rows=50).collect()
        assert len({r.bin_group for r in got}) == 6 and len(got) == 300
        assert sum(r.length for r in got) == sum(map(n_tokens, texts)) and {r.doc_id for r in got} == {value}
