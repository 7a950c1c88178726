import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from lodesearch.llm import components, simhash
from lodesearch.llm.textscan import text_bytes

from .conftest import CLASHES, odd_rows


def brute(texts):
    """Signatures one document at a time, and all pairs within the radius."""
    ids, sig = [], []
    for i, t in texts:
        rows, s = simhash.signature_rows(*text_bytes(pa.array([t])), 0, 1)
        if len(rows):
            ids.append(i)
            sig.append(s[0])
    s, pairs = np.array(sig).reshape(-1, 2), set()
    for a in range(len(ids)):
        d = simhash.distance(np.broadcast_to(s[a], s.shape), s)
        pairs |= {(ids[a], ids[b]) for b in np.flatnonzero(d <= simhash.RADIUS) if ids[a] > ids[b]}
    return pairs


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("broadcast_bytes", [simhash.BROADCAST_BYTES, 0])
def test_recall_against_brute_force(spark, broadcast_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = groups(brute([tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]))
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(docs, broadcast_bytes=broadcast_bytes).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) > 0
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)


@pytest.mark.parametrize("options", [{}, {"chunk": 1500}])
def test_no_link_is_left_out(spark, monkeypatch, options):
    """2000 pairs of hashes as far apart as the radius, each a group of its own."""
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (2000, simhash.BITS), dtype=np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.permutation(simhash.BITS)[: simhash.RADIUS]] ^= 1
    s = np.packbits(np.concatenate([bits, other]), axis=1).view("<i8").reshape(-1, 2)
    hashes = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(s)], "id long, s0 long, s1 long")
    monkeypatch.setattr(simhash, "signatures", lambda *_: hashes)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert {tuple(r) for r in simhash.near_duplicates(docs, **options).collect()} == {(k + 2000, k) for k in range(2000)}


def test_chunks_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert {tuple(r) for r in simhash.near_duplicates(docs, chunk=300).collect()} == want


@pytest.mark.parametrize("broadcast_bytes", [simhash.BROADCAST_BYTES, 0])
def test_recall_of_sampled_bits(spark, broadcast_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    got = {r.doc_id for r in simhash.near_duplicates(docs, recall=simhash.RECALL, broadcast_bytes=broadcast_bytes).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


@pytest.mark.parametrize(("n", "radius"), [(10, 22), (1000, 22), (250_000, 22), (1 << 22, 22), (250_000, 3), (1 << 22, 30)])
def test_bands_find_pairs_at_the_radius(n, radius):
    """Each pair as far apart as the radius is found, whatever the number of bands, and nothing beyond it."""
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2, (200, simhash.BITS), dtype=np.uint8)
    at, beyond = bits.copy(), bits.copy()
    for k in range(len(bits)):
        own = rng.permutation(simhash.BITS)
        at[k, own[:radius]] ^= 1
        beyond[k, own[: radius + 1]] ^= 1
    s, near, far = (np.ascontiguousarray(np.packbits(x, axis=1).view("<i8").reshape(-1, 2).T) for x in (bits, at, beyond))
    bands = simhash.plan_bands(n, radius)
    assert sum(r + 1 for _, _, r, _ in bands) == radius + 1

    def pairs(a, b, same, parts):
        found = (x for band in bands for part in range(parts) for x in simhash.band_pairs(a, b, same, band, part, parts, radius))
        return {(int(x), int(y)) for q, node in found for x, y in zip(q, node, strict=True)}

    assert pairs(s, near, False, 3) == {(k, k) for k in range(200)} and not pairs(s, far, False, 1)
    both = pairs(np.hstack([s, near]), np.hstack([s, near]), True, 2)
    assert {tuple(sorted(x)) for x in both if x[0] != x[1]} == {(k, k + 200) for k in range(200)}


def test_joined():
    rng = np.random.default_rng(8)
    pairs = [tuple(rng.integers(0, 5000, (2, 60_000)) // 50 * 50 + rng.integers(0, 2, (2, 60_000))) for _ in range(9)]
    pairs = [(a, a // 50 * 50 + (b - b // 50 * 50)) for a, b in pairs]
    u, v = simhash.joined(iter(pairs), 5000)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == groups((int(x), int(y)) for a, b in pairs for x, y in zip(a, b, strict=True))


def test_forest_is_exact():
    rng = np.random.default_rng(5)
    s = rng.integers(-(1 << 62), 1 << 62, (300, 2))
    s[100:200] = s[:100] ^ (1 << rng.integers(0, 60, (100, 2)))
    shard = np.repeat([7, 9], 150)
    found = {(int(q), int(n)) for a, b in simhash.Forest(shard, s).search(s, shard, 12) for q, n in zip(a, b, strict=True)}
    want = {(a, b) for a in range(300) for b in range(300) if shard[a] == shard[b] and simhash.distance(s[a : a + 1], s[b : b + 1])[0] <= 12}
    assert found == want


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_one_of_each_group_stays(documents, prose):
    base = prose(9, 200)
    edited = base.replace(base.split()[50], "changed", 1)
    rows = [(10, base), (11, base.upper()), (12, edited), (13, prose(10, 200)), (14, base)]
    got = simhash.drop_near_duplicates(documents(rows, clashing=True))
    assert sorted(r.doc_id for r in got.collect()) == [10, 13] and set(CLASHES) <= set(got.columns)
    assert {(r.doc_id, r.keep_id) for r in simhash.near_duplicates(documents(rows)).collect()} == {(11, 10), (12, 10), (14, 10)}


def test_odd_rows(documents, prose):
    got = simhash.drop_near_duplicates(documents(odd_rows(prose), clashing=True)).collect()
    # the copy of 3 goes, both its rows; nulls, empty texts and others stay
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, k) for k in (1, 2, 3, 4, 5, 7, 8)] + [(True, 0)]
    twice = simhash.drop_near_duplicates(documents([(1, prose(4, 50)), (1, prose(4, 50)), (2, "")])).collect()
    assert sorted(r.doc_id for r in twice) == [1, 2]


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).isEmpty() and simhash.drop_near_duplicates(documents([])).isEmpty()


def test_query(spark):
    from lodesearch.llm.queries import QUERIES

    assert QUERIES["op7_simhash_near_duplicates"](spark, SMALL).columns == ["doc_id", "keep_id"]


@pytest.mark.parametrize("n", [1000, 10_000, 250_000, 15_000_000])
def test_recall_at_the_radius(n):
    """Pairs as far apart as the radius share a shard however large the corpus is."""
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2, (1000, simhash.BITS), dtype=np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.permutation(simhash.BITS)[: simhash.RADIUS]] ^= 1
    s, t = (np.packbits(b, axis=1).view("<i8").reshape(-1, 2) for b in (bits, other))
    assert (simhash.distance(s, t) == simhash.RADIUS).all()
    tables = simhash.plan_tables(n)
    together = (simhash.shard_keys(s, tables) == simhash.shard_keys(t, tables)).any(1)
    assert together.mean() >= simhash.RECALL - 0.015


def test_ids_of_other_types(spark, prose):
    docs = spark.createDataFrame([("b", prose(1, 80)), ("a", prose(1, 80)), ("c", prose(2, 80)), (None, prose(1, 80))], "doc_id string, text string")
    assert [tuple(r) for r in simhash.near_duplicates(docs).collect()] == [("b", "a")]
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {"a", "c", None}
