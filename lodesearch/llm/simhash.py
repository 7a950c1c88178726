"""Near duplicates by SimHash and BK-trees.

Each document gets a SimHash of 128 bits over its distinct words, weighted by their length, so that
function words, which all documents share, count little. Documents within `radius` bits are linked;
groups are the connected components, and the least doc_id of each stays.

All pairs within the radius are found. The hash is cut into bands, and each band has a radius of its own such that the radii plus one
add up to `radius` plus one: two hashes beyond the radius of every band differ in more than `radius` bits. Hashes equal in a band are a
shard of it. A BK-tree (children keyed by their Hamming distance to the parent) of the keys of a band's shards is searched
for the keys within the band's radius of each, going down only those edges whose key is within that radius of the distance to
the node, and the whole hashes of the shards found are compared. The number of bands is the one that costs least at the number of hashes;
it has no effect on the result. Hashes lie as arrays in the shared folder, in chunks of bounded size; a task reads two
chunks and compares a part of the one with the other in one band, so nothing is shuffled or broadcast.

With a recall below 1 candidates are sampled instead, for corpora too large for the above: a table t looks at key_bits sampled bits
of the hash, and hashes equal there form a shard, which has a BK-tree that every member searches. While the trees of all shards together
are small (broadcast_bytes, checked) they are broadcast. Beyond it hashes are shuffled by shard, and a task builds and searches its own
shards' trees. Both give the same pairs. The number of sampled bits grows with the logarithm of the number of hashes, so
a shard keeps its size as the corpus grows, and the number of tables follows from the recall for pairs that differ in
`radius` bits, the farthest that count: they agree in a table's bits with the hypergeometric probability, and
nearer pairs are found more surely.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import delete, kept_path, materialise, release, sized, spread, task_count, with_long_ids
from .textscan import U, find_words, mix, pieces, text_bytes
from .url_filter import open_array

BITS = 128
RADIUS = 22
#: Of plan_tables() alone, which a recall below 1 asks for.
RECALL = 0.98
#: Hashes of random bits in a shard, as a power of two. Larger shards need fewer tables, so less is shuffled and more compared.
SHARD_BITS = 7
LONGEST = 10
BROADCAST_BYTES = 16 << 20
#: Hashes in a chunk, of which a task holds two.
CHUNK = 1 << 22
#: Pairs of hashes that a part of a band is to compare, about.
PART_PAIRS = 1 << 28
#: Pairs compared at once, so that they stay in the cache.
STEP = 1 << 16
#: A band's keys have at most so many bits, which bounds its tree.
KEY_BITS = 16


def signature_rows(data, off, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have words, their hashes as n x 2 integers)."""
    start, end, doc, h = find_words(data, off, i, j)
    if len(h) == 0:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    keep = np.sort(order[new])
    h, doc = h[keep], doc[keep]
    weight = np.minimum(end[keep] - start[keep], LONGEST).astype(np.uint8)
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    docs = doc[cut]
    total = np.add.reduceat(weight.astype(np.int64), cut)
    out = np.zeros((len(docs), BITS // 8), np.uint8)
    sums = np.zeros((len(docs), BITS), np.int64)
    step = 1 << 14
    group = np.cumsum(np.concatenate(([False], doc[1:] != doc[:-1])))
    for a in range(0, len(h), step):
        part = h[a : a + step]
        words = np.stack([mix(part), mix(part ^ U(0xA5A5A5A55A5A5A5A))], 1)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        bits *= weight[a : a + step, None]
        g = group[a : a + step]
        c = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sums[g[c]] += np.add.reduceat(bits, c, axis=0, dtype=np.int32)
    out = np.packbits(2 * sums > total[:, None], axis=1)
    return docs, out.view("<i8").reshape(-1, 2)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0, s1) of each row with a non-null integer id and at least one word."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, off = text_bytes(b.column(1))
            for i, j in pieces(off):
                rows, s = signature_rows(data, off, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1])], ["id", "s0", "s1"])
        pa.default_memory_pool().release_unused()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    return own.mapInArrow(run, "id long, s0 long, s1 long")


def plan_tables(n: int, recall: float = RECALL, radius: int = RADIUS) -> np.ndarray:
    """Sampled bit positions, one row a table."""
    key_bits = min(40, max(8, math.ceil(math.log2(max(n, 2))) - SHARD_BITS))
    together = math.comb(BITS - radius, key_bits) / math.comb(BITS, key_bits)
    tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-together))) if together < 1 else 1
    rng = np.random.default_rng(64)
    return np.stack([rng.permutation(BITS)[:key_bits] for _ in range(tables)])


def shard_keys(s: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """n x tables: the shard of each hash in each table."""
    bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(len(s), BITS // 8), axis=1)
    out = np.empty((len(s), len(tables)), np.int64)
    for t, at in enumerate(tables):
        key = np.zeros(len(s), np.int64)
        for k, p in enumerate(at):
            key |= bits[:, p].astype(np.int64) << k
        out[:, t] = key | (t << 44)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return (np.bitwise_count(x[:, 0].view(U)) + np.bitwise_count(x[:, 1].view(U))).astype(np.int64)


class Forest:
    """BK-trees of many shards in flat arrays. `roots` has the root of each of the sorted `shards`."""

    def __init__(self, shard: np.ndarray, s: np.ndarray):
        order = np.argsort(shard, kind="stable")
        self.s = s
        first = np.ones(len(order), bool)
        first[1:] = shard[order][1:] != shard[order][:-1]
        self.roots = order[first]
        self.shards = shard[self.roots]
        parent = np.full(len(s), -1, np.int64)
        edge = np.zeros(len(s), np.int64)
        rest = order[~first]
        under = self.roots[np.cumsum(first) - 1][~first]
        while len(rest):
            d = distance(self.s[rest], self.s[under])
            place = np.lexsort((d, under))
            rest, under, d = rest[place], under[place], d[place]
            first = np.ones(len(rest), bool)
            first[1:] = (under[1:] != under[:-1]) | (d[1:] != d[:-1])
            parent[rest[first]], edge[rest[first]] = under[first], d[first]
            node = rest[first][np.cumsum(first) - 1]
            rest, under = rest[~first], node[~first]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 256 + edge[child]
        o = np.argsort(key, kind="stable")
        self.child, self.key = child[o], key[o]

    def search(self, s: np.ndarray, shard: np.ndarray, radius: int, step: int = 1 << 18):
        """Yields arrays (query, node) of pairs within the radius in the query's shard."""
        found = np.searchsorted(self.shards, shard)
        ok = self.shards[np.minimum(found, len(self.shards) - 1)] == shard if len(self.shards) else np.zeros(len(shard), bool)
        q = np.flatnonzero(ok)
        stack = [(q, self.roots[found[q]])]
        while stack:
            q, node = stack.pop()
            if len(q) > step:
                stack.append((q[step:], node[step:]))
                q, node = q[:step], node[:step]
            d = distance(s[q], self.s[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.key, node * 256 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 256 + np.minimum(d + radius, 255), "right")
            n = hi - lo
            if n.sum():
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                stack.append((np.repeat(q, n), self.child[at]))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) with the same components as u, v."""
    if len(u) == 0:
        return u, v
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == was).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def gathered(pairs, ids_q: np.ndarray, ids_n: np.ndarray):
    """The spanning edges of many pair arrays, in bounded memory."""
    u, v, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for q, node in pairs:
        a, b = ids_q[q], ids_n[node]
        keep = a > b
        waiting.append((a[keep], b[keep]))
        size += int(keep.sum())
        if size > 1 << 20:
            u, v = spanning(np.concatenate([u, *(x for x, _ in waiting)]), np.concatenate([v, *(y for _, y in waiting)]))
            waiting, size = [], 0
    return spanning(np.concatenate([u, *(x for x, _ in waiting)]), np.concatenate([v, *(y for _, y in waiting)]))


def plan_bands(n: int, radius: int = RADIUS) -> list[tuple[int, int, int, int]]:
    """(first bit, bits, radius, pairs to compare) of each band, as many bands as cost least with n hashes of random bits a chunk.

    The radii plus one add up to radius + 1, so two hashes within the radius are within that of a band.
    """

    def cut(m: int):
        own, more = divmod(radius + 1, m)
        ends = [BITS * k // m for k in range(m + 1)]
        for k in range(m):
            width, r = min(ends[k + 1] - ends[k], KEY_BITS), own - (k >= more)
            ball = sum(math.comb(width, x) for x in range(min(r, width) + 1))
            yield ends[k], width, r, n * n * ball >> width

    def cost(band) -> float:
        """Nanoseconds, about: by pair of keys in the tree, key and pair of hashes."""
        keys = min(n, 1 << band[1])
        return 20.0 * keys * keys + 60_000.0 * keys + 5.0 * band[3]

    return min((list(cut(m)) for m in range(1, min(radius, BITS - 1) + 2)), key=lambda bands: sum(map(cost, bands)))


def band_keys(s: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The band's bits of each hash. s: 2 x n."""
    x = s[first // 64].view(U) >> U(first % 64)
    if first < 64 < first + bits:
        x = x | s[1].view(U) << U(64 - first)
    return (x & U((1 << bits) - 1)).astype(np.uint16)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and where each begins, with the end."""
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[cut].astype(np.int64), np.append(cut, len(keys))


def band_pairs(a: np.ndarray, b: np.ndarray, same: bool, band, part: int, parts: int, radius: int):
    """Yields arrays (row of a, row of b) of the pairs within the radius whose keys are within the band's. a, b: 2 x n.

    Rows of a are taken in order of their keys, the given one of so many equal parts. If a and b are the same, a pair of two keys is given once.
    """
    first, bits, r = band[:3]
    key_a, key_b = band_keys(a, first, bits), band_keys(b, first, bits)
    order_b = np.argsort(key_b, kind="stable")
    order_a = (order_b if same else np.argsort(key_a, kind="stable"))[len(key_a) * part // parts : len(key_a) * (part + 1) // parts]
    asked, begin = runs(key_a[order_a])
    nodes, at = runs(key_b[order_b])
    b0, b1, size = b[0][order_b].view(U), b[1][order_b].view(U), np.diff(at)
    a0, a1 = a[0][order_a].view(U)[:, None], a[1][order_a].view(U)[:, None]

    def as_hashes(keys):
        return np.stack([keys, np.zeros_like(keys)], 1)

    tree = Forest(np.zeros(len(nodes), np.int64), as_hashes(nodes))
    for k in range(0, len(asked), 2048):
        keys = asked[k : k + 2048]
        found = [(q, node) for q, node in tree.search(as_hashes(keys), np.zeros(len(keys), np.int64), r)]
        if not found:
            continue
        q, node = (np.concatenate(x) for x in zip(*found, strict=True))
        if same:
            keep = nodes[node] >= keys[q]
            q, node = q[keep], node[keep]
        o = np.argsort(q, kind="stable")
        q, node = q[o], node[o]
        whose, cut = runs(q)
        for w, x, y in zip(whose.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            near = node[x:y]
            n = size[near]
            rows = np.repeat(at[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
            for c in range(0, len(rows), STEP):
                cols = rows[c : c + STEP]
                c0, c1 = b0[cols], b1[cols]
                lo, hi, step = int(begin[k + w]), int(begin[k + w + 1]), max(1, STEP // len(cols))
                for i in range(lo, hi, step):
                    j = min(i + step, hi)
                    d = np.bitwise_count(a0[i:j] ^ c0)
                    d += np.bitwise_count(a1[i:j] ^ c1)
                    hit = np.flatnonzero(d <= radius)
                    if len(hit):
                        row, col = np.divmod(hit, len(cols))
                        yield order_a[i + row], order_b[cols[col]]


def joined(pairs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, node of its component) with the same components as the pairs of nodes 0 to size - 1. Pairs of nodes that are joined already are let go at once, so
    groups of many near copies take little memory."""
    label, waiting, held = np.arange(size), [], 0

    def join():
        nonlocal label
        u, v = spanning(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        to = np.arange(size)
        to[u] = v
        label = to[label]

    for a, b in pairs:
        a, b = label[a], label[b]
        apart = a != b
        if apart.any():
            waiting.append((a[apart], b[apart]))
            held += len(waiting[-1][0])
        if held > 1 << 18:
            join()
            waiting, held = [], 0
    if waiting:
        join()
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]


def write_chunks(nodes: DataFrame, n: int, folder: str, chunk: int) -> int:
    """Writes s0, s1 and id of the nodes as arrays, one file a chunk; returns the number of chunks."""
    count = max(1, -(-n // chunk))

    def write(t: pa.Table) -> pa.Table:
        number = t.column("chunk")[0].as_py()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        # another attempt at this task writes the same rows; a file appears whole
        temporary = f"{path}/.hashes-{number}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as f:
            for name in ("s0", "s1", "id"):
                f.write(t.column(name).to_numpy().tobytes())
        system.move(temporary, f"{path}/hashes-{number}")
        return pa.table({"chunk": [number]})

    rows = nodes.select("id", "s0", "s1", F.pmod(F.xxhash64("s0", "s1"), F.lit(count)).alias("chunk"))
    rows.groupBy("chunk").applyInArrow(write, "chunk long").count()
    return count


def all_edges(nodes: DataFrame, n: int, folder: str, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): edges whose components are those of all pairs within the radius. nodes: id, s0, s1, each hash once; n rows. The folder is read when the edges are."""
    spark = nodes.sparkSession
    count = write_chunks(nodes, n, folder, chunk)
    bands = plan_bands(-(-n // count), radius)
    parts = [max(1, -(-band[3] // PART_PAIRS)) for band in bands]
    last = np.cumsum(parts)
    items = count * (count + 1) // 2 * int(last[-1])

    def compare(batches):
        for batch in batches:
            for item in batch.column(0).to_pylist():
                pair, k = divmod(item, int(last[-1]))
                j = (math.isqrt(8 * pair + 1) - 1) // 2
                i = pair - j * (j + 1) // 2
                t = int(np.searchsorted(last, k, "right"))
                a = open_array(folder, f"hashes-{i}", np.int64).reshape(3, -1)
                b = a if i == j else open_array(folder, f"hashes-{j}", np.int64).reshape(3, -1)
                shift = 0 if i == j else a.shape[1]
                found = band_pairs(a[:2], b[:2], i == j, bands[t], k - int(last[t]) + parts[t], parts[t], radius)
                u, v = joined(((x, y + shift) for x, y in found), shift + b.shape[1])
                ids = a[2] if i == j else np.concatenate([a[2], b[2]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["u", "v"])
        pa.default_memory_pool().release_unused()

    return spark.range(0, items, 1, min(items, 20_000)).mapInArrow(compare, "u long, v long")


def near_edges(nodes: DataFrame, n: int, radius: int = RADIUS, recall: float = RECALL, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(u, v): edges whose components are those of all pairs found by sampled bits. nodes: id, s0, s1, each hash once; n rows."""
    spark = nodes.sparkSession
    tables = plan_tables(n, recall, radius)

    def stacked(b, at: int):
        return np.stack([b.column(at).to_numpy(zero_copy_only=False), b.column(at + 1).to_numpy(zero_copy_only=False)], 1).astype(np.int64)

    def edges(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    if n * len(tables) * 32 <= broadcast_bytes:
        all_nodes = nodes.select("id", "s0", "s1").toArrow().combine_chunks()
        ids = all_nodes.column(0).to_numpy()
        s = np.stack([all_nodes.column(1).to_numpy(), all_nodes.column(2).to_numpy()], 1).astype(np.int64)
        tree_ids = spark.sparkContext.broadcast(np.tile(ids, len(tables)))
        trees = spread(spark, Forest(shard_keys(s, tables).T.ravel(), np.tile(s, (len(tables), 1))))

        def search_all(batches):
            forest = trees()
            for b in batches:
                s = stacked(b, 1)
                found = forest.search(np.tile(s, (len(tables), 1)), shard_keys(s, tables).T.ravel(), radius)
                yield edges(*gathered(found, np.tile(b.column(0).to_numpy(), len(tables)), tree_ids.value))

        return nodes.select("id", "s0", "s1").mapInArrow(search_all, "u long, v long")

    def by_shard(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                s = stacked(part, 1)
                keys, t = shard_keys(s, tables).ravel(), len(tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), t)), pa.array(np.repeat(s[:, 0], t)), pa.array(np.repeat(s[:, 1], t))], ["k", "id", "s0", "s1"])

    def search_own(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        del got
        k, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
        s = np.stack([t.column(2).to_numpy(), t.column(3).to_numpy()], 1)
        del t
        o = np.argsort(k, kind="stable")
        same = k[o][1:] == k[o][:-1]
        more = np.zeros(len(k), bool)
        more[1:] |= same
        more[:-1] |= same
        o = o[more]  # shards of one hash have no pairs
        k, ids, s = k[o], ids[o], s[o]
        if len(k):
            yield edges(*gathered(Forest(k, s).search(s, k, radius), ids, ids))
        del k, ids, s, o, same, more
        pa.default_memory_pool().release_unused()

    rows = nodes.select("id", "s0", "s1").mapInArrow(by_shard, "k long, id long, s0 long, s1 long")
    return rows.repartition(task_count(spark, n * len(tables), 100_000), "k").mapInArrow(search_own, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = 1, broadcast_bytes: int = BROADCAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, keep_id): every document that has a copy with a lesser id, and the least id of its group.

    Groups are those of all pairs within the radius. A recall below 1 asks for candidates by sampled bits instead, which leave pairs out.
    Rows with a null id or text, and texts without words, have no copies. Rows that repeat an id count
    as one document with the words of any of them; all are linked to each other by their id. Ids may be of any type that
    has an order. Texts of any length are read whole. Other columns aren't read. An empty table gives an empty result.
    """
    return with_long_ids(docs.select(id_col, text_col), id_col, lambda own: _near_duplicates(own, id_col, text_col, radius, recall, broadcast_bytes, chunk), ["doc_id", "keep_id"])


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, radius: int, recall: float, broadcast_bytes: int, chunk: int) -> DataFrame:
    found = materialise(signatures(docs, id_col, text_col), "signatures")
    nodes = materialise(found.groupBy("s0", "s1").agg(F.min("id").alias("id")), "nodes")
    n = nodes.count()
    same = found.join(nodes.select("s0", "s1", F.col("id").alias("node")), ["s0", "s1"]).where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    folder = kept_path(docs.sparkSession, "hashes")
    edges = near_edges(nodes, n, radius, recall, broadcast_bytes) if recall < 1 else all_edges(nodes, n, folder, radius, chunk)
    roots = connected_components(edges.unionAll(same))
    release(found, nodes)  # the components are a table of their own
    delete(folder)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one document of each group, all columns as they were.

    Of rows with the same id and text one stays. Rows with a null id, and texts without words, stay.
    """
    out = near_duplicates(docs, id_col, text_col, **options).select(F.col("doc_id").alias(id_col))
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("__rows")).where("__rows > 1").select(id_col)
    again = materialise(again, "repeated_ids")
    out, again = (sized(d, d.count(), 16) for d in (out, again))
    kept = docs.join(out, id_col, "left_anti").select(*docs.columns)
    once = kept.join(again, id_col, "left_anti").select(*docs.columns)
    many = kept.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col])
    return once.unionAll(many)
