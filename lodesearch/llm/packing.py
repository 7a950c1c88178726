"""Documents packed into sequences of a fixed capacity by best-two-fit.

Each bin is filled greedily, always with the longest document that still fits. When none fits any more, and room is left, the bin's
smallest document is taken out again if two unpacked documents fit the widened gap more tightly than it did; of all pairs the one with
the greatest sum is taken, and of those the one with the longest document. After that greedy filling goes on.

A document's length is its number of tokens. Documents are dealt by a hash of their row to groups of about `group_rows`, each packed by one task, so the
number of groups grows with the corpus. A group wastes at most its last bins, which is little at that size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_type, materialise
from .token_counts import row_tokens

CAPACITY = 2048
GROUP_ROWS = 50_000


class Lengths:
    """Multiset of lengths up to the capacity as bit sets, for next-smaller and pair searches."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.count = counts.tolist()
        self.bits = self.mirror = self.twice = 0
        for n in np.flatnonzero(counts):
            self._show(int(n))

    def _show(self, n: int) -> None:
        for name, at, there in (("bits", n, self.count[n] > 0), ("mirror", self.capacity - n, self.count[n] > 0), ("twice", n, self.count[n] > 1)):
            x = getattr(self, name)
            setattr(self, name, x | 1 << at if there else x & ~(1 << at))

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if self.count[n] < 2:
            self._show(n)

    def put(self, n: int) -> None:
        self.count[n] += 1
        if self.count[n] < 3:
            self._show(n)

    def longest(self, gap: int) -> int:
        """The longest that fits, or 0."""
        return max(0, (self.bits & ((1 << gap + 1) - 1)).bit_length() - 1)

    def pair(self, gap: int, more_than: int) -> tuple[int, int] | None:
        """Two lengths with the greatest sum up to gap, if that is over more_than."""
        for total in range(gap, more_than, -1):
            shift = self.capacity - total
            both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
            if total % 2 == 0 and not self.twice >> total // 2 & 1:
                both &= ~(1 << total // 2)
            if both:
                a = both.bit_length() - 1
                return a, total - a
        return None


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of lengths, each from 1 to capacity, in the order in which they were put in."""
    left = Lengths(np.bincount(lengths, minlength=capacity + 1))
    bins = []
    while left.bits:
        own, gap = [], capacity

        def fill(own: list[int], gap: int) -> int:
            while gap and (n := left.longest(gap)):
                left.take(n)
                own.append(n)
                gap -= n
            return gap

        gap = fill(own, gap)
        if gap:
            least = min(own)
            if two := left.pair(min(gap + least, capacity), least):
                own.reverse()
                own.remove(least)
                own.reverse()
                for n in two:
                    left.take(n)
                    own.append(n)
                left.put(least)
                gap = fill(own, gap + least - sum(two))
        bins.append(own)
    return bins


def placed(ids: np.ndarray, lengths: np.ndarray, capacity: int):
    """(row, bin, place, start, part) for each piece of each row; rows in order of length and id are interchangeable by length.

    A document longer than the capacity is cut into full pieces, each a bin of its own, and the rest, which is packed like the others.
    """
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order]
    full, rest = lengths // capacity, lengths % capacity
    rows = np.repeat(np.arange(len(ids)), full)
    part = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
    out = [(order[rows], np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), part, np.full(len(rows), capacity))]
    some = np.flatnonzero(rest)
    some = some[np.lexsort((ids[some], rest[some]))]
    bins = pack(rest[some], capacity)
    if bins:
        flat = np.array([n for own in bins for n in own])
        number = np.repeat(np.arange(len(bins)), [len(own) for own in bins])
        start = np.cumsum(flat) - flat
        first = np.concatenate(([True], number[1:] != number[:-1]))
        place = np.arange(len(flat)) - np.flatnonzero(first)[number]
        start -= start[np.flatnonzero(first)][number]
        # the k-th use of a length goes to the k-th document of that length
        use = np.argsort(flat, kind="stable")
        rows = np.empty(len(flat), np.int64)
        rows[use] = some
        out.append((order[rows], number + len(out[0][0]), place, start, full[rows], flat))
    return (np.concatenate(x) for x in zip(*out, strict=True))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length=None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, part, length, bin_group, bin, place, start): where each piece of each document goes.

    length is an integer Column, by default the number of tokens of the text. A bin is named by bin_group and bin; pieces stand in it
    in order of place, each from start. Part k of a document begins at its unit k * capacity. Rows with a null length (so
    with a null text) or one under 1 have nothing to pack and give no row. A null id is packed like others. Rows that
    repeat are packed as often as they occur, and dealt to groups each by itself. Ties in length go by id; ids may be of any type that has an order.
    Texts of any length are counted whole. An empty table gives an empty result. Other columns aren't read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = id_type(docs, id_col)
    own = row_tokens(docs, id_col, text_col) if length is None else docs.select(F.col(id_col).cast(kind).alias("id"), length.cast("long").alias("n"))
    # written, so that a row's number and so its group are the same wherever they are read; tokens are counted once
    own = materialise(own.where("n >= 1").withColumn("r", F.monotonically_increasing_id()), "lengths")
    groups = max(1, -(-own.count() // group_rows))
    own = own.select("id", "n", F.pmod(F.xxhash64("r"), F.lit(groups)).alias("g"))

    def run(t: pa.Table) -> pa.Table:
        ids = t.column(0).combine_chunks()
        keys = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        row, number, place, start, part, n = placed(keys, t.column(1).to_numpy(), capacity)
        return pa.table([ids.take(pa.array(row)), pa.array(part), pa.array(n), t.column(2).take(pa.array(row)), pa.array(number), pa.array(place), pa.array(start)], names=["doc_id", "part", "length", "bin_group", "bin", "place", "start"])

    return own.groupBy("g").applyInArrow(run, f"doc_id {kind}, part long, length long, bin_group long, bin long, place long, start long")
