"""URLs looked up in a blocklist of hosts and URL prefixes, kept as sorted digest arrays.

The blocklist's entries are written to the shared folder in shards by the top bits of their 64-bit xxhash: for each shard the sorted
digests, the offsets and the bytes of the entries in the same order. Tasks map these files into memory, probe them by vectorised binary
search, and compare the stored strings where a digest is found, so that a collision is never a match. A list of any size
can be used, as only the pages that are probed are read and nothing is broadcast. Digests are computed by Spark's own xxhash64.

Files are mapped where the shared folder is a mounted one; on another file system tasks read them through pyarrow.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept_path
from .textscan import take_spans

SHARD_ROWS = 1_000_000
BAD_TERMS = ["adult", "ads", "bets", "casino", "pills", "spam"]


def host_of(url: str | Column) -> Column:
    """The host in lower case, without user, port and final dot; empty if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    h = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(h, r"\.+$", "")


def path_of(url: str | Column) -> Column:
    """The path as written, without query, fragment and final slashes."""
    url = F.col(url) if isinstance(url, str) else url
    p = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(p, "/+$", "")


def probes(url: str | Column) -> Column:
    """Strings under which a URL may be listed: host with each prefix of the path, longest first, and the host's parent domains."""
    host, parts, labels = host_of(url), F.split(path_of(url), "/"), F.split(host_of(url), r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat(host, F.array_join(F.slice(parts, 1, n), "/")))
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).otherwise(F.array())
    return F.when(host != "", F.concat(prefixes, parents))


def listed_hosts(pages: DataFrame, url_col: str = "url", terms: list[str] | None = None) -> DataFrame:
    """(entry): the domains among the hosts of pages with one of the terms as a part of a label; a host's first label is left
    out where it has more than three."""
    labels = F.split(F.col("h"), r"\.")
    domain = F.when(F.size(labels) > 3, F.array_join(F.slice(labels, 2, F.size(labels)), ".")).otherwise(F.col("h"))
    hosts = pages.select(host_of(url_col).alias("h")).where("h <> ''").distinct()
    return hosts.where(F.arrays_overlap(F.split("h", r"[.\-]"), F.array(*map(F.lit, BAD_TERMS if terms is None else terms)).cast("array<string>"))).select(domain.alias("entry")).distinct()


def write_arrays(entries: DataFrame, folder: str, entry_col: str = "entry", shard_rows: int = SHARD_ROWS) -> int:
    """Writes the digest arrays of the distinct entries that aren't null or empty; returns the number of bits of a digest that name its shard."""
    own = entries.select(F.col(entry_col).cast("string").alias("entry")).where("entry is not null and entry <> ''").distinct()
    bits = max(0, (max(1, own.count()) - 1) // shard_rows).bit_length()
    shard = F.shiftrightunsigned(F.xxhash64("entry"), 64 - bits) if bits else F.lit(0).cast("long")

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by([("digest", "ascending"), ("entry", "ascending")])
        text = t.column("entry").cast(pa.large_string()).combine_chunks()
        number = t.column("shard")[0].as_py()
        parts = {"keys": t.column("digest").to_numpy(), "offsets": np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1], "bytes": np.frombuffer(text.buffers()[2], np.uint8)}
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for name, x in parts.items():
            # another attempt at this task writes the same bytes; a file appears whole
            temporary = f"{path}/.{name}-{number}-{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(np.ascontiguousarray(x).tobytes())
            system.move(temporary, f"{path}/{name}-{number}")
        return pa.table({"shard": [number]})

    rows = own.select("entry", F.xxhash64("entry").alias("digest"), shard.alias("shard"))
    rows.groupBy("shard").applyInArrow(write, "shard long").count()
    return bits


def open_array(folder: str, name: str, kind) -> np.ndarray:
    """One file of the arrays, mapped where it is on a mounted file system; empty if there is none."""
    system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, kind)
    with system.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


class Shard:
    def __init__(self, folder: str, number: int):
        self.keys = open_array(folder, f"keys-{number}", np.int64)
        self.offsets = open_array(folder, f"offsets-{number}", np.int64)
        self.bytes = open_array(folder, f"bytes-{number}", np.uint8)

    def contains(self, digest: np.ndarray, text: pa.Array) -> np.ndarray:
        """Whether each string is an entry: digests by binary search, then the strings of all entries with the digest."""
        out = np.zeros(len(digest), bool)
        at = np.searchsorted(self.keys, digest)
        left = np.flatnonzero(at < len(self.keys))
        while len(left := left[at[left] < len(self.keys)]):
            left = left[self.keys[at[left]] == digest[left]]
            stored = take_spans(self.bytes, self.offsets[at[left]], self.offsets[at[left] + 1])
            out[left] = pc.equal(stored, text.take(pa.array(left)).cast(pa.string())).to_numpy(zero_copy_only=False)
            left = left[~out[left]]
            at[left] += 1
        return out


def blocked(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", entry_col: str = "entry", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(page_id, url, blocked, entry): one row for each row of pages; entry is the most specific one that matches, or null.

    A null URL, or one without a host, is never blocked. Entries are hosts, or hosts with a path, in lower case as to the host; null, empty and repeated
    entries are ignored. An empty list blocks nothing. Other columns aren't read.
    """
    folder = kept_path(pages.sparkSession, "urls")
    bits = write_arrays(entries, folder, entry_col, shard_rows)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    # a projection of its own: digests come from the array, not from parsing again
    own = own.withColumn("probes", probes("url")).withColumn("digests", F.transform("probes", lambda p: F.xxhash64(p)))

    def run(batches):
        shards: dict[int, Shard] = {}
        for b in batches:
            lists = b.column(2)
            text, digest = lists.flatten(), b.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            number = (digest.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(digest), np.int64)
            hit = np.zeros(len(digest), bool)
            order = np.argsort(digest, kind="stable")
            for k in np.unique(number):
                if k not in shards:
                    shards[k] = Shard(folder, int(k))
                own = order[number[order] == k]
                hit[own] = shards[k].contains(digest[own], text.take(pa.array(own)))
            found = np.flatnonzero(hit)
            rows, first = np.unique(row[found], return_index=True)
            flags = np.zeros(len(lists), bool)
            flags[rows] = True
            entry = np.full(len(lists), -1)
            entry[rows] = found[first]
            taken = text.take(pa.array(entry, mask=entry < 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(flags), taken], ["page_id", "url", "blocked", "entry"])

    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(run, f"page_id {kind}, url string, blocked boolean, entry string")
