"""Documents kept as Parquet tables, one folder an index, with snapshots. Folders may be on any file system that Spark writes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rows
from .mapping import check_name


class Files:
    """What a store needs of Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.system.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(p))) if self.exists(p) else []

    def remove(self, p: str) -> None:
        self.system.delete(self.path(p), True)

    def move(self, a: str, b: str) -> None:
        if not self.system.rename(self.path(a), self.path(b)):
            raise OSError(f"can't move {a} to {b}")

    def write(self, p: str, text: str) -> None:
        out = self.system.create(self.path(p), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, p: str) -> str:
        stream = self.system.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class DocumentStore:
    """put, get, delete and find over versions of a table.

    Each change writes a new version and then moves the pointer CURRENT to it, so that readers see whole versions only and a job that
    is lost midway changes nothing. Old versions are removed by compact.
    """

    def __init__(self, spark: SparkSession, root: str, id_col: str = "id"):
        self.spark, self.root, self.id_col = spark, root.rstrip("/"), id_col
        self.files = Files(spark, self.root)

    def _index(self, name: str) -> str:
        return f"{self.root}/{check_name('index', name)}"

    def _current(self, name: str) -> str | None:
        p = f"{self._index(name)}/CURRENT"
        return self.files.read(p).strip() if self.files.exists(p) else None

    def _publish(self, name: str, df: DataFrame) -> None:
        version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self._index(name)}/{version}")
        self.files.write(f"{self._index(name)}/CURRENT", version)

    def create_index(self, name: str, df: DataFrame | None = None) -> None:
        if self._current(name) is None and df is not None:
            self._publish(name, df)

    def list_indexes(self) -> list[str]:
        return [n for n in self.files.names(self.root) if not n.startswith((".", "_")) and self._current(n)]

    def delete_index(self, name: str) -> None:
        self.files.remove(self._index(name))

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self._index(name)}/{version}")

    def put(self, name: str, df: DataFrame) -> None:
        """Adds documents, or replaces those with their ids; of rows that repeat an id one is kept."""
        df = df.dropDuplicates([self.id_col])
        self._publish(name, df if self._current(name) is None else rows.upsert(self.read(name), df, [self.id_col]))

    def add_new(self, name: str, df: DataFrame) -> None:
        """Adds only documents whose id isn't there yet."""
        self._publish(name, df.dropDuplicates([self.id_col]) if self._current(name) is None else rows.insert_new(self.read(name), df, [self.id_col]))

    def delete(self, name: str, ids: DataFrame) -> None:
        self._publish(name, rows.delete(self.read(name), ids, [self.id_col]))

    def get(self, name: str, ids: Iterable[str]) -> DataFrame:
        return self.read(name).where(F.col(self.id_col).isin(list(ids)))

    def exists(self, name: str, doc_id: str) -> bool:
        return not self.get(name, [doc_id]).isEmpty()

    def find(self, name: str | None = None, ids: Iterable[str] | None = None, equal: Mapping[str, Any] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
        """Documents by ids and strict equality of fields, in order of id; over all indices, with _index, if none is named."""
        if name is None:
            tables = [self.read(n).withColumn("_index", F.lit(n)) for n in self.list_indexes()]
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        else:
            df = self.read(name)
        return find(df, self.id_col, ids, equal, offset, limit)

    def count(self, name: str | None = None, equal: Mapping[str, Any] | None = None) -> int:
        return self.find(name, equal=equal).count()

    def stats(self, name: str) -> dict[str, Any]:
        df = self.read(name)
        return {"documents": df.count(), "version": self._current(name), "columns": df.columns}

    def compact(self, name: str, files: int | None = None) -> None:
        """Rewrites the index into fewer files and removes all other versions."""
        df = self.read(name)
        self._publish(name, df.coalesce(files) if files else df)
        current = self._current(name)
        for n in self.files.names(self._index(name)):
            if n.startswith("v-") and n != current:
                self.files.remove(f"{self._index(name)}/{n}")

    def clear(self, name: str) -> None:
        self._publish(name, self.read(name).limit(0))


def find(df: DataFrame, id_col: str = "id", ids: Iterable[Any] | None = None, equal: Mapping[str, Any] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    if ids is not None:
        df = df.where(F.col(id_col).isin(list(ids)))
    for k, v in (equal or {}).items():
        df = df.where(F.col(f"`{k}`").isNull() if v is None else F.col(f"`{k}`") == F.lit(v))
    if offset or limit is not None:
        df = df.orderBy(id_col)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


class Snapshots:
    """Named copies of a store's indices, each with a manifest."""

    def __init__(self, store: DocumentStore, root: str):
        self.store, self.root = store, root.rstrip("/")
        self.files = Files(store.spark, self.root)

    def create(self, label: str, indexes: Iterable[str] | None = None, tags: Iterable[str] = (), keep: int | None = None, where=None) -> dict[str, Any]:
        """Copies indices; where is a Column that documents must satisfy. keep: how many snapshots to retain, the newest."""
        name = f"{check_name('index', label)}-{time.time_ns()}"
        counts = {}
        for index in indexes if indexes is not None else self.store.list_indexes():
            df = self.store.read(index)
            df = df if where is None else df.where(where)
            df.write.parquet(f"{self.root}/{name}/{index}")
            counts[index] = self.store.spark.read.parquet(f"{self.root}/{name}/{index}").count()
        manifest = {"name": name, "label": label, "tags": list(tags), "indexes": counts}
        self.files.write(f"{self.root}/{name}/MANIFEST.json", json.dumps(manifest))
        if keep is not None:
            for old in self.list()[:-keep] if keep else self.list():
                self.delete(old["name"])
        return manifest

    def list(self, tag: str | None = None) -> list[dict[str, Any]]:
        """Manifests of the complete snapshots, oldest first."""
        found = [json.loads(self.files.read(p)) for n in self.files.names(self.root) if self.files.exists(p := f"{self.root}/{n}/MANIFEST.json")]
        found.sort(key=lambda m: int(m["name"].rpartition("-")[2]))
        return [m for m in found if tag is None or tag in m["tags"]]

    def delete(self, name: str) -> None:
        self.files.remove(f"{self.root}/{name}")

    def load(self, name: str, index: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.root}/{name}/{index}")

    def restore(self, name: str) -> None:
        """Makes the snapshot's indices the store's current ones."""
        manifest = json.loads(self.files.read(f"{self.root}/{name}/MANIFEST.json"))
        for index in manifest["indexes"]:
            self.store._publish(index, self.load(name, index))


def read_json_documents(spark: SparkSession, path: str, schema=None, lines: bool = True) -> DataFrame:
    """JSON lines, or files that hold one document or an array each."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def open_store(spark: SparkSession, config: Mapping[str, Any]) -> DocumentStore:
    """A store by configuration: kind "filesystem" (or a preset's name) with a path. Others aren't offered: a cache is DataFrame.persist, shards are partitions."""
    presets = {"development": "filesystem", "production": "filesystem", "filesystem": "filesystem", "sharded": "filesystem"}
    kind = presets.get(config.get("kind", "filesystem"))
    if kind is None:
        raise ValueError(f"unknown store {config.get('kind')!r}")
    return DocumentStore(spark, config["path"], config.get("id_col", "id"))
