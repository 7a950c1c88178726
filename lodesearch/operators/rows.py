"""Operations on sets of documents: upserts, deletes, duplicates by key, set algebra, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """One row for each key, the one of the greatest version; ties by the given columns, greatest first."""
    order = [F.desc(version), *(F.desc(c) for c in ties or [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with their keys. Columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_anti")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key is not there yet, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect_ids(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    return a.join(b.select(key), key, "left_semi").distinct()


def subtract_ids(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti").distinct()


def trimmed(df: DataFrame, most_chars: int = 10_000, most_items: int = 1_000) -> DataFrame:
    """Strings trimmed and cut, arrays cut."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.substring(F.trim(c), 1, most_chars)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.slice(c, 1, most_items)
        out.append(c.alias(f.name))
    return df.select(*out)
