import pytest
from pyspark.sql import functions as F

from lodesearch.sources import mapping
from lodesearch.sources.store import DocumentStore, Snapshots
from lodesearch.streaming.ingest import upsert_stream

SCHEMA = "id string, name string, n long"


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "name", "n").collect())


@pytest.fixture
def store(spark, tmp_path):
    s = DocumentStore(spark, f"file://{tmp_path}/store")
    s.put("a", spark.createDataFrame([("1", "x", 1), ("2", "y", 2), ("2", "y", 2)], SCHEMA))
    return s


def test_changes(spark, store):
    store.put("a", spark.createDataFrame([("2", "z", 5), ("3", None, None)], SCHEMA))
    assert rows(store.read("a").where("id <> '3'")) == [("1", "x", 1), ("2", "z", 5)]
    store.add_new("a", spark.createDataFrame([("1", "no", 0), ("4", "w", 4)], SCHEMA))
    assert store.count("a") == 4 and store.exists("a", "4") and not store.exists("a", "9")
    store.delete("a", spark.createDataFrame([("1",), ("9",)], "id string"))
    assert [r.id for r in store.find("a", limit=2, offset=1).collect()] == ["3", "4"]
    assert rows(store.find("a", equal={"name": None})) == [("3", None, None)]
    store.compact("a", 1)
    assert store.count("a") == 3 and store.list_indexes() == ["a"]
    store.clear("a")
    assert store.count("a") == 0
    store.delete_index("a")
    assert store.list_indexes() == []


def test_snapshots(spark, store, tmp_path):
    s = Snapshots(store, f"file://{tmp_path}/snapshots")
    first = s.create("daily", tags=["t"])
    store.clear("a")
    s.create("daily", where=F.col("n") > 1)
    assert [m["indexes"] for m in s.list()] == [{"a": 2}, {"a": 0}] and len(s.list("t")) == 1
    s.restore(first["name"])
    assert rows(store.read("a")) == [("1", "x", 1), ("2", "y", 2)]
    s.create("daily", keep=1)
    assert len(s.list()) == 1


def test_stream(spark, store, tmp_path):
    folder = f"{tmp_path}/in"
    spark.createDataFrame([("1", "new", 9), ("1", "newer", 10), ("7", "s", 7), (None, "q", 1)], SCHEMA).coalesce(1).write.json(folder)
    q = upsert_stream(spark.readStream.schema(SCHEMA).json(folder), store, "a", f"{tmp_path}/checkpoint", version="n")
    q.awaitTermination(60)
    assert rows(store.read("a")) == [("1", "newer", 10), ("2", "y", 2), ("7", "s", 7)]


def test_inferred_types(spark):
    df = spark.createDataFrame([("1", "hello world of words", "user@example.com", "https://example.com", "2023-01-01", 42, True, [40.7, -74.0])], "id string, a string, b string, c string, d string, e long, f boolean, g array<double>")
    got = mapping.infer_mapping(df)
    assert {k: got[k] for k in "abcdef"} == {"a": "text", "b": "email", "c": "url", "d": "date", "e": "number", "f": "boolean"}
