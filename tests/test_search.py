"""Semantics on small tables: fuzziness, phrases, geo, booleans, nested fields, pages, analyzers, mappings."""

import pytest

from lodesearch.engine import Engine
from lodesearch.functions import analysis
from lodesearch.plans import dsl
from lodesearch.plans.predicates import matching


def ids(df, query, semantics="effective", **options):
    return sorted(r.id for r in matching(df, query, semantics, **options).select("id").collect())


@pytest.fixture(scope="module")
def phrases(spark):
    rows = [("p1", "quick brown fox jumps"), ("p2", "quick red fox jumps"), ("p3", "quick brown dog jumps"), ("p4", "the quick brown fox"), ("p5", None), ("p6", "")]
    return spark.createDataFrame(rows, "id string, description string")


@pytest.mark.parametrize(("phrase", "slop", "want"), [("quick brown fox", 0, ["p1", "p4"]), ("quick fox", 0, []), ("quick fox", 1, ["p1", "p2", "p4"])])
def test_phrase(phrases, phrase, slop, want):
    assert ids(phrases, {"match_phrase": {"field": "description", "value": phrase, "slop": slop}}, "index") == want


def test_fuzzy(spark):
    df = spark.createDataFrame([("a", "hello"), ("b", "helo"), ("c", "hllo"), ("d", "hxllo"), ("e", "hxylzo")], "id string, name string")
    assert ids(df, {"fuzzy": {"field": "name", "value": "hello", "fuzziness": 2}}, "index") == ["a", "b", "c", "d"]


def test_prefix_and_wildcard(spark):
    df = spark.createDataFrame([("a", "university"), ("b", "unique"), ("c", "test"), ("d", "text"), ("e", "toast")], "id string, name string")
    assert ids(df, {"prefix": {"name": "uni"}}) == ["a", "b"]
    assert ids(df, {"wildcard": {"name": "te*t"}}) == ["c", "d"]


@pytest.mark.parametrize("center", [{"lat": 0.5, "lon": 0.5}, [0.5, 0.5]])
def test_geo(spark, center):
    df = spark.createDataFrame([("g1", (0.0, 0.0)), ("g2", (1.0, 1.0)), ("g3", (10.0, 10.0)), ("g4", (200.0, 300.0)), ("g5", None)], "id string, location struct<lat: double, lon: double>")
    assert ids(df, {"geo_distance": {"field": "location", "center": center, "distance": "100km"}}) == ["g1", "g2"]


@pytest.fixture(scope="module")
def food(spark):
    rows = [("fruit1", "organic red apple", "fruit", 2.5), ("fruit2", "regular green apple", "fruit", 1.5), ("fruit3", "organic banana", "fruit", 1.8), ("veg1", "organic carrot", "vegetable", 1.2)]
    return spark.createDataFrame(rows, "id string, name string, category string, price double")


def test_bool(food):
    q = {"bool": {"must": [{"match": {"name": "apple"}}], "must_not": [{"match": {"category": "vegetable"}}, {"range": {"price": {"gte": 2.0}}}]}}
    assert ids(food, q) == ["fruit2"]
    assert ids(food, {"bool": {"filter": [{"term": {"category": "fruit"}}]}}) == ["fruit1", "fruit2", "fruit3"]


def test_bad_queries(food):
    for q in ({"range": {}}, {"a": 1, "b": 2}, 5):
        with pytest.raises(ValueError):
            matching(food, q).collect()


def test_queries_round_trip():
    q = dsl.parse({"bool": {"must": [{"match": {"a": "x"}}], "filter": [{"range": {"n": {"gte": 1}}}], "should": [{"prefix": {"b": "y"}}]}})
    assert dsl.parse(q.to_dict()) == q


def test_nested(spark):
    df = spark.createDataFrame([("a", ("Ann", ["x", "y"], [("red", 1)])), ("b", ("Bob", ["z"], [("blue", 2), ("red", 3)])), ("c", None)], "id string, user struct<name: string, tags: array<string>, items: array<struct<colour: string, n: int>>>")
    assert ids(df, {"match": {"user.name": "ann"}}, "scan") == ["a"]
    assert ids(df, {"match": {"user.tags": "z"}}, "scan") == ["b"]
    assert ids(df, {"match": {"user.items.colour": "red"}}, "scan") == ["a", "b"]
    both = {"nested": {"path": "user.items", "query": {"bool": {"must": [{"match": {"colour": "red"}}, {"range": {"n": {"gte": 2}}}]}}}}
    assert ids(df, both, "scan") == ["b"]


def test_analyzers(spark):
    df = spark.createDataFrame([("Don't worry, be happy!",)], "t string")
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(analysis.standard("t")) == ["don", "worry", "be", "happy"]
    assert one(analysis.whitespace("t")) == ["Don't", "worry,", "be", "happy!"]
    assert one(analysis.keyword("t")) == ["Don't worry, be happy!"]
    phone = spark.createDataFrame([("(555) 123-4567",)], "t string").select(analysis.phone("t").alias("x")).first().x
    assert {"(555) 123-4567", "5551234567", "555", "123", "4567"} <= set(phone)


def test_engine(spark, food):
    e = Engine(spark)
    e.create_index("food", food, facet_fields=["category"])
    r = e.search("organic", "food", size=2)
    assert r.total == 3 and len(r.hits.collect()) == 2 and r.has_more()
    assert r.to_dict()["facets"] == {"category": {"fruit": 2, "vegetable": 1}}
    first, second = (e.search({"match_all": {}}, "food", offset=k, size=2, sort=[("price", "desc")]).hits.select("id").collect() for k in (0, 2))
    assert [x.id for x in first + second] == ["fruit1", "fruit3", "fruit2", "veg1"]
    e.add(spark.createDataFrame([("veg1", "carrot", "vegetable", 9.0), ("veg2", "leek", "vegetable", 1.0)], food.schema), "food")
    assert e.index("food").count() == 5 and e.index("food").get("veg1")["price"] == 9.0
    e.delete(["veg1"], "food")
    assert e.index("food").get("veg1") is None
    aggs = {"by": {"terms": {"field": "category"}}, "prices": {"histogram": {"field": "price", "interval": 1}}}
    got = e.search({"match_all": {}}, "food", aggs=aggs).to_dict()["aggregations"]
    assert got["by"]["buckets"] == [{"key": "fruit", "doc_count": 3}, {"key": "vegetable", "doc_count": 1}]
    assert [b["doc_count"] for b in got["prices"]["buckets"]] == [3, 1]
    assert e.list_indices() == ["food"] and e.delete_index("food")


def test_bm25_prefers_short_and_frequent(spark):
    df = spark.createDataFrame([("a", "word word word"), ("b", "word other text here"), ("c", "nothing"), ("d", "word")], "id string, name string")
    e = Engine(spark)
    e.create_index("w", df)
    hits = e.search({"match": {"name": "word"}}, "w").hits.collect()
    assert {h.id for h in hits} == {"a", "b", "d"} and hits[-1].id == "b" and hits[0]._score > hits[1]._score > 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, name string, n double")
    for q in ("word", {"match": {"name": "x"}}, {"range": {"n": {"gt": 1}}}, {"match_phrase": {"name": "a b"}}):
        assert ids(df, q) == []
