import re

import pytest
from pyspark.sql import functions as F

from lodesearch import queries
from lodesearch.engine import Index
from lodesearch.functions.analysis import Stopwords, Synonyms
from lodesearch.functions.stemming import stem
from lodesearch.operators import postings, rows
from lodesearch.plans import dsl

from conftest import SMALL

QUERIES = [
    {"term": {"text": "the"}}, {"match": {"text": "of"}}, {"prefix": {"text": {"value": "anth"}}}, {"wildcard": {"text": "th*tion"}}, {"fuzzy": {"text": {"value": "thand"}}},
    {"bool": {"must": [{"match": {"text": "the"}}, {"term": {"lang": "en"}}], "must_not": [{"match": {"text": "of"}}]}},
    {"bool": {"should": [{"match": {"text": "und"}}, {"match": {"text": "que"}}]}},
]
#: Queries that postings alone can't answer.
SCANNED = [{"match_phrase": {"text": "of the"}}, {"range": {"n_chars": {"lt": 500}}}, {"bool": {"must": [{"match": {"text": "nowhere"}}], "should": [{"match": {"text": "und"}}]}}]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    own = Index(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id")), "doc_id", facet_fields=["lang"])
    own.stopwords.add("la")
    own.synonyms.add("und", "oder")
    path = str(tmp_path_factory.mktemp("indices") / "docs")
    want = [{r.doc_id for r in own.match(q, "index").collect()} for q in QUERIES + SCANNED]
    own.save(path)
    return own, Index.load(spark, path), want


def test_stored_postings_answer_as_texts_do(stored):
    saved, loaded, want = stored
    for own in (saved, loaded):
        assert [{r.doc_id for r in own.match(q, "index").collect()} for q in QUERIES + SCANNED] == want
        assert own.match(QUERIES[0], "index").columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(want[:7])
    for q in QUERIES:
        plan = loaded.match(q, "index")._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and "posexplode" not in plan


def test_loaded_index_keeps_all(stored):
    saved, loaded, _ = stored
    assert loaded.stored and loaded.mapping.types == saved.mapping.types and loaded.facet_fields == ["lang"]
    assert list(loaded.stopwords) == ["la"] and loaded.synonyms.get("und") == ["oder"]
    assert loaded.count() == saved.count() and loaded.stats() == saved.stats()
    node = dsl.parse(QUERIES[1])
    a, b = (sorted((r.doc_id, round(r._score, 6)) for r in own.scores(own.match(QUERIES[1], "index"), node, "bm25").collect()) for own in stored[:2])
    assert a == b and a
    loaded.add(loaded.documents.limit(1).withColumn("text", F.lit("zyxw")))
    assert not loaded.stored and loaded.match({"term": {"text": "zyxw"}}, "index").count() == 1


def test_lengths_by_row(spark):
    df = spark.createDataFrame([(1, "It's a dog's life", "x y zz"), (2, None, None), (3, "", "one")], "id long, a string, b string")
    assert {r.doc_id: r.dl for r in postings.doc_stats(df).collect()} == {1: 4, 2: 0, 3: 1}
    p = postings.build(df)
    assert [r.pos for r in postings.positions(p, "a", "dog", 1).collect()] == [1]
    assert postings.balance(spark.createDataFrame([(0, 3), (1, 1)], "shard int, n long")).first().ratio == 1.5


REPEATED = [(1, "b a b aa aa bb", "aa"), (2, "aa bb aa", None), (2, "bb aa cc", "x"), (None, "dd", ""), (None, "dd dd ee", None), (3, None, None), (4, "", "It's zz's")]


def by_row():
    """Postings of REPEATED: rows of one id have theirs together."""
    want: dict = {}
    for i, a, b in REPEATED:
        for field, text in (("a", a), ("b", b)):
            tokens = [t for t in (text or "").lower().replace("'", " ").split() if len(t) > 1]
            for k, t in enumerate(tokens):
                want.setdefault((field, t, i), []).append(k)
    return {k: (len(v), sorted(set(v))) for k, v in want.items()}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().executedPlan().toString()


def test_postings_of_repeated_ids_by_row(spark):
    df, want = spark.createDataFrame(REPEATED, "id long, a string, b string"), by_row()
    p = postings.build(df)
    assert p.columns == ["field", "token", "doc_id", "tf", "positions"]
    got = [((r.field, r.token, r.doc_id), (r.tf, r.positions)) for r in p.collect()]
    assert dict(got) == want and len(got) == len(want)
    some = {(r.field, r.token, r.doc_id): (r.tf, r.positions) for r in postings.build(df, tokens=["AA", "dd", "none"]).collect()}
    assert some == {k: v for k, v in want.items() if k[1] in ("aa", "dd")}
    assert postings.build(df.select("id")).collect() == []


def test_postings_of_a_row_are_not_shuffled(spark):
    plan = final_plan(postings.build(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id", fields=["text"]))
    assert "hashpartitioning(field" not in plan and "ObjectHashAggregate" not in plan


def test_document_frequencies_count_rows(spark):
    """One row a token and part of the table is shuffled, none a posting."""
    df, want = spark.createDataFrame(REPEATED, "id long, a string, b string"), by_row()
    p = postings.pairs(df)
    assert p.columns == ["field", "token", "doc_id"] and sorted(map(str, p.collect())) == sorted(map(str, postings.build(df).select(*p.columns).collect()))
    got = {(r.field, r.token): r.df for r in postings.document_frequency(p).collect()}
    assert got == {(f, t): sum(k[:2] == (f, t) and k[2] is not None for k in want) for f, t, _ in want}
    plan = final_plan(queries.QUERIES["doc_freq"](spark, SMALL))
    assert "hashpartitioning(field" in plan and "Exchange hashpartitioning" in plan and not re.search(r"hashpartitioning\(field#\d+, token#\d+, doc_id", plan)


def test_deleted_documents_are_left_out_before_their_tokens(spark):
    """By joins without broadcasts, as large tables have them: nothing is shuffled once tokens are rows."""
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = final_plan(queries.QUERIES["postings_delete"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortMergeJoin" in plan and "Exchange" not in plan[: plan.index("Generate")]


def test_published_stems():
    pairs = "caresses caress,flies fli,dies die,mules mule,denied deni,died die,agreed agre,owned own,humbled humbl,sized size,meeting meet,stating state,itemization item,sensational sensat,traditional tradit,reference refer,colonizer colon,plotted plot,consign consign,consigned consign,consigning consign,consignment consign,consist consist,consistency consist,consistently consist,consolation consol,knack knack,knackeries knackeri,knavish knavish,knightly knight,generously generous,happy happi,running run,relational relat,hopping hop,hoping hope"
    for word, want in (p.split() for p in pairs.split(",")):
        assert stem(word) == want, word


def test_stopwords_and_synonyms_are_edited():
    s = Stopwords(["The"])
    s.add("An", "of")
    s.remove("of")
    assert s.has("the") and s.has("AN") and not s.has("of") and len(s) == 2
    s.clear()
    assert not len(s)
    y = Synonyms({"Red": ["crimson", "Scarlet"]})
    y.remove("red", "crimson")
    assert y.get("RED") == ["scarlet"] and y.keys() == ["red"] and y.enabled and y.stats()["synonyms"] == 1
    y.remove_key("red")
    assert not y.enabled


def test_deduped_insert(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert rows.insert_new(df.where("k = 1").distinct(), df, ["k"]).count() == 2
