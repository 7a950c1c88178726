"""Named queries over the test tables and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis, geo, stemming
from .operators import aggregations as agg
from .operators import postings, rows, scoring
from .plans import dsl
from .plans.predicates import matching
from .sources import mapping
from .sources.store import find

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query by its name, with its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def match(df: DataFrame, q, semantics: str, key: str, **options) -> DataFrame:
    return matching(df, q, semantics, id_col=key, **options).select(key)


def twin(source: str, key: str, where: str) -> str:
    return f"SELECT {key} FROM {source} WHERE {where}"


#: DuckDB expression of standard tokens.
TOKENS = r"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda t: length(t) > 1)"
DOC_TOKENS = TOKENS.format(c="text")
NAME_TOKENS = TOKENS.format(c="p_name")

# the minimum slice


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"bool": {"must": [{"match": {"text": "the"}}], "filter": [{"term": {"lang": "en"}}], "must_not": [{"range": {"n_chars": {"gte": 5000}}}]}}
    return matching(table(spark, sf_dir, "documents"), q, "scan", id_col="doc_id").select("doc_id", "source", "n_chars").orderBy("doc_id")


QUERIES["bool_filtered_search"] = flagship
ORACLE_SQL["bool_filtered_search"] = "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(lang), 'en') AND NOT coalesce(n_chars >= 5000, false)"

# leaves


@query("SELECT doc_id FROM documents")
def match_all(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"match_all": {}}, "index", "doc_id")


@query(twin("documents", "doc_id", "contains(lower(lang), 'en')"))
def term_scan(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"term": {"lang": "EN"}}, "scan", "doc_id")


@query(twin("documents", "doc_id", f"list_contains({DOC_TOKENS}, 'the')"))
def term_index(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"term": {"field": "text", "value": "The"}}, "index", "doc_id")


@query(f"""
WITH p AS (SELECT DISTINCT doc_id, unnest({DOC_TOKENS}) AS token FROM documents)
SELECT DISTINCT doc_id FROM p WHERE token = 'the'""")
def term_postings(spark, sf_dir):
    return postings.expand(postings.pairs(table(spark, sf_dir, "documents"), "doc_id", fields=["text"]), "text", "the")


@query(twin("documents", "doc_id", "n_chars = 416"))
def term_number(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"term": {"n_chars": 416}}, "scan", "doc_id")


@query(twin("part", "p_partkey", "contains(lower(p_name), 'red')"))
def match_scan(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"match": {"p_name": {"query": "Red"}}}, "scan", "p_partkey")


@query(twin("part", "p_partkey", "contains(lower(p_name), 'a') AND contains(lower(p_type), 'a') OR contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1')"))
def match_star(spark, sf_dir):
    q = {"bool": {"should": [{"match": {"_all": "Brand#1"}}, {"bool": {"must": [{"match": {"p_name": "a"}}, {"match": {"p_type": "a"}}]}}]}}
    return match(table(spark, sf_dir, "part"), q, "scan", "p_partkey")


@query(twin("part", "p_partkey", "contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')"))
def multi_match(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"multi_match": {"fields": ["p_name", "p_type"], "query": "red"}}, "scan", "p_partkey")


@query(twin("part", "p_partkey", "len(list_filter(string_split(lower(p_name), ' '), lambda t: levenshtein(t, 'wiget') <= 1)) > 0"))
def match_fuzzy_scan(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"match": {"field": "p_name", "value": "wiget", "fuzziness": 1}}, "scan", "p_partkey")


@query(twin("part", "p_partkey", "levenshtein(lower(p_name), 'red wdget') <= 2 OR levenshtein(lower(p_brand), 'red wdget') <= 2 OR levenshtein(lower(p_type), 'red wdget') <= 2"))
def fuzzy_star(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"fuzzy": {"field": "*", "value": "red wdget"}}, "scan", "p_partkey")


@query(twin("documents", "doc_id", f"len(list_filter({DOC_TOKENS}, lambda t: levenshtein(t, 'thand') <= 1)) > 0"))
def fuzzy_index(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"fuzzy": {"text": {"value": "thand"}}}, "index", "doc_id")


@query(f"""
WITH v AS (SELECT doc_id, unnest({DOC_TOKENS}) AS token FROM documents)
SELECT DISTINCT doc_id FROM v WHERE levenshtein(token, 'thand') <= 1""")
def fuzzy_vocabulary(spark, sf_dir):
    return postings.expand(postings.pairs(table(spark, sf_dir, "documents"), "doc_id", fields=["text"]), "text", "thand", "fuzzy", 1)


@query(twin("part", "p_partkey", "starts_with(lower(p_name), 'sm')"))
def prefix_scan(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"prefix": {"p_name": "SM"}}, "scan", "p_partkey")


@query(twin("part", "p_partkey", "starts_with(lower(p_name), 'smell') OR levenshtein(substring(lower(p_name), 1, 5), 'smell') <= 1"))
def prefix_fuzzy_scan(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"prefix": {"field": "p_name", "value": "smell", "fuzziness": 1}}, "scan", "p_partkey")


@query(twin("documents", "doc_id", f"len(list_filter({DOC_TOKENS}, lambda t: starts_with(t, 'anth'))) > 0"))
def prefix_index(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"prefix": {"text": {"value": "anth"}}}, "index", "doc_id")


@query(twin("part", "p_partkey", "regexp_full_match(lower(p_name), '.*wid.et')"))
def wildcard_scan(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"wildcard": {"p_name": "*WID?et"}}, "scan", "p_partkey")


@query(twin("documents", "doc_id", f"len(list_filter({DOC_TOKENS}, lambda t: regexp_full_match(t, 'th.*tion'))) > 0"))
def wildcard_index(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"wildcard": {"text": "th*tion"}}, "index", "doc_id")


@query(twin("documents", "doc_id", "contains(lower(text), 'of the')"))
def phrase_scan(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"match_phrase": {"text": "Of the"}}, "scan", "doc_id")


@query(f"""
WITH t AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)
SELECT DISTINCT doc_id FROM p WHERE w[i] = 'of' AND w[i + 1] = 'the'""")
def phrase_index(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"match_phrase": {"text": "of the"}}, "index", "doc_id")


@query(f"""
WITH t AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t),
a AS (SELECT doc_id, w, i, CASE WHEN w[i] = 'in' THEN i WHEN w[i + 1] = 'in' THEN i + 1 END AS k FROM p)
SELECT DISTINCT doc_id FROM a
WHERE k IS NOT NULL AND (
  CASE WHEN greatest(k + 1, i + 1) <= least(len(w), i + 2) AND w[greatest(k + 1, i + 1)] = 'the' THEN greatest(k + 1, i + 1)
       WHEN greatest(k + 1, i + 1) + 1 <= least(len(w), i + 2) AND w[greatest(k + 1, i + 1) + 1] = 'the' THEN greatest(k + 1, i + 1) + 1 END) IS NOT NULL""")
def phrase_slop(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"match_phrase": {"field": "text", "value": "in the", "slop": 1}}, "index", "doc_id")


STRINGS_SQL = TOKENS.format(c="text || ' ' || lang || ' ' || source")
STOP_SQL = "['a', 'an', 'and', 'at', 'but', 'by', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with']"


@query(twin("documents", "doc_id", f"list_has_all({STRINGS_SQL}, ['ing', 'en'])"))
def string_and(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), "ing, en", "scan", "doc_id")


@query(twin("documents", "doc_id", f"list_has_any(list_filter({STRINGS_SQL}, lambda t: NOT list_contains({STOP_SQL}, t)), ['the', 'src3', 'que'])"))
def string_or(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), "the src3 que", "scan", "doc_id", operator="or")


@query(twin("part", "p_partkey", f"list_has_any({NAME_TOKENS}, ['red', 'blue', 'crimson'])"))
def synonym_expand(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"term": {"p_name": "red"}}, "index", "p_partkey", synonyms=analysis.Synonyms({"red": ["blue", "crimson"]}))


@query(twin("customer", "c_custkey", "lower(c_mktsegment) = 'building'"))
def match_equality(spark, sf_dir):
    return match(table(spark, sf_dir, "customer"), {"match": {"c_mktsegment": "Building"}}, "equality", "c_custkey")


# range, existence, geo


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12.5 AND l_discount > 0.05")
def range_num(spark, sf_dir):
    q = {"bool": {"must": [{"range": {"l_quantity": {"gte": 10, "lt": 12.5}}}, {"range": {"field": "l_discount", "gt": 0.05}}]}}
    return matching(table(spark, sf_dir, "lineitem"), q, "scan", id_col="l_orderkey").select("l_orderkey", "l_linenumber")


@query(twin("part", "p_partkey", "p_brand >= 'Brand#2' AND p_brand <= 'Brand#4'"))
def range_str(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"range": {"p_brand": {"gte": "Brand#2", "lte": "Brand#4"}}}, "index", "p_partkey")


@query(twin("orders", "o_orderkey", "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-07-01'"))
def range_date(spark, sf_dir):
    return match(table(spark, sf_dir, "orders"), {"range": {"o_orderdate": {"gte": "1995-01-01", "lt": "1995-07-01"}}}, "scan", "o_orderkey")


def _props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(k % 3 != 0, k).alias("k"))


_K = "CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END"


@query(twin("events", "event_id", f"({_K}) IS NOT NULL"))
def exists_filter(spark, sf_dir):
    return match(_props(spark, sf_dir), dsl.filter_to_query("k", operator="exists"), "scan", "event_id")


@query(twin("events", "event_id", f"({_K}) IS NULL"))
def missing_filter(spark, sf_dir):
    return match(_props(spark, sf_dir), dsl.filter_to_query("k", operator="missing"), "scan", "event_id")


@query(twin("events", "event_id", f"({_K}) IN (1, 4, 7)"))
def filter_in(spark, sf_dir):
    return match(_props(spark, sf_dir), dsl.filter_to_query("k", [1, 4, 7], "in"), "scan", "event_id")


@query(twin("events", "event_id", f"NOT coalesce(({_K}) IN (1, 4, 7), false)"))
def filter_nin(spark, sf_dir):
    return match(_props(spark, sf_dir), dsl.filter_to_query("k", [1, 4, 7], "nin"), "scan", "event_id")


@query("SELECT event_id FROM events WHERE NOT contains(lower(event_type), (SELECT min(event_type) FROM events))")
def filter_ne(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type")).first()[0]
    return match(events, dsl.filter_to_query("event_type", least, "ne"), "scan", "event_id")


_LAT, _LON = "((c_custkey * 7919) % 18000) / 100.0 - 90", "((c_custkey * 104729) % 36000) / 100.0 - 180"
_A = f"pow(sin(radians((({_LAT}) - 48.85) / 2)), 2) + cos(radians(48.85)) * cos(radians({_LAT})) * pow(sin(radians((({_LON}) - 2.35) / 2)), 2)"


def _places(spark, sf_dir):
    lat, lon = (F.col("c_custkey") * 7919 % 18000) / F.lit(100.0) - 90, (F.col("c_custkey") * 104729 % 36000) / F.lit(100.0) - 180
    return table(spark, sf_dir, "customer").select("c_custkey", F.struct(lat.alias("lat"), lon.alias("lon")).alias("place"))


@query(f"SELECT c_custkey FROM customer WHERE 2 * 6371 * atan2(sqrt({_A}), sqrt(1 - ({_A}))) <= 2000")
def geo_distance(spark, sf_dir):
    return match(_places(spark, sf_dir), {"geo_distance": {"field": "place", "center": [48.85, 2.35], "distance": "2000km"}}, "index", "c_custkey")


@query(f"SELECT c_custkey, round(2 * 6371 * atan2(sqrt({_A}), sqrt(1 - ({_A}))), 3) AS km FROM customer")
def geo_distances(spark, sf_dir):
    p = _places(spark, sf_dir)
    return p.select("c_custkey", F.round(geo.haversine_km(F.lit(48.85), F.lit(2.35), F.col("place.lat"), F.col("place.lon")), 3).alias("km"))


# compounds


@query(twin("documents", "doc_id", "contains(lower(text), 'ation') AND contains(lower(lang), 'fr')"))
def bool_must(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), dsl.must(dsl.Match("text", "ation"), dsl.Term("lang", "fr")), "scan", "doc_id")


@query(twin("documents", "doc_id", f"list_contains({DOC_TOKENS}, 'und') OR list_contains({DOC_TOKENS}, 'the')"))
def bool_should(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), dsl.should(dsl.Match("text", "und"), dsl.Match("text", "the")), "index", "doc_id")


@query(twin("part", "p_partkey", "NOT contains(lower(p_name), 'red')"))
def bool_must_not(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), dsl.must_not(dsl.Match("p_name", "red")), "scan", "p_partkey")


@query(twin("part", "p_partkey", "p_size >= 10 AND p_size <= 20 AND starts_with(lower(p_name), 'b')"))
def bool_filter(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), dsl.filtered(dsl.Range("p_size", gte=10, lte=20), dsl.Prefix("p_name", "b")), "scan", "p_partkey")


@query(twin("part", "p_partkey", f"p_size < 20 AND CAST(contains(lower(p_name), 'red') AS INT) + CAST(p_size > 10 AS INT) + CAST(contains(lower(p_brand), '1') AS INT) >= 2"))
def bool_minimum_should_match(spark, sf_dir):
    q = {"bool": {"must": {"range": {"p_size": {"lt": 20}}}, "should": [{"match": {"p_name": "red"}}, {"range": {"p_size": {"gt": 10}}}, {"match": {"p_brand": "1"}}], "minimum_should_match": 2}}
    return match(table(spark, sf_dir, "part"), q, "scan", "p_partkey")


@query(f"""
WITH f AS (SELECT p_partkey, list_contains({NAME_TOKENS}, 'nowhere') AS m, list_contains({NAME_TOKENS}, 'red') AS s FROM part)
SELECT p_partkey FROM f WHERE CASE WHEN (SELECT bool_or(m) FROM f) THEN m ELSE s END""")
def bool_empty_mandatory(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"bool": {"must": [{"match": {"p_name": "nowhere"}}], "should": [{"match": {"p_name": "red"}}]}}, "index", "p_partkey")


@query(f"""
WITH f AS (SELECT doc_id, list_contains({DOC_TOKENS}, 'ation') AS p, contains(lower(text), 'ation') AS n FROM documents),
c AS (SELECT count(*) FILTER (p) AS np, count(*) FILTER (n) AS nn FROM f)
SELECT doc_id FROM f, c WHERE CASE WHEN np = 0 OR nn > np THEN n ELSE p END""")
def effective_larger(spark, sf_dir):
    return match(table(spark, sf_dir, "documents"), {"match": {"text": "ation"}}, "effective", "doc_id")


@query(f"""
WITH f AS (SELECT p_partkey, list_contains({NAME_TOKENS}, 'red') OR list_contains({NAME_TOKENS}, 'blue') AS p,
  contains(lower(p_name), 'red') AND (contains(lower(p_type), 'x') OR contains(lower(p_name), 'blue')) AS n FROM part),
g AS (SELECT p_partkey, list_contains({NAME_TOKENS}, 'red') AS p, contains(lower(p_name), 'red') AND contains(lower(p_name), 'blue') AS n FROM part),
c AS (SELECT count(*) FILTER (p) AS np, count(*) FILTER (n) AS nn FROM g)
SELECT p_partkey FROM g, c WHERE CASE WHEN np = 0 OR nn > np THEN n ELSE p END""")
def effective_bool(spark, sf_dir):
    return match(table(spark, sf_dir, "part"), {"bool": {"must": [{"match": {"p_name": "red"}}], "should": [{"match": {"p_name": "blue"}}]}}, "effective", "p_partkey")


def _with_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("info"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(twin("orders", "o_orderkey", "contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'F'"))
def nested_struct(spark, sf_dir):
    q = {"nested": {"path": "info", "query": {"bool": {"must": [{"match": {"info.priority": "urgent"}}, {"term": {"status": "F"}}]}}}}
    return match(_with_lines(spark, sf_dir), q, "scan", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND contains(lower(l_returnflag), 'r') AND l_quantity >= 45)")
def nested_array(spark, sf_dir):
    q = {"nested": {"path": "lines", "query": {"bool": {"must": [{"match": {"flag": "R"}}, {"range": {"quantity": {"gte": 45}}}]}}}}
    return match(_with_lines(spark, sf_dir), q, "scan", "o_orderkey")


# analyzers


def _analyzed(spark, sf_dir, analyzer: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(analysis.analyze("text", analyzer)).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def _unnested(tokens: str) -> str:
    return f"SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {tokens} AS w FROM documents))"


@query(_unnested(DOC_TOKENS))
def analyzer_standard(spark, sf_dir):
    return _analyzed(spark, sf_dir, "standard")


@query(_unnested(DOC_TOKENS.replace("length(t) > 1", "length(t) > 0")))
def analyzer_simple(spark, sf_dir):
    return _analyzed(spark, sf_dir, "simple")


@query(_unnested(r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: length(t) > 0)"))
def analyzer_whitespace(spark, sf_dir):
    return _analyzed(spark, sf_dir, "whitespace")


@query("SELECT doc_id, 0 AS pos, trim(text) AS token FROM documents WHERE trim(text) <> ''")
def analyzer_keyword(spark, sf_dir):
    return _analyzed(spark, sf_dir, "keyword")


@query(_unnested(r"list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_](?:[a-zA-Z0-9_''\-]*[a-zA-Z0-9_])?'), lambda t: lower(t)), lambda t: length(t) > 1)"))
def analyzer_pattern(spark, sf_dir):
    return _analyzed(spark, sf_dir, "pattern")


@query(r"""
WITH a AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z|]{2,}\b')) AS m FROM documents),
p AS (SELECT doc_id, m AS token FROM a UNION ALL SELECT doc_id, split_part(m, '@', 1) FROM a UNION ALL SELECT doc_id, split_part(m, '@', 2) FROM a
  UNION ALL SELECT doc_id, unnest(string_split(split_part(m, '@', 2), '.')) FROM a)
SELECT doc_id, token, count(*) AS n FROM p WHERE length(token) > 1 GROUP BY doc_id, token""")
def analyzer_email(spark, sf_dir):
    return _analyzed(spark, sf_dir, "email").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(r"""
WITH u AS (SELECT page_id, lower(url) AS u, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS h, regexp_extract(lower(url), '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages),
t AS (SELECT page_id, u AS token FROM u UNION ALL SELECT page_id, h FROM u UNION ALL
  SELECT page_id, token FROM (SELECT page_id, unnest(list_concat(string_split(h, '.'), string_split(p, '/'))) AS token FROM u) WHERE length(token) > 1)
SELECT page_id, token, count(*) AS n FROM t GROUP BY page_id, token""")
def analyzer_url(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(analysis.url("url")).alias("token"))
    return p.groupBy("page_id", "token").agg(F.count("*").alias("n"))


@query(r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[+]\d{1,3}[\s.\-]?)?(?:\d{3}|\(\d{3}\))[\s.\-]?\d{3}[\s.\-]?\d{4}')) AS m FROM documents),
d AS (SELECT doc_id, m, right(regexp_replace(m, '[^0-9]', '', 'g'), 10) AS t, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM m),
p AS (SELECT doc_id, unnest([m, d, substring(t, 1, 3), substring(t, 4, 3), substring(t, 7, 4)]) AS token FROM d)
SELECT DISTINCT doc_id, token FROM p
UNION SELECT doc_id, trim(text) FROM documents WHERE regexp_full_match(trim(text), '[0-9]{3,4}')""")
def analyzer_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(analysis.phone("text")).alias("token"))


@query()
def analyzer_advanced(spark, sf_dir):
    return _analyzed(spark, sf_dir, "advanced")


@query()
def analyzer_stemming(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    tokens = d.select("doc_id", F.posexplode(analysis.standard("text")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    return tokens.join(stemming.stem_vocabulary(tokens), "token").select("doc_id", "pos", "stem")


@query("SELECT doc_id, w[i] AS token, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^a-zA-Z0-9_]+', ' ', 'g'), ' '), lambda t: length(t) BETWEEN 3 AND 5 AND NOT list_contains(['the', 'and'], t)) AS w FROM documents))")
def analyzer_custom(spark, sf_dir):
    options = analysis.CustomOptions(lowercase=False, min_length=3, max_length=5)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(analysis.custom("text", ["the", "and"], options)).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({DOC_TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 500")
def stopword_autodetect(spark, sf_dir):
    return analysis.frequent_terms(table(spark, sf_dir, "documents"), "text", 500)


@query("WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents), n AS (SELECT doc_id, "
    + ", ".join(f"len(list_filter(w, lambda t: list_contains({own.split()}, t))) AS {lang}" for lang, own in sorted(stemming.PROFILES.items()))
    + " FROM w) SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'en' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS guess FROM n")
def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", stemming.guess_language(F.col("text")).alias("guess"))


# index


_PLACES = f"SELECT doc_id, w[i] AS token, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents))"


@query(f"SELECT 'text' AS field, token, doc_id, CAST(count(*) AS INT) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM ({_PLACES}) GROUP BY token, doc_id")
def postings_build(spark, sf_dir):
    p = postings.build(table(spark, sf_dir, "documents"), "doc_id", fields=["text"])
    return p.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"SELECT 'text' AS field, token, count(DISTINCT doc_id) AS df FROM ({_PLACES}) GROUP BY token")
def doc_freq(spark, sf_dir):
    return postings.document_frequency(postings.pairs(table(spark, sf_dir, "documents"), "doc_id", fields=["text"]))


@query(f"SELECT doc_id, CAST(count(*) AS INT) AS tf FROM ({_PLACES}) WHERE token = 'the' GROUP BY doc_id")
def term_freq(spark, sf_dir):
    p = postings.build(table(spark, sf_dir, "documents"), "doc_id", ["The"], fields=["text"])
    return postings.term_frequency(postings.lookup(p, "text", "The")).select("doc_id", "tf")


@query(f"SELECT doc_id, len({DOC_TOKENS}) AS dl FROM documents")
def doc_length(spark, sf_dir):
    return postings.doc_stats(table(spark, sf_dir, "documents"), "doc_id", fields=["text"])


@query(f"SELECT DISTINCT token FROM ({_PLACES}) WHERE starts_with(token, 'anth')")
def vocabulary_prefix(spark, sf_dir):
    p = postings.pairs(table(spark, sf_dir, "documents"), "doc_id", fields=["text"])
    return postings.vocabulary(p, "text").where(F.startswith("token", F.lit("anth"))).select("token")


@query(f"SELECT token, doc_id FROM ({_PLACES}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de') GROUP BY token, doc_id")
def postings_delete(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = postings.pairs(d, "doc_id", fields=["text"])
    return postings.without(p, d.where("lang <> 'de'").select("doc_id")).select("token", "doc_id")


@query("""
WITH h AS (SELECT list_reduce(list_concat([0::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM documents)
SELECT CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 8 AS INT) AS shard, count(*) AS n FROM h GROUP BY ALL""")
def shard_distribution(spark, sf_dir):
    return postings.shard_distribution(table(spark, sf_dir, "documents"), "doc_id", 8)


# relevance

_BM25 = f"""
WITH t AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
o AS (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM t),
p AS (SELECT doc_id, dl, token, count(*) AS tf FROM o WHERE token IN ('thand', 'heing', 'antion') GROUP BY ALL),
d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM p JOIN d USING (token), c GROUP BY doc_id)"""


def _bm25(spark, sf_dir):
    d, tokens = table(spark, sf_dir, "documents"), ["thand", "heing", "antion"]
    return scoring.bm25(postings.build(d, "doc_id", tokens, fields=["text"]), postings.doc_stats(d, "doc_id", fields=["text"]), tokens)


@query(_BM25 + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    s = _bm25(spark, sf_dir).withColumn("score", F.round("score", 6))
    return scoring.page(scoring.ranked(s), 0, 20)


@query(_BM25 + " SELECT doc_id, round(score, 6) AS score FROM s")
def bm25_scores(spark, sf_dir):
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_BM25 + " SELECT doc_id, round(score / (SELECT max(score) FROM s), 6) AS score FROM s")
def score_normalize(spark, sf_dir):
    return scoring.normalized(_bm25(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(r"""
SELECT doc_id, greatest(1, len(regexp_extract_all(' ' || replace(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' ', '  ') || ' ', ' the '))
 + len(regexp_extract_all(' ' || replace(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' ', '  ') || ' ', ' of '))) AS score
FROM documents ORDER BY score DESC, doc_id LIMIT 20""")
def tf_topk(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # line breaks are escaped in JSON, where they would join the next word
    clean = d.select("doc_id", F.regexp_replace("text", r"\s", " ").alias("text"))
    s = clean.select("doc_id", scoring.term_counts(clean, ["the", "of"], ["text"]).cast("long").alias("score"))
    return scoring.page(scoring.ranked(s), 0, 20)


@query(f"SELECT doc_id, round(CASE WHEN len(w) > 0 THEN (len(list_filter(w, lambda t: contains(t, 'the') OR contains('the', t))) + len(list_filter(w, lambda t: contains(t, 'ation') OR contains('ation', t)))) / len(w) / 2 ELSE 0 END, 6) AS score FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents)")
def overlap_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", analysis.standard("text").alias("w"))
    return d.select("doc_id", F.round(scoring.overlap_score(F.col("w"), ["the", "ation"]), 6).alias("score"))


@query("""
WITH b AS (SELECT user_id, event_type AS doc_id, count(*) AS boost FROM events GROUP BY ALL),
s AS (SELECT event_type AS doc_id, round(avg(value), 6) AS score FROM events GROUP BY event_type)
SELECT s.doc_id, round(s.score + coalesce(b.boost, 0), 4) AS score FROM s LEFT JOIN b ON s.doc_id = b.doc_id AND b.user_id = (SELECT min(user_id) FROM events)""")
def personalized_scores(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user = events.agg(F.min("user_id")).first()[0]
    s = events.groupBy(F.col("event_type").alias("doc_id")).agg(F.round(F.avg("value"), 6).alias("score"))
    return scoring.personalized(s, scoring.user_boosts(events, doc_col="event_type"), user).withColumn("score", F.round("score", 4))


@query("SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_docs, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags, max(ts) AS last_activity FROM events GROUP BY user_id")
def user_profiles(spark, sf_dir):
    p = scoring.profiles(table(spark, sf_dir, "events"), doc_col="event_type", tag_col="event_type", time_col="ts")
    return p.withColumn("tags", F.array_join("tags", ","))


# aggregations


@query("SELECT source AS key, count(*) AS doc_count FROM documents WHERE contains(lower(text), 'the') GROUP BY source ORDER BY doc_count DESC, key LIMIT 10")
def terms_agg(spark, sf_dir):
    return agg.terms(matching(table(spark, sf_dir, "documents"), {"match": {"text": "the"}}, "scan", id_col="doc_id"), "source")


@query("SELECT 0 AS doc_count_error_upper_bound, greatest(0, count(DISTINCT source) - 10) AS sum_other_doc_count FROM documents")
def terms_agg_other(spark, sf_dir):
    return agg.terms_other(table(spark, sf_dir, "documents"), "source")


@query("SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS doc_count FROM part GROUP BY p_size HAVING count(*) >= 40 ORDER BY doc_count DESC, key LIMIT 5")
def terms_agg_minimum(spark, sf_dir):
    return agg.terms(table(spark, sf_dir, "part"), "p_size", 5, 40)


@query("SELECT key, count(*) AS doc_count FROM (SELECT unnest(string_split(p_name, ' ')) AS key FROM part) GROUP BY key ORDER BY doc_count DESC, key LIMIT 10")
def terms_array(spark, sf_dir):
    return agg.terms(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words")), "words")


@query("SELECT floor(o_totalprice / 50000) * 50000 AS key, count(*) AS doc_count FROM orders GROUP BY ALL")
def histogram(spark, sf_dir):
    return agg.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 50_000)


def _dates(source: str, column: str, width: int) -> str:
    return f"SELECT strftime(make_timestamp(CAST(floor(epoch_ms({column}) / {width}) * {width} AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS key, count(*) AS doc_count FROM {source} GROUP BY ALL"


def _date_query(source: str, column: str, interval: str) -> Query:
    return lambda spark, sf_dir: agg.date_histogram(table(spark, sf_dir, source), column, interval)


for _name, _source, _column in (("1h", "events", "ts"), ("1d", "events", "ts"), ("1w", "orders", "o_orderdate"), ("1M", "orders", "o_orderdate"), ("1y", "orders", "o_orderdate")):
    _key = "date_histogram_" + {"1M": "30d", "1y": "365d"}.get(_name, _name)
    QUERIES[_key] = _date_query(_source, _column, _name)
    ORACLE_SQL[_key] = _dates(_source, _column, agg.MILLIS[_name])


@query("""
SELECT 0 AS position, '*-10' AS key, CAST(NULL AS DOUBLE) AS "from", CAST(10 AS DOUBLE) AS "to", count(*) FILTER (l_quantity < 10) AS doc_count FROM lineitem
UNION ALL SELECT 1, '5-25', 5, 25, count(*) FILTER (l_quantity >= 5 AND l_quantity < 25) FROM lineitem
UNION ALL SELECT 2, 'many', 25, NULL, count(*) FILTER (l_quantity >= 25) FROM lineitem
UNION ALL SELECT 3, '1000-2000', 1000, 2000, count(*) FILTER (l_quantity >= 1000 AND l_quantity < 2000) FROM lineitem""")
def range_agg(spark, sf_dir):
    return agg.range_buckets(table(spark, sf_dir, "lineitem"), "l_quantity", [{"to": 10}, {"from": 5, "to": 25}, {"from": 25, "key": "many"}, {"from": 1000, "to": 2000}])


def _flat(result: dict, path: str = "") -> DataFrame:
    parts = []
    for k, v in result.items():
        own = f"{path}{k}"
        if isinstance(v, dict):
            parts.append(_flat(v, own + "."))
        elif k == "doc_count":
            parts.append(v.select(F.lit(path.rstrip(".")).alias("agg"), F.lit("").alias("key"), "doc_count"))
        else:
            parts.append(v.select(F.lit(own).alias("agg"), F.col("key").cast("string").alias("key"), "doc_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("""
SELECT 'all' AS agg, '' AS key, count(*) AS doc_count FROM documents UNION ALL SELECT 'all.langs', lang, count(*) FROM documents GROUP BY lang""")
def global_agg(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    m = matching(d, {"term": {"lang": "fr"}}, "scan", id_col="doc_id")
    return _flat(agg.aggregate(m, {"all": {"global": {}, "aggs": {"langs": {"terms": {"field": "lang"}}}}}, d))


@query("""
WITH f AS (SELECT * FROM documents WHERE n_chars >= 1000 AND n_chars < 3000)
SELECT 'mid' AS agg, '' AS key, count(*) AS doc_count FROM f UNION ALL SELECT 'mid.langs', lang, count(*) FROM f GROUP BY lang
UNION ALL SELECT 'mid.de', '', count(*) FROM f WHERE lang = 'de'""")
def filter_agg(spark, sf_dir):
    spec = {"mid": {"filter": {"range": {"n_chars": {"gte": 1000, "lt": 3000}}}, "aggs": {"langs": {"terms": {"field": "lang"}}, "de": {"filter": {"term": {"lang": "de"}}}}}}
    return _flat(agg.aggregate(table(spark, sf_dir, "documents"), spec))


@query("""
SELECT 'info' AS agg, '' AS key, count(*) AS doc_count FROM orders
UNION ALL SELECT 'info.p', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def nested_agg(spark, sf_dir):
    return _flat(agg.aggregate(_with_lines(spark, sf_dir), {"info": {"nested": {"path": "info"}, "aggs": {"p": {"terms": {"field": "priority"}}}}}))


@query("""
SELECT 'c_mktsegment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL""")
def facets(spark, sf_dir):
    return agg.facets(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def auto_facets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return agg.facets(orders, agg.facet_fields(orders))


@query("SELECT CAST(n AS VARCHAR) AS key, count(*) AS doc_count FROM (SELECT s_nationkey AS n FROM supplier UNION ALL SELECT c_nationkey FROM customer) WHERE n <> 0 GROUP BY n")
def multi_index_merge(spark, sf_dir):
    def counts(name, column):
        return agg.terms(table(spark, sf_dir, name), column, 1_000_000)

    return agg.merged(counts("supplier", "s_nationkey"), counts("customer", "c_nationkey"))


# pages, sorting, rows, stores


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return scoring.page(o.orderBy(F.desc("o_totalprice"), "o_orderkey"), 20, 10).select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE contains(lower(o_orderpriority), 'urgent') ORDER BY o_orderdate, o_orderkey LIMIT 25")
def sort_field(spark, sf_dir):
    m = matching(table(spark, sf_dir, "orders"), {"match": {"o_orderpriority": "urgent"}}, "scan", id_col="o_orderkey")
    return m.orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query("SELECT count(*) AS total FROM orders WHERE contains(lower(o_orderpriority), 'urgent')")
def total(spark, sf_dir):
    return matching(table(spark, sf_dir, "orders"), {"match": {"o_orderpriority": "urgent"}}, "scan", id_col="o_orderkey").agg(F.count("*").alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def upsert_latest(spark, sf_dir):
    return rows.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(twin("customer", "c_custkey", "lower(c_mktsegment) IN ('building', 'machinery')"))
def filter_in_strings(spark, sf_dir):
    return match(table(spark, sf_dir, "customer"), dsl.filter_to_query("c_mktsegment", ["BUILDING", "machinery"], "in"), "scan", "c_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 40 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_size > 40")
def upsert_replace(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return rows.upsert(p, p.where("p_size > 40").withColumn("p_size", F.col("p_size") + 100), ["p_partkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_docs(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return rows.delete(table(spark, sf_dir, "orders"), gone, ["o_orderkey"]).select("o_orderkey")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def dedup_insert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    return rows.insert_new(c.where("c_nationkey < 10").distinct(), c, ["c_mktsegment", "c_nationkey"])


@query("""
SELECT o_custkey AS doc_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def id_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    return rows.intersect_ids(o.where("o_orderstatus = 'F'").select("doc_id"), o.where("o_orderstatus = 'O'"))


@query("""
SELECT o_custkey AS doc_id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def id_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    return rows.subtract_ids(o.where("o_orderstatus = 'F'").select("doc_id"), o.where("o_orderstatus = 'P'"))


@query("""
SELECT o_custkey AS doc_id FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def id_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id").select("doc_id", "o_orderstatus")
    return rows.union_ids(*(o.where(F.col("o_orderstatus") == s).select("doc_id") for s in "FP"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7 ORDER BY c_custkey LIMIT 10 OFFSET 2")
def store_find(spark, sf_dir):
    return find(table(spark, sf_dir, "customer"), "c_custkey", equal={"c_mktsegment": "BUILDING", "c_nationkey": 7}, offset=2, limit=10).select("c_custkey", "c_name")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def store_count(spark, sf_dir):
    return find(table(spark, sf_dir, "customer"), "c_custkey", equal={"c_mktsegment": "BUILDING"}).agg(F.count("*").alias("n"))


@query("SELECT page_id, substring(trim(html), 1, 10000) AS html FROM pages")
def trimmed_documents(spark, sf_dir):
    return rows.trimmed(table(spark, sf_dir, "pages")).select("page_id", "html")


@query()
def infer_mapping(spark, sf_dir):
    found = mapping.infer_mapping(table(spark, sf_dir, "documents"), "doc_id")
    return spark.createDataFrame(sorted(found.items()), "path string, type string")


@query("SELECT page_id, 'url' AS errors FROM pages WHERE NOT regexp_matches(regexp_replace(url, '^http:', ''), '^https?://.')")
def validate_documents(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("url", F.regexp_replace("url", "^http:", ""))
    bad = mapping.invalid_rows(pages, {"url": "url", "html": "text"}, "page_id")
    return bad.select("page_id", F.array_join("errors", ",").alias("errors"))
