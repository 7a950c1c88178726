"""The operators of this subpackage applied to whole tables, by query name, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, lattice_lm, packing, quality, secrets, simhash, substring, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.blocked(pages, url_filter.listed_hosts(pages))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lattice_lm.score(docs, lattice_lm.train(docs))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outliers(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_language_id,
        op3_token_counts,
        op4_best_fit_packing,
        op5_lattice_likelihood,
        op6_benchmark_decontamination,
        op7_simhash_near_duplicates,
        op8_substring_repeats,
        op9_quality_rules,
        op10_secret_scan,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
WITH u AS (
  SELECT page_id, url,
    regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '') AS host,
    regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
hosts AS (SELECT DISTINCT host FROM u WHERE host <> ''),
entries AS (
  SELECT DISTINCT CASE WHEN len(string_split(host, '.')) > 3 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS entry
  FROM hosts
  WHERE list_has_any(string_split_regex(host, '[.\-]'), ['adult', 'ads', 'bets', 'casino', 'pills', 'spam'])),
probes AS (
  SELECT page_id, url, host, n AS k, host || array_to_string(string_split(path, '/')[1:n], '/') AS probe
  FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM u WHERE host <> '')
  UNION ALL
  SELECT page_id, url, host, -n AS k, array_to_string(string_split(host, '.')[n:], '.') AS probe
  FROM (SELECT *, unnest(range(2, len(string_split(host, '.')))) AS n FROM u WHERE host <> '')),
best AS (
  SELECT page_id, url, arg_max(probe, k) AS entry
  FROM probes JOIN entries ON probe = entries.entry GROUP BY page_id, url)
SELECT u.page_id, u.url, best.entry IS NOT NULL AS blocked, best.entry AS entry
FROM u LEFT JOIN best ON u.page_id = best.page_id AND u.url = best.url
""",
    "op8_substring_repeats": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, i AS p, array_to_string(w[i + 1:i + 50], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
marked AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY x) AS n, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM windows),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g
  FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM marked WHERE n > 1))
SELECT doc_id, min(p) AS start_word, max(p) + 50 - min(p) AS n_words, count(*) AS n_windows, count(*) FILTER (k > 1) AS n_later
FROM islands GROUP BY doc_id, g
""",
}
