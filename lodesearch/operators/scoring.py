"""Relevance."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dsl

K1, B = 1.2, 0.75


def bm25_term(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B, boost: float | Column = 1.0) -> Column:
    """One token's share of a document's score."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    length = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    score = boost * idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / length))
    return F.greatest(F.lit(0.0), score)


def bm25(postings: DataFrame, stats: DataFrame, tokens: Iterable[str], fields: Iterable[str] | None = None, k1: float = K1, b: float = B, boosts: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, score): documents that have any of the tokens.

    postings are filtered to the tokens first, so only their rows are joined; the corpus statistics are one row.
    stats: doc_id and dl.
    """
    tokens = sorted({t.lower() for t in tokens if t})
    rows = postings.where(F.col("token").isin(tokens))
    if fields is not None:
        rows = rows.where(F.col("field").isin(list(fields)))
    df = rows.groupBy("field", "token").agg(F.count("*").alias("df"))
    corpus = stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    boost = F.lit(1.0)
    for name, x in (boosts or {}).items():
        boost = F.when(F.col("field") == name, F.lit(float(x))).otherwise(boost)
    # one row for each token of the query and field, and one row: both of a size that doesn't depend on the corpus
    joined = rows.join(F.broadcast(df), ["field", "token"]).join(stats, "doc_id").crossJoin(F.broadcast(corpus))
    score = bm25_term(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"), k1, b, boost)
    return joined.groupBy("doc_id").agg(F.sum(score).alias("score"))


def query_tokens(node: dsl.Node) -> list[str]:
    """Standard tokens of the leaves that count for relevance, wild cards taken out."""
    words = [w for leaf in dsl.scoring_terms(node) for w in re.sub(r"\W+", " ", str(leaf.value).lower(), flags=re.ASCII).split() if len(w) > 1]
    return list(dict.fromkeys(words))


def term_counts(df: DataFrame, tokens: Iterable[str], columns: Iterable[str] | None = None) -> Column:
    """Whole-word occurrences of the tokens in the document as JSON, field names included; at least 1."""
    names = list(columns or df.columns)
    text = F.lower(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"}))
    total = F.lit(0)
    for t in tokens:
        word = re.sub(r"([^\w])", r"\\\1", t.lower(), flags=re.ASCII)
        total = total + F.regexp_count(text, F.lit(rf"(?<!\w){word}(?!\w)"))
    return F.greatest(F.lit(1), total)


def overlap_score(doc_tokens: Column, tokens: Iterable[str]) -> Column:
    """Mean over the query's tokens of the share of document tokens that contain one or are contained in it."""
    tokens = list(tokens)
    n = F.size(doc_tokens)
    total = F.lit(0.0)

    def overlaps(t: str):
        return lambda d: F.contains(d, F.lit(t)) | F.contains(F.lit(t), d)

    for t in tokens:
        total = total + F.size(F.filter(doc_tokens, overlaps(t)))
    return F.when(n > 0, total / n / max(1, len(tokens))).otherwise(F.lit(0.0))


def user_boosts(events: DataFrame, user_col: str = "user_id", doc_col: str = "doc_id") -> DataFrame:
    """(user_id, doc_id, boost): number of a user's events on a document."""
    return events.groupBy(F.col(user_col).alias("user_id"), F.col(doc_col).alias("doc_id")).agg(F.count("*").alias("boost"))


def personalized(scores: DataFrame, boosts: DataFrame, user) -> DataFrame:
    """(doc_id, score) with the user's boosts added."""
    own = boosts.where(F.col("user_id") == F.lit(user)).select("doc_id", "boost")
    return scores.join(own, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("boost", F.lit(0))).alias("score"))


def profiles(events: DataFrame, user_col: str = "user_id", doc_col: str = "doc_id", tag_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """One row a user: events, distinct documents, tags and the last activity."""
    more = [F.array_sort(F.collect_set(tag_col)).alias("tags")] if tag_col else []
    more += [F.max(time_col).alias("last_activity")] if time_col else []
    return events.groupBy(F.col(user_col).alias("user_id")).agg(F.count("*").alias("n_events"), F.count_distinct(doc_col).alias("n_docs"), *more)


def normalized(scores: DataFrame) -> DataFrame:
    """(doc_id, score) with scores as shares of the greatest. The maximum is an aggregate of one row, not a window over all."""
    top = scores.agg(F.max("score").alias("__top"))
    return scores.crossJoin(F.broadcast(top)).select("doc_id", (F.col("score") / F.col("__top")).alias("score"))


def ranked(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scores.orderBy(F.desc("score"), id_col)


def page(df: DataFrame, offset: int = 0, size: int | None = 10) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if size is None else df.limit(size)


def with_rank(scores: DataFrame, by: str) -> DataFrame:
    """rank within each value of `by`."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w))
