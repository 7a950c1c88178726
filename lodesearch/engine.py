"""Named indices of documents with search."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import Stopwords, Synonyms
from .operators import aggregations, postings, rows, scoring
from .plans import dsl
from .plans.predicates import matching
from .sources import mapping as mappings
from .sources.store import Files


@dataclass
class SearchResult:
    """A search's parts, all lazy: nothing runs before one is used."""

    hits: DataFrame
    matched: DataFrame
    offset: int = 0
    size: int | None = 10
    facets: DataFrame | None = None
    aggregations: dict[str, Any] = field(default_factory=dict)

    @cached_property
    def total(self) -> int:
        """Number of all matches, not of the page."""
        return self.matched.count()

    def has_more(self) -> bool:
        return self.size is not None and self.offset + self.size < self.total

    def max_score(self) -> float:
        return self.hits.agg(F.max("_score")).first()[0] or 0.0

    def to_dict(self) -> dict[str, Any]:
        hits = [r.asDict(True) for r in self.hits.collect()]
        out: dict[str, Any] = {"hits": hits, "total": self.total, "from": self.offset, "size": self.size}
        if self.facets is not None:
            own: dict[str, dict[str, int]] = {}
            for r in self.facets.collect():
                own.setdefault(r.field, {})[r.value] = r.n
            out["facets"] = own
        if self.aggregations:
            out["aggregations"] = {k: _plain(v) for k, v in self.aggregations.items()}
        return out


def _plain(agg: Any) -> Any:
    if isinstance(agg, dict):
        return {k: v.first()[0] if k == "doc_count" else _plain(v) for k, v in agg.items()}
    return {"buckets": [r.asDict(True) for r in agg.collect()]}


class Index:
    """One collection. Its postings and statistics are derived from the documents when they are needed."""

    def __init__(self, df: DataFrame | None = None, id_col: str = "id", mapping: Mapping[str, str] | None = None, facet_fields: Iterable[str] = ()):
        self.id_col = id_col
        self.mapping = mappings.Mapping(dict(mapping or {}))
        self.facet_fields = list(facet_fields)
        self.stopwords, self.synonyms = Stopwords(), Synonyms()
        self.documents: DataFrame | None = None
        self._postings: DataFrame | None = None
        self._stats: DataFrame | None = None
        self.stored = False
        if df is not None:
            self.add(df)

    def _changed(self, df: DataFrame) -> None:
        self.documents, self._postings, self._stats, self.stored = df, None, None, False

    def add(self, df: DataFrame) -> None:
        """Adds documents, or replaces those with their ids. Rows without an id are left out, of rows that repeat one, one is kept."""
        df = df.where(F.col(self.id_col).isNotNull()).dropDuplicates([self.id_col])
        self.mapping.infer(df, self.id_col)
        self._changed(df if self.documents is None else rows.upsert(self.documents, df, [self.id_col]))

    def delete(self, ids: Iterable[Any]) -> None:
        if self.documents is not None:
            self._changed(self.documents.where(~F.col(self.id_col).isin(list(ids))))

    def get(self, doc_id: Any) -> dict[str, Any] | None:
        row = None if self.documents is None else self.documents.where(F.col(self.id_col) == F.lit(doc_id)).first()
        return row.asDict(True) if row else None

    def count(self) -> int:
        return 0 if self.documents is None else self.documents.count()

    @property
    def postings(self) -> DataFrame:
        if self._postings is None:
            self._postings = self._built()
        return self._postings

    def _built(self, tokens: Iterable[str] | None = None) -> DataFrame:
        return postings.build(self.documents, self.id_col, tokens, mapping=self.mapping.types, stopwords=self.stopwords)

    @property
    def doc_stats(self) -> DataFrame:
        if self._stats is None:
            self._stats = postings.doc_stats(self.documents, self.id_col, mapping=self.mapping.types, stopwords=self.stopwords)
        return self._stats

    def save(self, path: str) -> None:
        """Stores documents, postings, lengths, mapping, facet fields, stopwords and synonyms in a new folder, and uses what is stored from then on."""
        spark = self.documents.sparkSession
        self.documents.write.parquet(f"{path}/documents")
        postings.write(self.postings, f"{path}/postings")
        self.doc_stats.write.parquet(f"{path}/lengths")
        meta = {"id_col": self.id_col, "mapping": self.mapping.types, "facet_fields": self.facet_fields, "stopwords": list(self.stopwords), "synonyms": self.synonyms.table}
        # written last: a folder without it is an index that was never whole
        Files(spark, path).write(f"{path}/index.json", json.dumps(meta))
        self._stored(spark, path)

    def _stored(self, spark: SparkSession, path: str) -> None:
        self.documents, self._postings, self._stats = (spark.read.parquet(f"{path}/{n}") for n in ("documents", "postings", "lengths"))
        self.stored = True

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """An index as save() stored it; nothing is analyzed again."""
        meta = json.loads(Files(spark, path).read(f"{path}/index.json"))
        own = cls(id_col=meta["id_col"], mapping=meta["mapping"], facet_fields=meta["facet_fields"])
        own.stopwords, own.synonyms = Stopwords(meta["stopwords"]), Synonyms(meta["synonyms"])
        own._stored(spark, path)
        return own

    def match(self, query: Any, semantics: str = "effective", operator: str = "and") -> DataFrame:
        """The documents that match. With stored postings, queries by index semantics that these can answer don't read texts."""
        if self.stored and semantics == "index":
            ids = postings.matching_ids(self.postings, dsl.parse(query, operator), tuple(self.stopwords), self.synonyms)
            if ids is not None:
                return self.documents.join(ids, self.documents[self.id_col] == ids["doc_id"], "left_semi")
        return matching(self.documents, query, semantics, operator, mapping=self.mapping.types, id_col=self.id_col, stopwords=tuple(self.stopwords), synonyms=self.synonyms)

    def scores(self, matched: DataFrame, node: dsl.Node, scorer: str, boosts: Mapping[str, float] | None = None) -> DataFrame:
        """matched with _score."""
        tokens = scoring.query_tokens(node)
        if scorer == "none" or not tokens:
            return matched.withColumn("_score", F.lit(1.0))
        if scorer == "tf":
            return matched.withColumn("_score", scoring.term_counts(matched, tokens).cast("double"))
        if scorer != "bm25":
            raise ValueError(f"unknown scorer {scorer}")
        s = scoring.bm25(self.postings if self.stored else self._built(tokens), self.doc_stats, tokens, boosts=dict(boosts or {}))
        return matched.join(s.select(F.col("doc_id").alias(self.id_col), F.col("score").alias("_score")), self.id_col, "left").withColumn("_score", F.coalesce("_score", F.lit(0.0)))

    def stats(self) -> dict[str, int]:
        return {"totalDocs": self.count(), "numTerms": self.postings.select("field", "token").distinct().count() if self.documents is not None else 0, "numFacets": len(self.facet_fields)}


class Engine:
    """A catalogue of indices. An unknown name means the default index."""

    def __init__(self, spark: SparkSession, default: str = "default", id_col: str = "id"):
        self.spark, self.default, self.id_col = spark, default, id_col
        self.indices: dict[str, Index] = {}

    def create_index(self, name: str, df: DataFrame | None = None, **options) -> Index:
        """The index of that name, made if there is none."""
        mappings.check_name("index", name)
        if name not in self.indices:
            self.indices[name] = Index(id_col=self.id_col, **options)
        if df is not None:
            self.indices[name].add(df)
        return self.indices[name]

    def index(self, name: str | None = None) -> Index:
        return self.indices.get(name or self.default) or self.create_index(self.default)

    def list_indices(self) -> list[str]:
        return sorted(self.indices)

    def delete_index(self, name: str) -> bool:
        return self.indices.pop(name, None) is not None

    def add(self, df: DataFrame, index: str | None = None) -> None:
        self.index(index).add(df)

    def delete(self, ids: Iterable[Any], index: str | None = None) -> None:
        self.index(index).delete(ids)

    def search(self, query: Any = None, index: str | None = None, offset: int = 0, size: int | None = 10, sort: Iterable[tuple[str, str]] = (), facet_fields: Iterable[str] | None = None, aggs: Mapping[str, Any] | None = None, semantics: str = "effective", operator: str = "and", scorer: str = "bm25", boosts: Mapping[str, float] | None = None, user_boosts: DataFrame | None = None, user: Any = None) -> SearchResult:
        """Hits by relevance, or by the given (field, "asc" or "desc"), then by id.

        user_boosts: user_id, doc_id and boost; the user's are added to the scores.
        """
        own = self.index(index)
        node = dsl.parse(query, operator)
        matched = own.match(query, semantics, operator)
        scored = own.scores(matched, node, scorer, boosts)
        if user_boosts is not None:
            mine = user_boosts.where(F.col("user_id") == F.lit(user)).select(F.col("doc_id").alias(own.id_col), F.col("boost").alias("_boost"))
            scored = scored.join(mine, own.id_col, "left").withColumn("_score", F.col("_score") + F.coalesce("_boost", F.lit(0))).drop("_boost")
        order = [F.col(f).desc_nulls_last() if o == "desc" else F.col(f).asc_nulls_last() for f, o in sort] or [F.desc("_score")]
        hits = scoring.page(scored.orderBy(*order, own.id_col), offset, size)
        fields = list(facet_fields if facet_fields is not None else own.facet_fields)
        return SearchResult(hits, matched, offset, size, aggregations.facets(matched, fields) if fields else None, aggregations.aggregate(matched, aggs, own.documents) if aggs else {})

    def search_all(self, query: Any = None, **options) -> DataFrame:
        """Hits of every index, with _index, by score."""
        size, offset = options.pop("size", 10), options.pop("offset", 0)
        parts = [self.search(query, n, size=None, **options).hits.withColumn("_index", F.lit(n)) for n in self.list_indices() if self.indices[n].documents is not None]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return scoring.page(both.orderBy(F.desc("_score"), "_index", self.id_col), offset, size)

    def facets(self, index: str | None = None, fields: Iterable[str] | None = None) -> DataFrame:
        own = self.index(index)
        return aggregations.facets(own.documents, list(fields) if fields is not None else own.facet_fields)

    def stats(self) -> dict[str, dict[str, int]]:
        return {n: i.stats() for n, i in self.indices.items()}

    def save(self, store, index: str | None = None) -> None:
        name = index or self.default
        store.put(name, self.index(index).documents)

    def load(self, store) -> None:
        """All of a store's indices."""
        for n in store.list_indexes():
            self.create_index(n, store.read(n))
