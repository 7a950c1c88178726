"""The inverted index as a table of (field, token, doc_id, tf, positions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis
from ..plans import dsl
from ..plans.predicates import STRINGS, wildcard_regex, within

INDEXED = ("text", "keyword", "email", "url")
#: Hash values by which repeated ids are marked; the marks take some MB at most.
BUCKETS = 1 << 18


def indexed_fields(schema: T.StructType, mapping: dict[str, str] | None = None, id_col: str = "id", nested: bool = True) -> list[tuple[str, Column]]:
    """(dotted name, array of texts) of the fields that are indexed. nested: those in structs and arrays too."""
    out: list[tuple[str, Column]] = []

    def add(name: str, texts: Column) -> None:
        if (mapping or {}).get(name, "text") in INDEXED:
            out.append((name, texts))

    def walk(c: Column, kind: T.DataType, name: str, top: bool) -> None:
        if isinstance(kind, STRINGS):
            add(name, F.array(c))
        elif not nested:
            return
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c[f.name], f.dataType, f"{name}.{f.name}", False)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, STRINGS):
            add(name, c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                walk(c[f.name], T.ArrayType(f.dataType), f"{name}.{f.name}", False)

    for f in schema.fields:
        if f.name != id_col and not f.name.startswith("_"):
            walk(F.col(f"`{f.name}`"), f.dataType, f.name, True)
    return out


def token_fields(df: DataFrame, id_col: str = "id", fields: Iterable[str] | None = None, mapping: dict[str, str] | None = None, stopwords: Iterable[str] = (), nested: bool = True) -> list[tuple[str, Column]]:
    """(dotted name, array of its tokens, empty if there are none) of each indexed field."""

    def tokens(name: str, texts: Column) -> Column:
        kind = (mapping or {}).get(name, "text")
        each = F.transform(texts, lambda t: F.coalesce(analysis.field_tokens(t, kind, name.rpartition(".")[2], stopwords), F.array().cast("array<string>")))
        return F.coalesce(F.flatten(each), F.array().cast("array<string>"))

    wanted = None if fields is None else set(fields)
    return [(n, tokens(n, c)) for n, c in indexed_fields(df.schema, mapping, id_col, nested) if wanted is None or n in wanted]


def _tokenized(df: DataFrame, chosen: list[tuple[str, Column]], id_col: str) -> DataFrame:
    """(doc_id, field, tokens): a row of each indexed field of each row."""
    parts = F.array(*(F.struct(F.lit(n).alias("field"), tokens.alias("tokens")) for n, tokens in chosen))
    return df.select(F.col(id_col).alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", F.col("p.field").alias("field"), F.col("p.tokens").alias("tokens"))


def occurrences(df: DataFrame, id_col: str = "id", **options) -> DataFrame:
    """(doc_id, field, token, pos): every token of every indexed field, by place."""
    chosen = token_fields(df, id_col, **options)
    if not chosen:
        return df.select(F.col(id_col).alias("doc_id"), F.lit("").alias("field"), F.lit("").alias("token"), F.lit(0).alias("pos")).limit(0)
    return _tokenized(df, chosen, id_col).select("doc_id", "field", F.posexplode("tokens").alias("pos", "token")).select("doc_id", "field", "token", "pos")


def _apart(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is theirs alone, and the others with a few of the former.

    Ids that repeat are marked by one of BUCKETS hash values, so that the marks can be broadcast at any size. Without any, nothing reads the others.
    """
    mark = F.pmod(F.xxhash64(F.col(id_col)), F.lit(BUCKETS))
    marks = df.groupBy(F.col(id_col).alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("_mark")).distinct()
    return tuple(df.join(F.broadcast(marks), mark == marks["_mark"], how) for how in ("left_anti", "left_semi"))


def _grouped(rows: DataFrame, words: list[str] | None) -> DataFrame:
    """(field, token, doc_id, tf, positions) of each row of (doc_id, field, tokens) alone, from its tokens in order."""
    placed = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    if words is not None:
        placed = F.filter(placed, lambda x: x["token"].isin(words))
    ordered = rows.select("doc_id", "field", F.sort_array(placed).alias("s"))
    n = F.size("s")
    first = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get("s", i)["token"] != F.get("s", i - 1)["token"]))
    starts = ordered.select("doc_id", "field", "s", first.alias("starts"))

    def posting(i: Column, k: Column) -> Column:
        own = F.slice("s", i + 1, F.coalesce(F.get("starts", k + 1), n) - i)
        return F.struct(F.get("s", i)["token"].alias("token"), F.transform(own, lambda x: x["pos"]).alias("positions"))

    out = starts.select("doc_id", "field", F.explode(F.transform("starts", posting)).alias("p"))
    return out.select("field", "p.token", "doc_id", F.size("p.positions").alias("tf"), "p.positions")


def build(df: DataFrame, id_col: str = "id", tokens: Iterable[str] | None = None, **options) -> DataFrame:
    """Postings, of the given tokens only if there are any given.

    A row is grouped alone, so its postings aren't shuffled; those of rows that share their id with others are added up by a shuffle.
    """
    chosen = token_fields(df, id_col, **options)
    if not chosen:
        return df.select(F.lit("").alias("field"), F.lit("").alias("token"), F.col(id_col).alias("doc_id"), F.lit(0).alias("tf"), F.array().cast("array<int>").alias("positions")).limit(0)
    words = None if tokens is None else sorted({t.lower() for t in tokens})
    alone, shared = (_grouped(_tokenized(part, chosen, id_col), words) for part in _apart(df, id_col))
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions"))))
    return alone.unionAll(shared.groupBy("field", "token", "doc_id").agg(F.sum("tf").cast("int").alias("tf"), places.alias("positions")))


def pairs(df: DataFrame, id_col: str = "id", **options) -> DataFrame:
    """(field, token, doc_id): the postings without their places, for what asks for none."""
    chosen = token_fields(df, id_col, **options)
    if not chosen:
        return build(df, id_col, **options).select("field", "token", "doc_id")
    alone, shared = (_tokenized(part, chosen, id_col).select("field", F.explode(F.array_distinct("tokens")).alias("token"), "doc_id") for part in _apart(df, id_col))
    return alone.unionAll(shared.distinct())


def doc_stats(df: DataFrame, id_col: str = "id", **options) -> DataFrame:
    """(doc_id, dl): number of tokens of each row, 0 for those without any. A row is counted alone, so nothing is shuffled."""
    parts = token_fields(df, id_col, **options)
    total = sum((F.size(tokens) for _, tokens in parts), F.lit(0))
    return df.select(F.col(id_col).alias("doc_id"), total.cast("long").alias("dl"))


def lookup(postings: DataFrame, field: str, token: str) -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("token") == token.lower()))


def positions(postings: DataFrame, field: str, token: str, doc_id) -> DataFrame:
    return lookup(postings, field, token).where(F.col("doc_id") == F.lit(doc_id)).select(F.explode("positions").alias("pos"))


def term_frequency(postings: DataFrame) -> DataFrame:
    """(field, token, doc_id, tf): by distinct positions."""
    return postings.select("field", "token", "doc_id", F.size("positions").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(field, token, df). Of a token, field and document there is one posting, so they are counted as they are."""
    return postings.groupBy("field", "token").agg(F.count("doc_id").alias("df"))


def vocabulary(postings: DataFrame, field: str | None = None) -> DataFrame:
    """(field, token): distinct tokens."""
    rows = postings if field is None else postings.where(F.col("field") == field)
    return rows.select("field", "token").distinct()


def without(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings of the documents that aren't in ids (doc_id)."""
    return postings.join(ids.select("doc_id"), "doc_id", "left_anti")


def expand(postings: DataFrame, field: str, value: str, kind: str = "term", fuzziness: int = 0) -> DataFrame:
    """(doc_id): documents by a test of the field's vocabulary rather than of their texts. kind: term, prefix, wildcard or fuzzy."""
    token, v = F.col("token"), value.lower()
    test = {
        "term": token == v,
        "prefix": F.startswith(token, F.lit(v)),
        "wildcard": token.rlike(wildcard_regex(value, escape=False)),
        "fuzzy": within(token, F.lit(v), fuzziness),
    }[kind]
    return postings.where((F.col("field") == field) & test).select("doc_id").distinct()


def write(postings: DataFrame, path: str) -> None:
    """Stores postings in order of field and token, so that a lookup reads only the row groups whose range holds the token."""
    postings.repartitionByRange(F.col("field"), F.col("token"), F.col("doc_id")).sortWithinPartitions("field", "token", "doc_id").write.parquet(path)


def matching_ids(postings: DataFrame, node: dsl.Node, stopwords: Iterable[str] = (), synonyms: analysis.Synonyms | None = None) -> DataFrame | None:
    """(doc_id) of the documents whose tokens match, from postings alone; None for a query that needs the documents.

    What can be looked up: terms, matches, fuzzy terms, prefixes and wildcards of one field, and boolean queries of these where no clause stands
    in for others (only must and filter, or only should of which one is enough, each with must_not).
    """
    if isinstance(node, dsl.Bool):
        every, some = [*(node.filter or ()), *(node.must or ())], node.should or ()
        if bool(every) == bool(some) or node.should == () or (some and node.minimum_should_match > 1):
            return None
        parts = [matching_ids(postings, c, stopwords, synonyms) for c in every or some]
        no = [matching_ids(postings, c, stopwords, synonyms) for c in node.must_not or ()]
        if any(p is None for p in [*parts, *no]):
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, "doc_id", "left_semi") if every else out.unionAll(p)
        for p in no:
            out = out.join(p, "doc_id", "left_anti")
        return out.distinct() if some else out
    if not isinstance(node, (dsl.Term, dsl.Match, dsl.Fuzzy, dsl.Prefix, dsl.Wildcard)) or node.field in ("*", "") or not isinstance(node.value, str):
        return None
    token, v = F.col("token"), node.value.lower()
    if isinstance(node, dsl.Prefix):
        test = F.startswith(token, F.lit(v))
    elif isinstance(node, dsl.Wildcard):
        test = token.rlike(wildcard_regex(node.value, escape=False))
    else:
        k = node.fuzziness if node.fuzziness is not None else (1 if isinstance(node, dsl.Fuzzy) else 0)
        words = [v, *(synonyms.get(v) if synonyms else ())]
        test = within(token, F.lit(v), k) | token.isin(words) if k else token.isin(words)
    return postings.where((F.col("field") == node.field) & test).select("doc_id").distinct()


def shard_of(id_col: str | Column, shards: int) -> Column:
    """Shard of a document: its id's characters as digits in base 31, in 32-bit arithmetic, by absolute value."""
    c = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    two32 = 1 << 32
    h = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + F.ascii(x), F.lit(two32)))
    signed = F.when(h >= two32 // 2, h - two32).otherwise(h)
    return F.pmod(F.abs(signed), F.lit(shards)).cast("int")


def shard_distribution(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    """(shard, n) with the documents of each shard that has any."""
    return df.groupBy(shard_of(id_col, shards).alias("shard")).agg(F.count("*").alias("n"))


def balance(distribution: DataFrame) -> DataFrame:
    """(shards, total, largest, smallest, ratio): how even the shards are."""
    return distribution.agg(F.count("*").alias("shards"), F.sum("n").alias("total"), F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.avg("n")).alias("ratio"))
