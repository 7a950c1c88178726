"""Queries as boolean Columns over a documents DataFrame.

Four semantics. "scan" looks at whole field values (containment, case ignored). "index" looks at a field's tokens. "effective" takes
whichever of the two matches more documents, scan if index matches none. "equality" compares whole values, as the fallback evaluator
of a worker pool does. All are plain expressions: where a query needs to know something of the whole table (which set is
larger, whether mandatory clauses match anything) one row of aggregates is cross-joined.

Every predicate is null-safe: it is true or false, never null.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis, geo
from . import dsl

SEMANTICS = ("scan", "index", "effective", "equality")
STRINGS = (T.StringType, T.CharType, T.VarcharType)


def _any(columns: list[Column]) -> Column:
    """OR as a balanced tree, so that many clauses don't make a deep expression."""
    if not columns:
        return F.lit(False)
    while len(columns) > 1:
        columns = [reduce(operator.or_, columns[k : k + 2]) for k in range(0, len(columns), 2)]
    return columns[0]


def _every(columns: list[Column]) -> Column:
    if not columns:
        return F.lit(True)
    while len(columns) > 1:
        columns = [reduce(operator.and_, columns[k : k + 2]) for k in range(0, len(columns), 2)]
    return columns[0]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def within(a: Column, b: Column, k: int) -> Column:
    """Levenshtein distance of at most k; stops early beyond it."""
    return F.levenshtein(a, b, k) >= 0


def _within_of(word: str, k: int) -> Callable[[Column], Column]:
    """A lambda of one parameter; one with a default would be given an element's index."""
    return lambda t: within(t, F.lit(word), k)


def wildcard_regex(value: str, escape: bool = True) -> str:
    """An anchored Java regular expression for * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else (re.sub(r"([^\w])", r"\\\1", c, flags=re.ASCII) if escape else c) for c in value) + "$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside another lambda the expression itself would be evaluated for each element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def proximity(tokens: Column, phrase: list[str], slop: int = 0, fuzziness: int = 0) -> Column:
    """Whether the phrase's tokens follow each other in the array, each at the first place within reach, with gaps of at most slop."""
    if not phrase:
        return F.lit(True)
    if not slop and not fuzziness:
        mark = "\u0001"
        return F.contains(F.concat(F.lit(mark), F.array_join(tokens, mark), F.lit(mark)), F.lit(mark + mark.join(phrase) + mark))
    return let(tokens, lambda bound: _near(bound, phrase, slop, fuzziness))


def _near(tokens: Column, phrase: list[str], slop: int, fuzziness: int) -> Column:
    m, n = len(phrase), F.size(tokens)
    starts = F.when(n >= m, F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))

    def follow(i: Column) -> Column:
        state = F.struct((i - 1).cast("int").alias("last"), F.lit(0).cast("int").alias("gap"), F.lit(True).alias("ok"))
        words = F.array(*(F.struct(F.lit(j).cast("int").alias("j"), F.lit(p).alias("p")) for j, p in enumerate(phrase)))

        def step(s: Column, w: Column) -> Column:
            low = F.greatest(s["last"] + 1, i + w["j"])
            high = F.least(n, i + w["j"] + slop + fuzziness + 1)
            window = F.when(s["ok"] & (high > low), F.slice(tokens, low + 1, high - low)).otherwise(F.array().cast("array<string>"))
            if fuzziness:
                at = F.array_position(F.transform(window, lambda t: within(t, w["p"], fuzziness)), True)
            else:
                at = F.array_position(window, w["p"])
            place = (low + at - 1).cast("int")
            ok = s["ok"] & (at > 0)
            return F.struct(F.when(ok, place).otherwise(s["last"]).alias("last"), F.when(ok, F.greatest(s["gap"], (place - s["last"] - 1).cast("int"))).otherwise(s["gap"]).alias("gap"), ok.alias("ok"))

        return F.aggregate(words, state, step, lambda s: s["ok"] & (s["gap"] <= slop))

    found = F.exists(starts, follow)
    return found if fuzziness else _every([F.array_contains(tokens, p) for p in dict.fromkeys(phrase)]) & found


class Scope:
    """Where a query's field names are looked up: the table, or an element of a nested array."""

    def __init__(self, schema: T.StructType, get: Callable[[str], Column], mapping: dict[str, str] | None = None, id_col: str = "id", prefix: str = ""):
        self.schema, self.get, self.mapping, self.id_col, self.prefix = schema, get, mapping or {}, id_col, prefix

    def find(self, name: str) -> tuple[Column, T.DataType] | None:
        """Column and type of a field; a name with dots is first taken as it is, then as a path."""
        if self.prefix and name.startswith(self.prefix + "."):
            name = name[len(self.prefix) + 1 :]
        if name in self.schema.names:
            return self.get(name), self.schema[name].dataType
        head, *rest = name.split(".")
        if head not in self.schema.names:
            return None
        c, kind = self.get(head), self.schema[head].dataType
        for k, part in enumerate(rest):
            if isinstance(kind, T.StructType) and part in kind.names:
                c, kind = c[part], kind[part].dataType
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                path = rest[k:]
                element: T.DataType = kind.elementType
                for p in path:
                    if not isinstance(element, T.StructType) or p not in element.names:
                        return None
                    element = element[p].dataType
                return reduce(lambda x, p: x[p], path, c), T.ArrayType(element)
            else:
                return None
        return c, kind

    def texts(self, indexed: bool = False) -> list[str]:
        """Names of the string fields at the top; indexed: those of a type that is indexed."""
        names = [f.name for f in self.schema.fields if isinstance(f.dataType, STRINGS) and f.name != self.id_col and not f.name.startswith("__")]
        return [n for n in names if not indexed or self.type_of(n) in ("text", "keyword", "email", "url")]

    def type_of(self, name: str) -> str:
        return self.mapping.get(f"{self.prefix}.{name}" if self.prefix else name, "text")


class Compiler:
    """Compiles queries for one table. Facts on the whole table that a query needs are gathered in `facts`."""

    def __init__(self, df: DataFrame, mapping: dict[str, str] | None = None, id_col: str = "id", stopwords=(), synonyms: analysis.Synonyms | None = None, flag_minimum: bool = False):
        self.df = df
        self.scope = Scope(df.schema, lambda name: F.col(f"`{name}`"), mapping, id_col)
        self.stopwords, self.synonyms, self.flag_minimum = tuple(stopwords), synonyms, flag_minimum
        self.facts: list[Column] = []

    # leaves

    def _values(self, node: dsl.Leaf, scope: Scope, test: Callable[[Column, str], Column], indexed: bool = False) -> Column:
        """test over the named string field, any element of an array of strings, or any string field."""
        if node.field == "*":
            return _any([_sure(test(scope.get(n), n)) for n in scope.texts(indexed)])
        found = scope.find(node.field)
        if found is None:
            return F.lit(False)
        c, kind = found
        if isinstance(kind, STRINGS):
            return _sure(test(c, node.field))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, STRINGS):
            return _sure(F.exists(c, lambda e: _sure(test(e, node.field))))
        if isinstance(node, (dsl.Term, dsl.Match)):
            return self._typed(c, kind, node.value)
        return F.lit(False)

    @staticmethod
    def _typed(c: Column, kind: T.DataType, value) -> Column:
        """Equality on numbers, booleans, dates and arrays of them."""
        if isinstance(kind, T.ArrayType):
            return _sure(F.exists(c, lambda e: Compiler._typed(e, kind.elementType, value)))
        if isinstance(kind, T.BooleanType):
            if isinstance(value, str):
                value = {"true": True, "false": False}.get(value.lower())
            return _sure(c == F.lit(value)) if isinstance(value, bool) else F.lit(False)
        if isinstance(kind, T.NumericType):
            if isinstance(value, bool):
                return F.lit(False)
            if isinstance(value, str):
                try:
                    value = float(value)
                except ValueError:
                    return F.lit(False)
            return _sure(c == F.lit(value)) if isinstance(value, (int, float)) else F.lit(False)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return _sure(c == F.lit(value).cast(kind))
        return F.lit(False)

    def _scan_leaf(self, node: dsl.Leaf, scope: Scope) -> Column:
        v = str(node.value).lower()
        k = node.fuzziness if node.fuzziness is not None else (2 if isinstance(node, dsl.Fuzzy) else 0)
        if isinstance(node, dsl.Prefix):
            def test(c, _):
                hit = F.startswith(F.lower(c), F.lit(v))
                return hit | within(F.substring(F.lower(c), 1, len(v)), F.lit(v), k) if k else hit
        elif isinstance(node, dsl.Wildcard):
            bare = re.sub(r"[*?]", "", v)
            def test(c, _):
                hit = c.rlike("(?i)" + wildcard_regex(str(node.value)))
                return hit | within(F.substring(F.lower(c), 1, len(bare)), F.lit(bare), k) if k else hit
        elif isinstance(node, dsl.Phrase):
            words = [w for w in re.split(r"\W+", v, flags=re.ASCII)]
            def test(c, _):
                hit = F.contains(F.lower(c), F.lit(v))
                if not k:
                    return hit
                m = len(words)

                def near(tokens):
                    starts = F.when(F.size(tokens) >= m, F.sequence(F.lit(1), F.size(tokens) - m + 1)).otherwise(F.array().cast("array<int>"))
                    return F.exists(starts, lambda i: within(F.array_join(F.slice(tokens, i, m), " "), F.lit(v), k))

                return hit | let(F.split(F.lower(c), r"\W+"), near)
        elif k and node.field == "*":
            def test(c, _):
                return within(F.lower(c), F.lit(v), k)
        elif k:
            def test(c, _):
                tokens = F.split(F.lower(c), r"(?U)\s+")
                return _every([F.exists(tokens, _within_of(q, k)) for q in re.split(r"\s+", v)])
        else:
            def test(c, _):
                return F.contains(F.lower(c), F.lit(v))
        return self._values(node, scope, test)

    def _guarded(self, words: list[str], test: Callable[[Column, str], Column], scope: Scope) -> Callable[[Column, str], Column]:
        """test, for those texts only that contain one of the words somewhere, where the field's tokens are parts of its text."""

        def run(c: Column, name: str) -> Column:
            if scope.type_of(name) not in ("text", "keyword") or "phone" in name.lower():
                return test(c, name)
            return _any([F.contains(F.lower(c), F.lit(w)) for w in words]) & test(c, name)

        return run

    def _tokens(self, c: Column, name: str, scope: Scope) -> Column:
        return analysis.field_tokens(c, scope.type_of(name), name, self.stopwords)

    def _index_leaf(self, node: dsl.Leaf, scope: Scope) -> Column:
        v = str(node.value).lower()
        if isinstance(node, dsl.Phrase):
            words = [w for w in re.sub(r"\W+", " ", v, flags=re.ASCII).split() if len(w) > 1 and w not in self.stopwords]
            if not words:
                return F.lit(False)
            def test(c, _):
                return proximity(analysis.standard(c, self.stopwords), words, node.slop, node.fuzziness or 0)

            return self._values(node, scope, test if node.fuzziness else self._guarded([max(words, key=len)], test, scope), True)
        if isinstance(node, dsl.Prefix):
            return self._values(node, scope, self._guarded([v], lambda c, n: F.exists(self._tokens(c, n, scope), lambda t: F.startswith(t, F.lit(v))), scope), True)
        if isinstance(node, dsl.Wildcard):
            return self._values(node, scope, lambda c, n: F.exists(self._tokens(c, n, scope), lambda t: t.rlike(wildcard_regex(str(node.value), escape=False))), True)
        k = node.fuzziness if node.fuzziness is not None else (1 if isinstance(node, dsl.Fuzzy) else 0)
        words = [v, *(self.synonyms.get(v) if self.synonyms else ())]
        if k:
            return self._values(node, scope, lambda c, n: F.exists(self._tokens(c, n, scope), lambda t: within(t, F.lit(v), k) | t.isin(words)), True)
        return self._values(node, scope, self._guarded(words, lambda c, n: F.arrays_overlap(self._tokens(c, n, scope), F.array(*map(F.lit, words))), scope), True)

    def _equal_leaf(self, node: dsl.Leaf, scope: Scope) -> Column:
        found = scope.find(node.field)
        if found is None:
            return F.lit(False)
        c, v = F.lower(found[0].cast("string")), str(node.value).lower()
        if isinstance(node, dsl.Prefix):
            return _sure(F.startswith(c, F.lit(v)))
        if isinstance(node, dsl.Wildcard):
            return _sure(c.rlike(wildcard_regex(v, escape=False)[1:-1]))
        if isinstance(node, dsl.Fuzzy):
            return _sure(F.contains(c, F.lit(v)) | F.contains(F.lit(v), c))
        return _sure(c == v) if isinstance(node, (dsl.Term, dsl.Match)) else F.lit(True)

    def _range(self, node: dsl.Range, scope: Scope, lenient: bool) -> Column:
        found = scope.find(node.field)
        if found is None or (not lenient and isinstance(found[1], (T.StructType, T.ArrayType, T.MapType))):
            return F.lit(False)
        c, kind = found
        ops = {"gte": operator.ge, "gt": operator.gt, "lte": operator.le, "lt": operator.lt}
        tests = [c.isNotNull()]
        for name, bound in node.bounds().items():
            number = isinstance(bound, (int, float)) and not isinstance(bound, bool)
            if isinstance(kind, STRINGS) != (not number) and not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                # a number against a string compares as numbers; what is no number fails, or passes where the test is for exclusion
                a = c if isinstance(kind, T.NumericType) else c.try_cast("double")
                b = F.lit(float(bound)) if number else F.lit(bound).try_cast("double")
                tests.append(F.coalesce(ops[name](a, b), F.lit(lenient)))
            elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                tests.append(ops[name](c, F.lit(bound).cast(kind)))
            else:
                tests.append(ops[name](c, F.lit(bound)))
        return _sure(_every(tests))

    def _geo(self, node: dsl.GeoDistance, scope: Scope) -> Column:
        found = scope.find(node.field)
        if found is None or node.center is None:
            return F.lit(False)
        c, kind = found
        try:
            center, km = geo.parse_point(node.center), geo.parse_km(node.distance)
        except (ValueError, KeyError, TypeError):
            return F.lit(False)
        if isinstance(kind, T.StructType) and {"lat", "lon"} <= set(kind.names):
            lat, lon = c["lat"].cast("double"), c["lon"].cast("double")
        elif isinstance(kind, T.ArrayType):
            a, b = F.try_element_at(c, F.lit(1)).cast("double"), F.try_element_at(c, F.lit(2)).cast("double")
            swapped = (F.abs(a) > 90) | (F.abs(b) > 180)
            lat, lon = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
        else:
            return F.lit(False)
        valid = lat.between(-90, 90) & lon.between(-180, 180)
        return _sure(valid & geo.near(lat, lon, center, km))

    # compounds

    def _bool(self, node: dsl.Bool, scope: Scope, semantics: str) -> Column:
        part = {k: [self._node(c, scope, semantics) for c in getattr(node, k) or ()] for k in ("must", "should", "must_not", "filter")}
        mandatory = part["filter"] + part["must"]
        if node.should == () and not mandatory:
            return F.lit(False)
        some = _any(part["should"])
        enough = some
        if node.minimum_should_match > 1 and not self.flag_minimum:
            enough = reduce(operator.add, (c.cast("int") for c in part["should"])) >= node.minimum_should_match
        no = _any(part["must_not"])
        if semantics == "index":
            if mandatory:
                base = _every(mandatory)
                if part["should"]:
                    inside = base & enough if node.minimum_should_match else base
                    # where the mandatory clauses match no document at all, the should clauses stand in for them
                    base = F.when(self._fact(base), inside).otherwise(some)
            elif part["should"]:
                base = enough
            else:
                return F.lit(False)
            return base & ~no
        if semantics == "equality":
            base = _every(mandatory)
            if part["should"] and (node.minimum_should_match or not mandatory):
                base = base & enough
            return base & ~no
        optional = F.lit(True) if node.should is None else enough
        return _every(mandatory) & optional & ~no

    def _fact(self, c: Column) -> Column:
        """Whether c holds anywhere in the table."""
        self.facts.append(c)
        return F.col(f"__fact{len(self.facts) - 1}")

    def _nested(self, node: dsl.Nested, scope: Scope, semantics: str) -> Column:
        found = scope.find(node.path)
        if found is None:
            return F.lit(False)
        c, kind = found
        path = f"{scope.prefix}.{node.path}" if scope.prefix else node.path

        def inside(e: Column, kind: T.DataType) -> Column:
            if isinstance(kind, T.StructType):
                own = Scope(kind, lambda name: e[name], scope.mapping, "", path)
            else:
                own = Scope(T.StructType([T.StructField("value", kind)]), lambda name: e, scope.mapping, "", path)
            return self._node(node.query, own, semantics)

        if isinstance(kind, T.ArrayType):
            return _sure(F.exists(c, lambda e: inside(e, kind.elementType)))
        return _sure(c.isNotNull() & inside(c, kind))

    def _node(self, node: dsl.Node, scope: Scope, semantics: str) -> Column:
        if isinstance(node, dsl.MatchAll):
            return F.lit(True)
        if isinstance(node, dsl.MatchNone):
            return F.lit(False)
        if isinstance(node, dsl.Bool):
            return self._bool(node, scope, semantics)
        if isinstance(node, dsl.Range):
            return self._range(node, scope, semantics == "index")
        if isinstance(node, dsl.Exists):
            found = scope.find(node.field)
            return found[0].isNotNull() if found else F.lit(False)
        if isinstance(node, dsl.GeoDistance):
            return self._geo(node, scope)
        if isinstance(node, dsl.Nested):
            return self._nested(node, scope, semantics)
        if isinstance(node, dsl.Terms):
            found = scope.find(node.field)
            if found is None:
                return F.lit(False)
            if isinstance(found[1], STRINGS):
                return _sure(F.lower(found[0]).isin([str(v).lower() for v in node.values])) if node.values else F.lit(False)
            return _any([self._node(dsl.Term(node.field, v), scope, semantics) for v in node.values])
        leaf = {"index": self._index_leaf, "equality": self._equal_leaf}.get(semantics, self._scan_leaf)
        return leaf(node, scope)

    def predicate(self, node: dsl.Node, semantics: str = "scan") -> Column:
        if semantics not in ("scan", "index", "equality"):
            raise ValueError(f"unknown semantics {semantics}")
        return self._node(node, self.scope, semantics)

    def string_scan(self, text: str, operator_: str = "and") -> Column:
        """A string query as a scan has it: its standard tokens, all or any of them, among the tokens of all string fields."""
        words = [w for w in re.sub(r"\W+", " ", text.lower(), flags=re.ASCII).split() if len(w) > 1]
        if not words:
            return F.lit(False)
        words += _phone_parts(text, words)
        fields = _all_strings(self.scope)
        if not fields:
            return F.lit(False)
        stop = analysis.SCAN_STOPWORDS
        tokens = F.flatten(F.array(*(F.coalesce(analysis.standard(c, stop), F.array().cast("array<string>")) for c, _ in fields)))
        phones = [F.array(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-().]", ""))) for c, name in fields if "phone" in name.lower()]
        tokens = F.concat(tokens, *phones) if phones else tokens
        hits = [F.array_contains(tokens, w) for w in words]
        return _sure(_any(hits) if operator_.lower() == "or" else _every(hits))


def _phone_parts(text: str, words: list[str]) -> list[str]:
    if not re.fullmatch(r"\d+", words[0], re.ASCII):
        return []
    bare, more = re.sub(r"[\s\-().]", "", text), []
    if bare != text:
        more.append(bare)
    if len(text) == 10:
        more += [text[:3], text[3:6], text[6:]]
    elif len(text) == 11 and text[0] == "1":
        more += [text[1:4], text[4:7], text[7:]]
    return more


def _all_strings(scope: Scope) -> list[tuple[Column, str]]:
    """(Column, name) of every string inside a document, those in structs and arrays too."""
    out: list[tuple[Column, str]] = []

    def walk(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, STRINGS):
            out.append((c, name))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c[f.name], f.dataType, f.name)
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, STRINGS):
                out.append((F.array_join(c, " "), name))
            elif isinstance(kind.elementType, T.StructType):
                for f in kind.elementType.fields:
                    walk(c[f.name], T.ArrayType(f.dataType), f.name)

    for f in scope.schema.fields:
        if f.name != scope.id_col and not f.name.startswith("__"):
            walk(scope.get(f.name), f.dataType, f.name)
    return out


def _with_facts(df: DataFrame, facts: list[Column]) -> DataFrame:
    for k, c in enumerate(facts):
        df = df.crossJoin(F.broadcast(df.agg(F.coalesce(F.max(c), F.lit(False)).alias(f"__fact{k}"))))
    return df


def matching(df: DataFrame, query, semantics: str = "effective", operator: str = "and", **options) -> DataFrame:
    """The rows of df that match. options: mapping, id_col, stopwords, synonyms, flag_minimum."""
    if semantics not in SEMANTICS:
        raise ValueError(f"unknown semantics {semantics}")
    names = df.columns
    compiler = Compiler(df, **options)
    node = dsl.parse(query, operator)
    if isinstance(node, dsl.MatchAll):
        return df
    text = query if isinstance(query, str) else None
    if semantics != "effective":
        p = compiler.string_scan(text, operator) if text is not None and semantics == "scan" else compiler.predicate(node, semantics)
        return _with_facts(df, compiler.facts).where(p).select(*(f"`{n}`" for n in names))
    p = compiler.predicate(node, "index")
    n = compiler.string_scan(text, operator) if text is not None else compiler.predicate(node, "scan")
    flagged = _with_facts(df, compiler.facts).withColumn("__p", p).withColumn("__n", n)
    counts = F.broadcast(flagged.agg(F.count_if("__p").alias("__np"), F.count_if("__n").alias("__nn")))
    chosen = F.when((F.col("__np") == 0) | (F.col("__nn") > F.col("__np")), F.col("__n")).otherwise(F.col("__p"))
    return flagged.crossJoin(counts).where(chosen).select(*(f"`{n}`" for n in names))
