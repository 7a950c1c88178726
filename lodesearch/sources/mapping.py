"""Field types: inference from data, validation, conversion to Spark types."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ("number", "integer", "float", "double", "long", "short", "byte")
TEXTUAL = ("text", "keyword", "email", "url", "phone")
TYPES = (*TEXTUAL, *NUMERIC, "boolean", "date", "geo_point", "object")
SPARK_TYPES = {
    **dict.fromkeys(TEXTUAL, T.StringType()), "number": T.DoubleType(), "integer": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "long": T.LongType(), "short": T.ShortType(), "byte": T.ByteType(), "boolean": T.BooleanType(), "date": T.TimestampType(),
    "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
}
#: A field whose name has one of these is text whatever its values look like.
TEXT_NAMES = "name title description content text summary city country address street location comment note message subject body caption label tag category".split()
EMAIL = r"^[\w.%+\-]+@[A-Za-z\d.\-]+[.][A-Za-z|]{2,}$"
URL = "^https?://."
DATE = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}.*)?$"
PHONE = r"^[+]?[1-9]\d{0,15}$"
NUMBER = r"^\s*[+-]?(?:\d+[.]?\d*|[.]\d+)(?:[eE][+-]?\d+)?\s*$"


def is_textual(t: str) -> bool:
    return t in TEXTUAL


def is_numeric(t: str) -> bool:
    return t in NUMERIC


def is_searchable(t: str) -> bool:
    return t in TEXTUAL or t == "boolean"


def is_aggregatable(t: str) -> bool:
    return t in NUMERIC or t in ("keyword", "boolean", "date")


def is_sortable(t: str) -> bool:
    return t in NUMERIC or t in ("keyword", "date")


def classify(c: Column, name: str) -> Column:
    """Type of a string value: by its form, then the field's name, then its length and number of words."""
    rest = F.lit("text") if any(n in name.lower() for n in TEXT_NAMES) else F.when((F.length(c) > 100) | F.trim(c).rlike(r"\S\s+\S"), "text").otherwise("keyword")
    return F.when(c.rlike(EMAIL), "email").when(c.rlike(URL), "url").when(c.rlike(DATE), "date").when(c.rlike(NUMBER), "number").otherwise(rest)


def _leaves(kind: T.DataType, c: Column, path: str):
    """(path, column or None, Spark type) of the fields in a type; arrays stand for their elements."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            yield path, None, kind
            for f in kind.elementType.fields:
                yield from _leaves(f.dataType, F.try_element_at(c, F.lit(1))[f.name], f"{path}.{f.name}")
        elif isinstance(kind.elementType, T.NumericType):
            yield path, F.size(c), kind
        else:
            yield path, F.try_element_at(c, F.lit(1)), kind.elementType
    elif isinstance(kind, T.StructType):
        yield path, None, kind
        if not {"lat", "lon"} <= set(kind.names):
            for f in kind.fields:
                yield from _leaves(f.dataType, c[f.name], f"{path}.{f.name}")
    else:
        yield path, c, kind


def infer_mapping(df: DataFrame, id_col: str = "id") -> dict[str, str]:
    """Type of each field by dotted path. One aggregate over the table: a string field has the class of its value of the least id.

    A field that is null everywhere gets no type. An array of exactly two numbers, in the row of the least id, is a point.
    """
    found = [(p, c, k) for f in df.schema.fields if f.name != id_col for p, c, k in _leaves(f.dataType, F.col(f"`{f.name}`"), f.name)]
    parts = []
    for n, (path, c, kind) in enumerate(found):
        if c is None:
            continue
        if isinstance(kind, T.StringType):
            value = F.when(c.isNotNull(), classify(c, path.rpartition(".")[2]))
        elif isinstance(kind, T.ArrayType):
            value = F.when(c == 2, "geo_point").when(c > 0, "number")
        else:
            value = F.when(c.isNotNull(), F.lit("x"))
        parts.append(F.min_by(value, F.when(value.isNotNull(), F.col(id_col))).alias(f"f{n}"))
    row = df.agg(*parts).first() if parts else {}
    out = {}
    for n, (path, c, kind) in enumerate(found):
        if isinstance(kind, T.StructType):
            out[path] = "geo_point" if {"lat", "lon"} <= set(kind.names) else "object"
        elif c is None:
            out[path] = "object"
        elif (value := row[f"f{n}"]) is not None:
            if isinstance(kind, (T.StringType, T.ArrayType)):
                out[path] = value
            elif isinstance(kind, T.BooleanType):
                out[path] = "boolean"
            elif isinstance(kind, T.NumericType):
                out[path] = "number"
            elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                out[path] = "date"
    return out


HINTS = {
    "keyword": ("id", "status", "type", "category", "classification"), "url": ("url", "website", "link", "href"), "email": ("email", "mail", "contact"), "phone": ("phone", "telephone", "mobile", "cell"),
}


def hinted_type(name: str) -> str | None:
    """The type that a field's name suggests to the indexer, if it isn't text."""
    low = name.lower()
    return next((t for t, words in HINTS.items() if any(w == low or (len(w) > 3 and w in low) for w in words)), None)


def valid(c: Column, field_type: str, kind: T.DataType) -> Column:
    """Whether a value is of a field type; null is."""
    ok = F.lit(True)
    if field_type in TEXTUAL:
        if not isinstance(kind, T.StringType):
            return c.isNull()
        if field_type == "email":
            ok = c.rlike(EMAIL)
        elif field_type == "url":
            ok = c.rlike(URL)
        elif field_type == "phone":
            ok = F.regexp_replace(c, r"[\s\-().]", "").rlike(PHONE)
    elif field_type in NUMERIC:
        ok = F.lit(isinstance(kind, T.NumericType))
    elif field_type == "boolean":
        ok = F.lit(isinstance(kind, T.BooleanType))
    elif field_type == "date":
        ok = F.try_to_timestamp(c).isNotNull() if isinstance(kind, T.StringType) else F.lit(isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)))
    elif field_type == "geo_point":
        if isinstance(kind, T.StructType) and {"lat", "lon"} <= set(kind.names):
            ok = c["lat"].between(-90, 90) & c["lon"].between(-180, 180)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            ok = (F.size(c) == 2) & c[0].between(-90, 90) & F.try_element_at(c, F.lit(2)).between(-180, 180)
        else:
            ok = F.lit(False)
    return c.isNull() | F.coalesce(ok, F.lit(False))


def invalid_rows(df: DataFrame, mapping: dict[str, str], id_col: str = "id") -> DataFrame:
    """(id, errors): rows without an id, or with fields that aren't of their type."""
    tests = [F.when(F.col(id_col).isNull() | (F.col(id_col).cast("string") == ""), F.lit(id_col))]
    for path, t in sorted(mapping.items()):
        if path in df.columns:
            tests.append(F.when(~valid(F.col(f"`{path}`"), t, df.schema[path].dataType), F.lit(path)))
    errors = F.filter(F.array(*tests), lambda e: e.isNotNull())
    return df.select(F.col(id_col), errors.alias("errors")).where(F.size("errors") > 0)


def check_name(kind: str, name: str) -> str:
    """A document id, field name or index name, if it is allowed."""
    rules = {"document": r"(?s).{1,255}", "field": r"[A-Za-z0-9._\-]{1,100}", "index": r"(?![_\-])[a-z0-9_\-]{1,255}"}
    if not name.strip() or not re.fullmatch(rules[kind], name):
        raise ValueError(f"no {kind} name: {name!r}")
    return name


def normal_index_name(name: str) -> str:
    return re.sub(r"^[_\-]+", "", re.sub(r"[^a-z0-9_\-]", "-", name.lower()))[:255]


@dataclass
class Mapping:
    """Types by dotted path. Types once set stay when more are inferred."""

    types: dict[str, str] = field(default_factory=dict)
    version: int = 1

    def set(self, path: str, field_type: str) -> None:
        if field_type not in TYPES:
            raise ValueError(f"unknown field type {field_type!r}")
        self.types[check_name("field", path)] = field_type
        self.version += 1

    def infer(self, df: DataFrame, id_col: str = "id") -> None:
        new = {k: v for k, v in infer_mapping(df, id_col).items() if k not in self.types}
        if new:
            self.types |= new
            self.version += 1

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "types": self.types}, sort_keys=True)

    @staticmethod
    def from_json(s: str) -> Mapping:
        d = json.loads(s)
        return Mapping(dict(d["types"]), d["version"])

    def schema(self, id_col: str = "id") -> T.StructType:
        """Spark schema of the top-level fields."""
        fields = [T.StructField(id_col, T.StringType(), False)]
        return T.StructType(fields + [T.StructField(p, SPARK_TYPES[t]) for p, t in sorted(self.types.items()) if "." not in p and t in SPARK_TYPES])
