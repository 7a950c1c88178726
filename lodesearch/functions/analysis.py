"""Analyzers as array<string> Columns. Word characters are ASCII letters, digits and the underscore; any other character separates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Left out of document tokens when a string query scans documents.
SCAN_STOPWORDS = frozenset("the a an and or but in on at to for of with by".split())
ANALYZERS = ("standard", "simple", "whitespace", "keyword", "pattern", "email", "url", "phone", "advanced", "stemming", "custom")

_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_GAP = r"[\s.\-]?"
_AREA = r"(?:\d{3}|\(\d{3}\))"
EMAIL = _EDGE + r"[\w.%+\-]+@[a-z\d.\-]+[.][a-z|]{2,}" + _EDGE
URL = r"https?://\S+"
PHONE = r"(?:[+]\d{1,3}" + _GAP + ")?" + _AREA + _GAP + r"\d{3}" + _GAP + r"\d{4}"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without(tokens: Column, stopwords: Iterable[str], least: int = 1, lower: bool = False) -> Column:
    words = sorted(stopwords)
    if not words:
        return F.filter(tokens, lambda t: F.length(t) >= least)
    stop = F.array(*map(F.lit, words))
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, F.lower(t) if lower else t))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _spaced(c: Column) -> Column:
    return F.split(c, r"\W+")


def standard(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Lower case; apostrophes inside words split them; tokens of one character are dropped."""
    c = F.lower(_column(c))
    spread = c
    for pattern, by in ((r"(\w+)'(\w+)", "$1 $2"), (r"(\w+)'s(?!\w)", "$1"), (r"(\w+)s'(?=\w)", "$1s")):
        spread = F.regexp_replace(spread, pattern, by)
    # three passes only for the texts that need them
    return _without(_spaced(F.when(F.contains(c, F.lit("'")), spread).otherwise(c)), stopwords, 2)


def simple(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Lower case; everything but word characters separates; one-character tokens stay."""
    return _without(_spaced(F.lower(_column(c))), stopwords)


def whitespace(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Runs of anything but white space, case kept; stopwords are compared in lower case."""
    return _without(F.split(_column(c), r"(?U)[\s﻿]+"), stopwords, lower=True)


def keyword(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """The whole text, trimmed, as one token; none if it is blank."""
    return F.filter(F.array(F.trim(_column(c))), lambda t: F.length(t) > 0)


def pattern(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Words with inner hyphens and apostrophes, of two characters or more, lower case."""
    words = F.transform(_all(_column(c), r"\w(?:[\w'\-]*\w)?"), F.lower)
    return _without(words, stopwords, 2)


def email(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Each address, its local part, its domain and the domain's parts."""

    def parts(a: Column) -> Column:
        local, domain = F.substring_index(a, "@", 1), F.substring_index(a, "@", -1)
        return F.concat(F.array(a), F.filter(F.concat(F.array(local, domain), F.split(domain, "[.]")), lambda t: F.length(t) > 1))

    return _without(F.flatten(F.transform(_all(F.lower(_column(c)), EMAIL), parts)), stopwords)


def url(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Each URL in lower case, its host, the host's parts and the path's parts; queries are left out."""

    def parts(u: Column) -> Column:
        host = F.regexp_extract(u, r"^https?://(?:[^/?#]*@)?([^/?#:]+)", 1)
        path = F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1)
        inner = F.filter(F.concat(F.split(host, "[.]"), F.split(path, "/")), lambda t: F.length(t) > 1)
        return F.concat(F.array(u), F.filter(F.array(host), lambda t: t != ""), inner)

    found = F.transform(_all(_column(c), URL), F.lower)
    return _without(F.flatten(F.transform(found, parts)), stopwords)


def phone(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Each number as written, its digits, area code, exchange and last four; a bare group of 3 or 4 digits stands for itself."""
    c = _column(c)

    def parts(p: Column) -> Column:
        digits = F.regexp_replace(p, r"\D", "")
        ten = F.substring(F.right(digits, F.lit(10)), 1, 10)
        return F.array(p, digits, F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4))

    found = F.flatten(F.transform(_all(c, PHONE), parts))
    bare = F.when(F.trim(c).rlike(r"^\d{3,4}$"), F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(bare))


def advanced(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Distinct tokens of standard, email, url and phone, in that order."""
    return F.array_distinct(F.concat(*(f(c, stopwords) for f in (standard, email, url, phone))))


@dataclass(frozen=True)
class CustomOptions:
    lowercase: bool = True
    remove_stopwords: bool = True
    min_length: int = 1
    max_length: int | None = None
    custom_pattern: str | None = None


def custom(c: str | Column, stopwords: Iterable[str] = (), options: CustomOptions = CustomOptions()) -> Column:
    """Tokens by options: a pattern of one's own, or words of word characters within a range of lengths."""
    c = _column(c)
    if options.lowercase:
        c = F.lower(c)
    tokens = _all(c, options.custom_pattern) if options.custom_pattern else _spaced(c)
    most = options.max_length
    tokens = _without(tokens, stopwords if options.remove_stopwords else (), max(1, options.min_length))
    return F.filter(tokens, lambda t: F.length(t) <= most) if most is not None else tokens


def stemming(c: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """Standard tokens, stemmed in English."""
    from .stemming import stem_all

    return stem_all(standard(c, stopwords))


_BY_NAME: dict[str, Callable[..., Column]] = {
    "standard": standard, "simple": simple, "whitespace": whitespace, "keyword": keyword, "pattern": pattern, "email": email, "url": url, "phone": phone, "advanced": advanced, "stemming": stemming, "custom": custom,
}


def analyze(c: str | Column, analyzer: str = "standard", stopwords: Iterable[str] = ()) -> Column:
    """Tokens by the analyzer of that name; unknown names mean standard. Null texts give null."""
    return _BY_NAME.get(analyzer, standard)(c, stopwords)


FIELD_ANALYZERS = {"text": "standard", "keyword": "standard", "email": "email", "url": "url", "phone": "phone"}


def field_tokens(c: str | Column, field_type: str = "text", name: str = "", stopwords: Iterable[str] = ()) -> Column:
    """Index tokens of a field by its type; phone-named fields get their digits as one more token, URLs lose numbers."""
    tokens = analyze(c, FIELD_ANALYZERS.get(field_type, "standard"), stopwords)
    if field_type == "url":
        tokens = F.filter(tokens, lambda t: ~t.rlike(r"^\d+$"))
    if "phone" in name.lower():
        digits = F.regexp_replace(_column(c), r"[\s\-().]", "")
        tokens = F.concat(tokens, F.filter(F.array(F.lower(digits)), lambda t: t != ""))
    return F.transform(tokens, F.lower)


class Stopwords:
    """A set of stopwords, empty at first."""

    def __init__(self, words: Iterable[str] = ()):
        self.words = {w.lower() for w in words}

    def add(self, *words: str) -> None:
        self.words |= {w.lower() for w in words}

    def remove(self, *words: str) -> None:
        self.words -= {w.lower() for w in words}

    def has(self, word: str) -> bool:
        return word.lower() in self.words

    def clear(self) -> None:
        self.words.clear()

    def __iter__(self):
        return iter(sorted(self.words))

    def __len__(self):
        return len(self.words)


def frequent_terms(df: DataFrame, text: str | Column, threshold: int, analyzer: str = "standard") -> DataFrame:
    """(token, n): tokens that occur at least threshold times, candidates for stopwords."""
    return df.select(F.explode(analyze(text, analyzer)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


class Synonyms:
    """Directed synonyms in lower case."""

    def __init__(self, table: dict[str, Iterable[str]] | None = None):
        self.table: dict[str, list[str]] = {}
        for term, words in (table or {}).items():
            self.add(term, *words)

    def add(self, term: str, *words: str) -> None:
        own = self.table.setdefault(term.lower(), [])
        own += [w.lower() for w in dict.fromkeys(words) if w.lower() not in own]

    def get(self, term: str) -> list[str]:
        return list(self.table.get(term.lower(), []))

    def remove(self, term: str, word: str) -> None:
        own = self.table.get(term.lower(), [])
        if word.lower() in own:
            own.remove(word.lower())
            if not own:
                del self.table[term.lower()]

    def remove_key(self, term: str) -> None:
        self.table.pop(term.lower(), None)

    def clear(self) -> None:
        self.table.clear()

    def keys(self) -> list[str]:
        return list(self.table)

    @property
    def enabled(self) -> bool:
        return bool(self.table)

    def stats(self) -> dict[str, float]:
        n = sum(map(len, self.table.values()))
        return {"terms": len(self.table), "synonyms": n, "average": n / len(self.table) if self.table else 0.0}
