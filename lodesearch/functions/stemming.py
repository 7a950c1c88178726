"""English stemming by the published Porter2 algorithm, in Arrow batches. Other languages' words pass unchanged."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    r1 = len(w)
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    else:
        if m := re.search(f"[{VOWELS}][^{VOWELS}]", w):
            r1 = m.end()
    m = re.search(f"[{VOWELS}][^{VOWELS}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _ends_short(w: str) -> bool:
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", w) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", w))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub("^y", "Y", w)
    w = re.sub(f"(?<=[{VOWELS}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].+$", w[:-1]) and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    # past forms
    for suffix in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if not w.endswith(suffix):
            continue
        base = w[: -len(suffix)]
        if suffix.startswith("eed"):
            if len(base) >= r1:
                w = base + "ee"
        elif re.search(f"[{VOWELS}]", base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif _ends_short(w) and r1 >= len(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for suffix, by in STEP2:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r1 and not (suffix == "ogi" and not base.endswith("l")) and not (suffix == "li" and base[-1:] not in tuple("cdeghkmnrt")):
                w = base + by
            break
    for suffix, by in STEP3:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= (r2 if suffix == "ative" else r1):
                w = base + by
            break
    for suffix in STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r2 and not (suffix == "ion" and base[-1:] not in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stem_all(tokens: Column) -> Column:
    """An array of tokens, each stemmed."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        known = {w: stem(w) for words in s if words is not None for w in set(words) if w is not None}
        return s.map(lambda words: None if words is None else [known.get(w) for w in words])

    return run(tokens)


def stem_vocabulary(tokens: DataFrame, column: str = "token") -> DataFrame:
    """(token, stem) of the distinct tokens, so that each is stemmed once however often it occurs."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else stem(w))

    return tokens.select(F.col(column).alias("token")).where("token is not null").distinct().withColumn("stem", run("token"))


#: Frequent words that tell languages apart, for texts whose language isn't known.
PROFILES = {
    "en": "the and of to in is that for with was", "fr": "le la les de et des un une pour dans", "de": "der die das und ist nicht ein eine mit zu", "es": "el la los de y que en un una por",
}


def guess_language(c: Column, default: str = "en") -> Column:
    """The language with the most of its frequent words in the text; ties by name, default if there are none."""
    words = F.split(F.lower(c), r"\P{L}+")
    def one_of(own: list[str]):
        return lambda t: t.isin(*own)

    counts = [F.struct(F.size(F.filter(words, one_of(own.split()))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, own) in enumerate(sorted(PROFILES.items()))]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["lang"]).otherwise(F.lit(default))
