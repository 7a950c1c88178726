"""Documents of unusual composition: robust multivariate outliers within each language and source.

Each document gets a vector of transformed statistics: the square roots of the shares of symbols and capitals among its
characters and of short words and words that repeat the last one among its words, and the logarithm of the mean word length. The
shares of short texts are drawn to a usual one, for else few words would make any text unusual. For each
language and source the minimum covariance determinant estimate is found by concentration steps: from coordinatewise
medians and MADs, the h = coverage * n documents of least Mahalanobis distance give the next mean and covariance,
until no group's determinant falls below its least so far (by SETTLED of its logarithm; only the quantile's approximation can
raise it again, and `steps` bounds their number). Every step is one pass over all vectors of all groups: percentile_approx
for the h-th distance and plain sums for the moments, so a group may be of any size. The covariance is scaled so
that the median distance is that of a chi-square, and documents beyond `cutoff` of it are rejected.

Groups of fewer than `least` documents are judged by the estimate of all documents of their language, large sources
included, and those of languages of fewer by that of all documents; if even these are fewer, nothing is rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_type, materialise, release, sized
from .textscan import find_words, memo, pieces, text_bytes

STATS = ["symbols", "upper", "word_length", "short_words", "repeats"]
D = len(STATS)
COVERAGE = 0.75
#: Far beyond what is needed; groups settle after four to ten.
STEPS = 40
SETTLED = 1e-3
LEAST = 100
#: Share of a chi-square beyond which a document is rejected: about one in ten thousand million normal ones.
CUTOFF = 1e-10
RIDGE = 1e-3
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def byte_kinds() -> np.ndarray:
    """1 symbol, 2 upper-case letter."""
    t = np.zeros(256, np.uint8)
    t[33:48] = t[58:65] = t[91:97] = t[123:127] = 1
    for c in b".,;:'\"()-?":
        t[c] = 0
    t[65:91] = 2
    return t


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def vectors(data: np.ndarray, off: np.ndarray, i: int, j: int) -> np.ndarray:
    """Transformed statistics of documents i to j; data is as written, not lower-cased."""
    start, end, doc, h = find_words(data, off, i, j)
    x, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
    kinds = memo("byte_kinds", byte_kinds)[x]
    upper = kinds == 2
    upper[1:] |= (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
    chars = sums((x & 0xC0) != 0x80, o)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    n, short, length, again = (np.bincount(doc - i, w, minlength=j - i) for w in (None, end - start <= 3, end - start, same))

    def share(part, whole, usual, weight):
        return np.sqrt((part + usual * weight) / (whole + weight))

    return np.stack([share(sums(kinds == 1, o), chars, 0, 100), share(sums(upper, o), chars, 0.02, 100), np.log((length + 100.0) / (n + 20.0)), share(short, n, 0.4, 20), share(again, n, 0, 20)], 1)


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, lang, source, x0...): of rows with a non-null id and text."""
    kind = id_type(docs, id_col)

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(3), lower=False)
            out = [vectors(data, off, i, j) for i, j in pieces(off)]
            if out:
                v = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(v[:, k]) for k in range(D))], ["id", "lang", "source", *(f"x{k}" for k in range(D))])

    own = docs.select(F.col(id_col).cast(kind).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("t"))
    return own.where("id is not null and t is not null").mapInArrow(run, f"id {kind}, lang string, source string, " + ", ".join(f"x{k} double" for k in range(D)))


def chi_square(share_beyond: float, d: int) -> float:
    """The quantile of a chi-square with d degrees of freedom, by Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - share_beyond)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


def distance(center: str = "center", inverse: str = "inverse"):
    """Squared Mahalanobis distance of x0... from arrays of the group's center and upper inverse covariance."""
    x = [F.col(f"x{k}") - F.col(center)[k] for k in range(D)]
    terms = [x[i] * x[j] * F.col(inverse)[n] * (1 if i == j else 2) for n, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def estimates(moments: DataFrame) -> DataFrame:
    """(group, center, inverse, logarithm of the determinant) from n, sums and products of each group."""

    def run(batches):
        for b in batches:
            n, s, p = b.column(1).to_numpy(), np.array(b.column(2).to_pylist()).reshape(-1, D), np.array(b.column(3).to_pylist()).reshape(-1, len(PAIRS))
            centers, inverses, sizes = [], [], []
            for k in range(b.num_rows):
                m = s[k] / n[k]
                c = np.zeros((D, D))
                for q, (i, j) in enumerate(PAIRS):
                    c[i, j] = c[j, i] = p[k, q] / n[k] - m[i] * m[j]
                c += RIDGE * np.eye(D)
                inverse = np.linalg.inv(c)
                sizes.append(float(np.linalg.slogdet(c)[1]))
                centers.append(m.tolist())
                inverses.append([inverse[i, j] for i, j in PAIRS])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(centers, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64())), pa.array(sizes, pa.float64())], ["g", "center", "inverse", "size"])

    return moments.select("g", "n", "s", "p").mapInArrow(run, "g string, center array<double>, inverse array<double>, size double")


def outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", coverage: float = COVERAGE, steps: int = STEPS, least: int = LEAST, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, lang, source, n_group, distance, rejected): one row for each row with an id and a text.

    A null language or source is a group of its own, named by the empty string. Empty texts have a vector like others. distance
    is the scaled squared Mahalanobis distance, null where no estimate was possible; such rows aren't rejected. Ids keep their type.
    Repeated rows count as often as they occur. Texts of any length are read whole. An empty table gives an empty result. Other columns aren't read.
    """
    x = materialise(statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    sep = "\u0001"
    own = x.groupBy("lang", "source").agg(F.count("*").alias("n"))
    in_lang = own.groupBy("lang").agg(F.sum("n").alias("in_lang"))
    groups = own.join(in_lang, "lang").select(
        "lang", "source", F.when(F.col("n") >= least, F.concat(F.lit("s"), "lang", F.lit(sep), "source")).when(F.col("in_lang") >= least, F.concat(F.lit("l"), "lang")).otherwise(F.lit("a")).alias("g"), "n"
    )
    groups = materialise(groups, "groups")
    names = groups.count()
    # each estimate in use and the languages and sources it is of
    used = groups.select("g").distinct()
    any_of = F.array_distinct(F.array("g", F.concat(F.lit("l"), "lang"), F.lit("a")))
    members = groups.select("lang", "source", "n", F.explode(any_of).alias("g")).join(used, "g", "left_semi")
    members = materialise(members, "members")
    names_of = sized(members.groupBy("g").agg(F.sum("n").alias("n_group")), names, 100)
    judged = x.join(sized(groups, names, 200), ["lang", "source"])
    x = x.join(sized(members, 3 * names, 200), ["lang", "source"])

    columns = [f"x{k}" for k in range(D)]
    middle = x.groupBy("g").agg(*(F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(c) for c in columns))
    # a normal distribution's quartiles are 1.349 standard deviations apart
    spread = [F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(math.sqrt(RIDGE))) for c in columns]
    diagonal = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i, j in PAIRS]
    now = materialise(middle.select("g", F.array(*(F.col(c)[1] for c in columns)).alias("center"), F.array(*diagonal).alias("inverse"), F.lit(math.inf).alias("size")), "estimate")
    for _ in range(steps):
        was = now
        at = x.join(sized(was.select("g", "center", "inverse"), names, 400), "g").withColumn("d", distance())
        near = materialise(at.groupBy("g").agg(F.percentile_approx("d", F.lit(coverage), 2000).alias("most")), "quantile")
        core = at.join(sized(near, names, 100), "g").where("d <= most")
        moments = core.groupBy("g").agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in columns)).alias("s"), F.array(*(F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in PAIRS)).alias("p"))
        before = sized(was.select("g", F.col("size").alias("before")), names, 100)
        now = estimates(moments).join(before, "g").select("g", "center", "inverse", (F.col("before") - F.col("size")).alias("fall"), F.least("before", "size").alias("size"))
        now = materialise(now, "estimate")
        falls = now.agg(F.max("fall")).first()[0]
        release(was, near)
        if falls is None or falls <= SETTLED:
            break
    now = now.select("g", "center", "inverse")
    at = x.join(sized(now, names, 400), "g").withColumn("d", distance())
    scale = at.groupBy("g").agg((F.percentile_approx("d", F.lit(0.5), 2000) / chi_square(0.5, D)).alias("scale"))
    scale = materialise(scale, "scale")
    at = judged.join(sized(now, names, 400), "g").withColumn("d", distance())
    d = F.when(F.col("n_group") >= least, F.col("d") / F.greatest("scale", F.lit(1e-9)))
    rejected = F.coalesce(F.col("distance") > chi_square(cutoff, D), F.lit(False))
    return (
        at.drop("n").join(names_of, "g").join(sized(scale, names, 100), "g")
        .select(F.col("id").alias("doc_id"), "lang", "source", "n_group", d.alias("distance")).withColumn("rejected", rejected)
    )


def drop_outliers(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that aren't rejected, all columns as they were. Rows with a null id or text stay.

    Of rows that repeat an id, all go if one is rejected.
    """
    found = outliers(docs, id_col, **options).where("rejected").select(F.col("doc_id").alias(id_col)).distinct()
    found = materialise(found, "rejected")
    return docs.join(sized(found, found.count(), 16), id_col, "left_anti").select(*docs.columns)
