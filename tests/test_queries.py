"""Every query of the library against its SQL twin; those without one have tests of their own below."""

import pytest
from conftest import SMALL, duck_rows, spark_rows

from lodesearch import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, duck, name):
    assert spark_rows(queries.QUERIES[name](spark, SMALL)) == duck_rows(duck, queries.ORACLE_SQL[name])


def test_twins_have_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stemming_by_row(spark, duck):
    from lodesearch.functions.stemming import stem

    got = {(r.doc_id, r.pos): r.stem for r in queries.QUERIES["analyzer_stemming"](spark, SMALL).collect()}
    tokens = {(r.doc_id, r.pos): r.token for r in queries._analyzed(spark, SMALL, "standard").collect()}
    english = {d for (d,) in duck.execute("SELECT doc_id FROM documents WHERE lang = 'en'").fetchall()}
    assert got == {k: stem(t) for k, t in tokens.items() if k[0] in english}


def test_language_guess_by_row(spark, duck):
    import re

    from lodesearch.functions.stemming import PROFILES

    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.QUERIES["language_guess"](spark, SMALL).collect():
        words = re.findall(r"[^\W\d_]+", texts[r.doc_id].lower())
        n = {k: sum(w in own.split() for w in words) for k, own in PROFILES.items()}
        best = min(n, key=lambda k: (-n[k], k))
        assert r.guess == (best if n[best] else "en")


def test_shards_by_row(spark, duck):
    def shard(x):
        h = 0
        for c in x:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % 8

    want: dict[int, int] = {}
    for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall():
        want[shard(str(i))] = want.get(shard(str(i)), 0) + 1
    assert {r.shard: r.n for r in queries.QUERIES["shard_distribution"](spark, SMALL).collect()} == want


def test_inferred_mapping(spark):
    got = {r.path: r.type for r in queries.QUERIES["infer_mapping"](spark, SMALL).collect()}
    assert got["text"] == "text" and got["n_chars"] == "number"


def test_advanced_analyzer_keeps_no_blank(spark):
    assert queries.QUERIES["analyzer_advanced"](spark, SMALL).where("token is null or trim(token) = ''").isEmpty()


def test_dates_are_rounded_to_milliseconds(spark, duck, tmp_path):
    """The twin's epoch_ms rounds, so the last half millisecond of an hour is the next one's."""
    times = ["2024-01-07 04:59:59.999738", "2024-01-07 04:59:59.9995", "2024-01-07 04:59:59.999499", "2024-01-07 05:00:00.0004", "1969-12-31 22:59:59.9995", "1969-12-31 22:59:59.999501", "1969-12-31 22:59:59.9984"]
    duck.execute(f"COPY (SELECT unnest({times})::TIMESTAMP AS ts UNION ALL SELECT TIMESTAMP '1969-12-31 23:59:59.999501') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("date_histogram_1h", "date_histogram_1d"):
        sql = queries.ORACLE_SQL[name].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet')")
        assert spark_rows(queries.QUERIES[name](spark, str(tmp_path))) == duck_rows(duck, sql)
