import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false", "spark.log.level": "OFF",
    }
    s = SparkSession.builder.config(map=conf).getOrCreate()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the small tables as views."""
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


SMALL = "/root/testdata/sf0.001"


def plain(v):
    """A value as text, alike for Spark and DuckDB."""
    if v is None or v != v:
        return "null"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(duck, sql):
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    rows = r.fetchall()
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(row[k]) for k in order) for row in rows)
