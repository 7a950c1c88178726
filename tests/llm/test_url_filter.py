import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, duck_rows, spark_rows
from pyspark.sql import functions as F

from lodesearch.llm import url_filter
from lodesearch.llm.queries import ORACLE_SQL, QUERIES

PAGES = "page_id long, url string, html string"
URLS = [
    (1, "https://spam.example/a/b?x=1#y"), (2, "http://www.spam.example"), (3, "https://good.example/a"), (4, "https://good.example/bad/page.html"), (5, "https://good.example/badly"), (6, None), (7, ""), (8, "no url"),
    (9, "HTTPS://User@SPAM.Example:8080/"), (None, "https://spam.example/"), (1, "https://spam.example/a/b?x=1#y"), (10, "//spam.example/x"), (11, "https://notspam.example/"), (12, "https://long.example/" + "a/" * 3000), (13, "https://spam.example./"),
]
LIST = ["spam.example", "good.example/bad", "", None, "spam.example", "good.example/bad/page.html", "example"]


def pages(spark):
    df = spark.createDataFrame([(i, u, "") for i, u in URLS], PAGES)
    return df.withColumns({c: F.lit("!") for c in ("probes", "digests", "entry", "blocked", "shard", "h")})


@pytest.mark.parametrize("shard_rows", [1_000_000, 1])
def test_matches(spark, shard_rows):
    entries = spark.createDataFrame([(e,) for e in LIST], "entry string")
    got = url_filter.blocked(pages(spark), entries, shard_rows=shard_rows).collect()
    assert len(got) == len(URLS)
    found = {r.page_id: r.entry for r in got if r.blocked}
    assert found == {1: "spam.example", 2: "spam.example", 4: "good.example/bad/page.html", 9: "spam.example", None: "spam.example", 10: "spam.example", 13: "spam.example"}
    assert all((r.entry is not None) == r.blocked for r in got) and sum(r.page_id == 1 for r in got) == 2


def test_equal_digests_are_told_apart(tmp_path):
    text = pa.array(["alpha", "beta", "gamma"], pa.large_string())
    keys = np.array([5, 5, 9], np.int64)
    for name, x in (("keys", keys), ("offsets", np.frombuffer(text.buffers()[1], np.int64)), ("bytes", np.frombuffer(text.buffers()[2], np.uint8))):
        (tmp_path / f"{name}-0").write_bytes(np.ascontiguousarray(x).tobytes())
    s = url_filter.Shard(f"file://{tmp_path}", 0)
    assert isinstance(s.keys, np.memmap)
    probes = pa.array(["beta", "delta", "gamma", "alpha", "gamma"])
    assert s.contains(np.array([5, 5, 9, 5, 7]), probes).tolist() == [True, False, True, True, False]


def test_empty(spark):
    none = spark.createDataFrame([], "entry string")
    assert not any(r.blocked for r in url_filter.blocked(pages(spark), none).collect())
    assert url_filter.blocked(pages(spark).limit(0), spark.createDataFrame([("a.example",)], "entry string")).isEmpty()


def test_twin(spark, duck):
    got = QUERIES["op1_url_filter"](spark, SMALL)
    assert spark_rows(got) == duck_rows(duck, ORACLE_SQL["op1_url_filter"]) and not got.where("blocked").isEmpty()
