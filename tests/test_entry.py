import __spark_entry__ as entry
from lodesearch import queries


def test_entry_has_the_library(spark):
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "source", "n_chars"]
