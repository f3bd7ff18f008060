"""The registry: every query has a callable, and SQL keys are query names."""

import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "doc_id", "score", "rank"] and rows.count() > 0
