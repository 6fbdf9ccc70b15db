"""Driver contract of __spark_entry__."""

import __spark_entry__ as entry


def test_contract_shapes():
    q, s = entry.queries(), entry.oracle_sql()
    assert q and set(s) <= set(q)
    assert all(callable(f) for f in q.values())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
