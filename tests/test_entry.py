import __spark_entry__ as E


def test_every_query_registered_with_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "page_id" in df.columns
