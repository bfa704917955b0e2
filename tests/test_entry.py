"""The driver contract: entry runs, every SQL twin has a query, keys unique."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"attribute", "min", "max", "n_null", "n_uniq", "perc_null"}


def test_sql_keys_subset_of_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 94          # guard against dropping registered keys
