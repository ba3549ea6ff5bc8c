"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from leafloom.plans import registry

SF = "/root/testdata/sf0.001"
#: Papers of these few documents have no such section.
EMPTY = {"stated_limitations"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_is_as_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b) and (len(a) > 0 or name in EMPTY)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in columns)


def test_entry_has_the_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
