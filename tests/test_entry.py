"""Every core query that has SQL equals it on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from cohortloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_names_are_in_order():
    assert set(catalog.sql()) <= set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {k for k in catalog.queries() if k.startswith("p")} >= {"p5_found", "p5_profile", "p5_drift"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    df = catalog.queries()[name](spark, DATA)
    want = c.execute(catalog.sql()[name])
    names = [x[0] for x in want.description]
    order = [names.index(x) for x in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(map(cell, r)) for r in df.collect()), key=key)
    b = sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=key)
    assert a == b
