"""Every query of the subpackage runs on the smallest tables, and equals its SQL where it has some."""

import os

import pytest

from cohortloom.llm import mixing, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    if name.startswith("p8") and not os.path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer file")
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in queries.SQL:
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = c.execute(queries.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(x) for x in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(map(cell, r)) for r in rows), key=key) == sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=key)
