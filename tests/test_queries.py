"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from hanagram import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in q.ORACLE:
        assert rows
        return
    found = duck.execute(q.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert sorted(tuple(map(cell, r)) for r in rows) == sorted(tuple(map(cell, r)) for r in want)
