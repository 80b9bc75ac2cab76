import datetime

import duckdb
import pytest

from textloom import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    return round(v, 5) if isinstance(v, float) else str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in engine.ORACLES:
        assert got
        return
    cur = duck.execute(engine.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want
