"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

import math

import duckdb
import pytest
from docgraph import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def same(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, name):
    df = plans.queries()[name](spark, sf)
    if name in plans.oracle_sql():
        same(df, plans.oracle_sql()[name], sf)
    else:
        assert df.count() > 0


def test_entry_gives_rows(spark):
    assert plans.flagship(spark, "/root/testdata/sf0.001").count() > 0
