"""Every query with an oracle gives the oracle's rows at the smallest scale factor."""

import os

import duckdb
import pytest

from quarrygraph.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    value = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(([value(r[i]) for i in at] for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)
