"""Every registered query of the core engine against its DuckDB text, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandlake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Queries without SQL; tests of their operators compare with loops.
LOOPED = {"calibrate_fit", "kernels_posterior_calls"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{round(float(v), 4) + 0.0:.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.SQL:
        assert name in LOOPED and rows
        return
    out = duck.sql(catalog.SQL[name])
    names = sorted(df.columns)
    assert sorted(out.columns) == names
    pick = [out.columns.index(n) for n in names]
    assert plain([tuple(r[n] for n in names) for r in rows]) == plain([tuple(r[i] for i in pick) for r in out.fetchall()])
