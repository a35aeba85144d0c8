"""Every registered query against its oracle, at the smallest scale."""

import math
from pathlib import Path

import pytest

from sievework import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    return con


def rows(found):
    show = lambda x: "~" if x is None else f"{0.0 if math.isclose(x, 0, abs_tol=1e-9) else x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in found)


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows(got) == rows(duck.sql(f"select {', '.join(columns)} from want").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
