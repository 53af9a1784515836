"""Every registered query of the panel library against its SQL on the smallest tables."""

import math
import os

import pytest
from conftest import sf_dir

from panelwright.plans import catalog


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    return round(float(v), 7) + 0.0 if not isinstance(v, str) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir()):
        con.execute(f"create view {name[:-8]} as select * from '{sf_dir()}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, sf_dir())
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
