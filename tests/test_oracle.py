"""Every registered query against its oracle, over the smallest tables."""

import math
import os

import pytest

from tastevin.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if type(v).__name__ in ("datetime", "date") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in place) for r in result.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
