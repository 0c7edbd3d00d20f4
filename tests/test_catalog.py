"""Every catalogue query against its DuckDB SQL."""

import duckdb
import pytest

from voxelith.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return "-" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert got
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got)
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want)
