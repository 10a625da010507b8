"""Every registered query of this part against its SQL in DuckDB, on the smallest test tables."""

import math
import os

import duckdb
import pytest

from callweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE:
        assert out.count() > 0
        return
    columns = sorted(out.columns)
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in out.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
