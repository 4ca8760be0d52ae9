"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from periodica.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x + 0.0:.7g}")
        return x if x is None or isinstance(x, (int, bool)) else str(x)

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL and n not in ("freq_grid", "kaiser_window")])
def test_query_is_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)
