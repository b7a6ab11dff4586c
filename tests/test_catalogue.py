"""Every query of the reference's operators against its SQL twin, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docframe.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, (int, bool)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, found.fetchall())
    else:
        assert got
