"""Every registered query of the subpackage on the smallest tables, against its SQL twin where it has one."""

import glob
import math
import os

import duckdb
import pytest

from docframe.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_pack_windows": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op9_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_quality": {"doc_id", "held_out", "score", "predicted"},
    "pipeline": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got and COLUMNS.get(name, set(df.columns)) == set(df.columns)
    if name in ORACLES:
        duck = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        found = duck.execute(ORACLES[name])
        assert got == rows([x[0] for x in found.description], found.fetchall())
