"""Corpus queries against their DuckDB SQL."""

import glob
import os

import duckdb
import pytest

from pixelweave.llm.queries import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    order = sorted(names)
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    expect = sorted((tuple(fix(r[names.index(n)]) for n in order) for r in want.fetchall()), key=str)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == order
    assert sorted((tuple(fix(r[n]) for n in order) for r in got.collect()), key=str) == expect


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
