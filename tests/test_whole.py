"""Queries against their SQL on tables of more rows than the smallest ones have."""

from __future__ import annotations

import duckdb
import pytest

from docweave.queries import ORACLE_SQL, QUERIES
from tests.test_oracle import TABLES, plain

SF = "/root/testdata/sf0.01"
#: More rows than this come out.
CUT = {
    "stage_unwind": 200,
    "expr_arrays": 400,
    "expr_statistics": 400,
    "lookup_correlated": 61,
    "filter_arrays": 23,
    "graph_lookup": 6,
}


@pytest.mark.parametrize("name", list(CUT))
def test_whole(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert len(rows) > CUT[name]
