"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from docweave.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    if isinstance(v, float):
        return f"{v:.12g}f"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(timespec="milliseconds")
    return str(v)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
