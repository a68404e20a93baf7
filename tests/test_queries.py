"""Queries against their SQL in DuckDB on the smallest tables, where those are there."""

from pathlib import Path

import duckdb
import pytest

import terrane.more_queries  # noqa: F401
from terrane.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
#: All but those that fit models, which the driver compares and test_model.py tests.
SOME = sorted(set(ORACLE_SQL) - {"m16_partition", "a15_criteria", "d11_panel", "d01_locations"})


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
