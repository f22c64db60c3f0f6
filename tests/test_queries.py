"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from storyweft.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5) + 0.0
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def rows_of(df: pd.DataFrame) -> list[str]:
    own = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in own.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns) and len(got)
        numbers = got.select_dtypes("number")
        assert np.isfinite(numbers.dropna().to_numpy(float)).all()
        keys = [c for c in ("id", "measure", "narrative_id", "node", "doc_id", "query_id", "place", "rank", "step", "day", "lag", "topic", "word", "dimension") if c in got.columns]
        assert keys or len(got) <= 50
        if keys and not got[keys].isna().any().any():
            assert not got.astype(str).duplicated(keys).any()  # one row for each key
        return
    want = db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
