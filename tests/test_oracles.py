"""Every registered query against its SQL, as the driver compares them, on the smallest tables."""

from __future__ import annotations

import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        kind = str(out[c].dtype).lower()
        out[c] = out[c].astype(float).round(6).astype(str) if kind.startswith(("float", "decimal")) else out[c].astype(str)
    out = out.replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).replace(r"\.0$", "", regex=True)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found.count() >= 0
        return
    expected = duck.sql(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(canonical(found.toPandas()), canonical(expected))


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "target", "type", "support", "event_start"]
