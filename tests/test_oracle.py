"""Every query that has SQL against DuckDB on the same tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    expected = [tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in result.fetchall()]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 7
