"""Every registered query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from voxelark import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(registry.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.shape == want.shape
    assert (got.values == want.values).all()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_training_operators():
    import __spark_entry__ as e

    assert "voxel_occupancy" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
