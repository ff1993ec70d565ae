"""Queries over tables of many ranges, whose sampled bounds differ from one shuffle to the next, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelark import registry

ROWS = 40_000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    key = F.col("id") * 7919 % ROWS  # every key once, in no order
    t = spark.range(0, ROWS, 1, 8)
    t.select(key.alias("vec_id"), F.array(*((F.col("id") % n).cast("float") for n in (3, 5, 7, 11))).alias("embedding")).write.parquet(f"{at}/embeddings.parquet")
    t.select(key.alias("o_orderkey"), (F.col("id") / 4).alias("o_totalprice")).write.parquet(f"{at}/orders.parquet")
    return at


@pytest.fixture
def many_ranges(spark):
    old = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in old.items():
        old[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("name", "table"), [("embedding_dot", "embeddings"), ("streams_interleaved", "orders"), ("streams_one_after_another", "orders"), ("systematic_sample", "orders")])
def test_same_rows_as_sql(spark, tables, many_ranges, name, table):
    registry.QUERIES[name](spark, tables).write.mode("overwrite").parquet(f"{tables}/{name}")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    want = c.execute(registry.ORACLE[name])
    columns = ", ".join(d[0] for d in want.description)
    got = c.execute(f"SELECT {columns} FROM '{tables}/{name}/*.parquet' ORDER BY ALL")
    assert got.fetchall() == c.execute(f"SELECT {columns} FROM ({registry.ORACLE[name]}) ORDER BY ALL").fetchall()


def _odd_orders(spark, at):
    """Orders with negative keys and null ones, these with one price as their order is open."""
    key = F.when(F.col("id") % 1000 == 7, None).when(F.col("id") % 5 == 0, -1 - F.col("id")).otherwise(F.col("id"))
    price = F.when(F.col("id") % 1000 == 7, 1.5).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") / 4)
    spark.range(0, ROWS, 1, 8).select(key.alias("o_orderkey"), price.alias("o_totalprice")).write.parquet(f"{at}/orders.parquet")


def test_interleaved_streams_keep_rows_of_any_key(spark, tmp_path, many_ranges):
    _odd_orders(spark, tmp_path)
    test_same_rows_as_sql(spark, str(tmp_path), None, "streams_interleaved", "orders")


def test_streams_one_after_another_keep_rows_of_any_key(spark, tmp_path, many_ranges):
    _odd_orders(spark, tmp_path)
    test_same_rows_as_sql(spark, str(tmp_path), None, "streams_one_after_another", "orders")
