"""The test tables as points, cells, grids and meshes, on both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import unit_cube

AXES3 = ("x", "y", "z")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points; a is an attribute, nx, ny, nz an unnormalised normal."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("a"),
        (F.col("l_quantity") - 25.5).alias("nx"), ((F.col("l_extendedprice") - 30000.0) / 1000.0).alias("ny"), ((F.col("l_discount") - 0.05) * 100.0).alias("nz"),
    )


def unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with unit coordinates u, v, w, each axis by its own range."""
    p = points(spark, sf_dir)
    u = unit_cube(p, AXES3, each_axis=True).apply([F.col(c) for c in AXES3])
    return p.withColumns(dict(zip("uvw", u, strict=True)))


def quant(c: Column, digits: int = 4) -> Column:
    """Rounded so that no common value lies on the edge."""
    return F.floor(c * F.lit(10.0**digits) + 0.3719) / F.lit(10.0**digits)


def q(expr: str, digits: int = 4) -> str:
    """``quant`` in SQL."""
    return f"(floor(({expr}) * 1e{digits} + 0.3719) / 1e{digits})"


P = """p AS (SELECT l_orderkey * 10 + l_linenumber AS pid, l_quantity AS x, l_extendedprice AS y, l_discount AS z, l_tax AS a,
  l_quantity - 25.5 AS nx, (l_extendedprice - 30000.0::DOUBLE) / 1000.0::DOUBLE AS ny, (l_discount - 0.05::DOUBLE) * 100.0::DOUBLE AS nz FROM lineitem)"""
U = P + """, e AS (SELECT min(x) x0, max(x) - min(x) sx, min(y) y0, max(y) - min(y) sy, min(z) z0, max(z) - min(z) sz FROM p),
u AS (SELECT p.*, (x - x0) / sx AS u, (y - y0) / sy AS v, (z - z0) / sz AS w FROM p, e)"""


def cell_sql(u: str, d: str) -> str:
    return f"CAST(greatest(ceil({u} * pow(2.0, {d})) - 1, 0) AS INTEGER)"


def cells_cte(d: int) -> str:
    """c: unit points with their cells at depth ``d``."""
    return f"{U}, c AS (SELECT *, {d} AS d, {cell_sql('u', str(d))} AS i, {cell_sql('v', str(d))} AS j, {cell_sql('w', str(d))} AS k FROM u)"


#: Values of the splines that a cell supports, by degree; {x} is the place in the cell.
SPLINE_SQL = {
    1: [(0, "1 - ({x})"), (1, "({x})")],
    2: [(-1, "(1 - ({x})) * (1 - ({x})) / 2"), (0, "(1 + 2 * ({x}) - 2 * ({x}) * ({x})) / 2"), (1, "({x}) * ({x}) / 2")],
}


def spline_cte(source: str, degree: int, keep: str, name: str = "s") -> str:
    """``name``: rows of ``source`` (d, i, j, k, u, v, w) for every basis their cell supports, as d, i, j, k, basis and ``keep``."""
    last = "CAST(pow(2, d) AS INTEGER)" + ("" if degree == 1 else " - 1")
    parts = []
    for oi, ei in SPLINE_SQL[degree]:
        for oj, ej in SPLINE_SQL[degree]:
            for ok, ek in SPLINE_SQL[degree]:
                f = lambda e, u, a: "(" + e.format(x=f"{u} * pow(2.0, d) - {a}") + ")"
                parts.append(f"SELECT d, i + {oi} AS i, j + {oj} AS j, k + {ok} AS k, {f(ei, 'u', 'i')} * {f(ej, 'v', 'j')} * {f(ek, 'w', 'k')} AS basis, {keep} FROM {source}")
    union = " UNION ALL ".join(parts)
    return f"{name} AS (SELECT * FROM ({union}) WHERE i BETWEEN 0 AND {last} AND j BETWEEN 0 AND {last} AND k BETWEEN 0 AND {last})"
