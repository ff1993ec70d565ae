"""Sampling density and fields splatted at the depth that it suggests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.splines import density_scale
from .cells import AXES, ancestors, mean, spline_weights, splat, with_cell

UNIT = ("u", "v", "w")


def samples(df: DataFrame, depth: int, weight: Column, values: dict[str, Column] | None = None) -> DataFrame:
    """One row a cell: weight, mean position (u, v, w) and weighted sums. The first and largest reduction."""
    rows = with_cell(df, depth)
    sums = [F.sum(weight).alias("weight"), *(F.sum(weight * F.col(c)).alias(f"_{c}") for c in UNIT), *(F.sum(weight * v).alias(n) for n, v in (values or {}).items())]
    out = rows.groupBy("d", *AXES).agg(*sums).filter("weight > 0")
    return out.withColumns({c: mean(f"_{c}") for c in UNIT}).drop(*(f"_{c}" for c in UNIT))


def density(sample: DataFrame, kernel_depth: int, scale: float | None = None, co_dim: int = 1) -> DataFrame:
    """Rows (d, i, j, k, dens) at depths to ``kernel_depth``: each cell's weight splatted from its mean position, degree 2."""
    scale = density_scale(3, co_dim) if scale is None else scale
    sums = ancestors(sample.withColumns({f"_{c}": F.col(c) * F.col("weight") for c in UNIT})).filter(F.col("d") <= kernel_depth)
    cells = sums.groupBy("d", *AXES).agg(F.sum("weight").alias("weight"), *(F.sum(f"_{c}").alias(f"_{c}") for c in UNIT))
    cells = cells.withColumns({c: mean(f"_{c}") for c in UNIT})
    return splat(cells, {"dens": F.col("weight") * scale}, 2)


def samples_per_node(points: DataFrame, dens: DataFrame, key: str, kernel_depth: int) -> DataFrame:
    """Rows (key, d, spn): the density at each point and depth, splines times the cells about it."""
    rows = points.select(key, *UNIT, F.explode(F.sequence(F.lit(0), F.lit(kernel_depth))).alias("d"))
    rows = spline_weights(with_cell(rows, F.col("d")), 2)
    return rows.join(dens, ["d", *AXES]).groupBy(key, "d").agg(F.sum(F.col("basis") * F.col("dens")).alias("spn"))


def depth_and_weight(spn: DataFrame, key: str, target: float, kernel_depth: int, dim: int = 3, co_dim: int = 1) -> DataFrame:
    """Rows (key, depth, weight) from samples per node.

    With the target met at the kernel depth, the depth goes on from there by the rate of a
    surface of the given co-dimension. Otherwise the deepest coarser depth that meets it (or the
    root) is taken, plus a part by the rate seen between it and the depth below.
    """
    w = Window.partitionBy(key).orderBy("d")
    rows = spn.withColumn("finer", F.lead("spn").over(w))
    enough = (F.col("spn") >= target) | (F.col("d") == 0)
    pick = rows.filter(enough).groupBy(key).agg(F.max_by(F.struct("d", "spn", "finer"), "d").alias("c")).select(key, "c.*")
    at_kernel = F.col("d") + F.log(F.col("spn") / target) / (F.log(F.lit(2.0)) * (dim - co_dim))
    between = F.col("d") + F.log(F.col("spn") / target) / F.log(F.col("spn") / F.col("finer"))
    depth = F.when(F.col("d") == kernel_depth, at_kernel).otherwise(between)
    return pick.select(key, depth.alias("depth"), (F.pow(F.pow(F.lit(2.0), -F.col("d")), F.lit(float(dim - co_dim))) / F.col("spn")).alias("weight"))


def deep_enough(dw: DataFrame, cut_off: float) -> DataFrame:
    """Samples whose estimated depth is ``cut_off`` at least; others take no part."""
    return dw.filter(F.col("depth") >= cut_off)


def mean_depth_and_weight(dw: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """One row (depth, weight): means over samples, each by its own weight."""
    rows = dw.withColumnRenamed("weight", "_share").join(sample.select(key, F.col("weight").alias("_w")), key)
    return rows.agg((F.sum(F.col("depth") * F.col("_w")) / F.sum("_w")).alias("depth"), (F.sum(F.col("_share") * F.col("_w")) / F.sum("_w")).alias("weight"))


def vector_field(points: DataFrame, dw: DataFrame, key: str, normal: Sequence[str], least: int, most: int, degree: int = 2) -> DataFrame:
    """Rows (d, i, j, k, vx, vy, vz): normals splatted wholly at the ceiling of their depth, weighted by the cell's volume."""
    d = F.greatest(F.least(F.ceil("depth").cast("int"), F.lit(most)), F.lit(least))
    rows = with_cell(points.join(dw, key).withColumn("d", d), F.col("d"))
    scale = F.col("weight") * F.pow(F.pow(F.lit(2.0), F.col("d")), F.lit(3.0))
    return splat(rows, {f"v{c}": F.col(n) * scale for c, n in zip("xyz", normal, strict=True)}, degree)


def extrapolation(sample: DataFrame, values: Sequence[str], per_level: float = 32.0, nearest: bool = False) -> DataFrame:
    """Rows (d, i, j, k, weight, values): weighted sums splatted at every depth, deeper ones far heavier.

    A level weighs 4^d times ``per_level``^d, so a point reads the finest data about it, and farther
    data where there is none. Degree 1 at cell corners; ``nearest``: the cell alone.
    """
    rows = ancestors(sample.select("d", *AXES, *UNIT, "weight", *values))
    level = F.pow(F.lit(4.0 * per_level), F.col("d"))
    if nearest:
        return rows.groupBy("d", *AXES).agg(*(F.sum(F.col(c) * level).alias(c) for c in ("weight", *values)))
    return splat(rows, {c: F.col(c) * level for c in ("weight", *values)}, 1)


def read_extrapolation(points: DataFrame, field: DataFrame, key: str, values: Sequence[str], depth: int) -> DataFrame:
    """Rows (key, values): the weighted means at points."""
    rows = points.select(key, *UNIT, F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    rows = spline_weights(with_cell(rows, F.col("d")), 1).join(field, ["d", *AXES])
    sums = rows.groupBy(key).agg(*(F.sum(F.col("basis") * F.col(c)).alias(c) for c in ("weight", *values)))
    return sums.select(key, *(mean(c).alias(c) for c in values))
