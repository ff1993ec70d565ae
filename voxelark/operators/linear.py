"""Sparse linear algebra on coordinate tables: matrices (r, c, v), vectors (r, v). Absent entries are 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


def spmv(m: DataFrame, x: DataFrame, scale: float = 1.0) -> DataFrame:
    y = m.join(x.select(F.col("r").alias("c"), F.col("v").alias("x")), "c")
    return y.groupBy("r").agg((F.sum(F.col("v") * F.col("x")) * scale).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("r").alias("c"), F.col("c").alias("cc"), F.col("v").alias("vv"))
    return a.join(right, "c").groupBy("r", F.col("cc").alias("c")).agg(F.sum(F.col("v") * F.col("vv")).alias("v"))


def add(*parts: DataFrame) -> DataFrame:
    """Sum of matrices, or of vectors, of any shapes."""
    key = [c for c in parts[0].columns if c != "v"]
    return reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.sum("v").alias("v"))


def scaled(m: DataFrame, s: float | Column) -> DataFrame:
    return m.withColumn("v", F.col("v") * s)


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v"))


def diagonal(m: DataFrame, reciprocal: bool = False) -> DataFrame:
    d = m.filter("r = c").groupBy("r").agg(F.sum("v").alias("v"))
    return d.withColumn("v", 1 / F.col("v")) if reciprocal else d


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.select("r", F.col("v").alias("y")), "r").agg(F.sum(F.col("v") * F.col("y"))).first()[0] or 0.0


def square_norm(m: DataFrame) -> DataFrame:
    return m.agg(F.sum(F.col("v") * F.col("v")).alias("v"))


def asymmetry(m: DataFrame) -> float:
    """Largest difference of an entry and its mirror."""
    t = transpose(m).withColumn("v", -F.col("v"))
    return m.unionByName(t).groupBy("r", "c").agg(F.sum("v").alias("v")).agg(F.max(F.abs("v"))).first()[0] or 0.0


def residual(m: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    return add(b, scaled(spmv(m, x), -1.0))


def color(axes: Sequence[str], modulus: int) -> Column:
    """Colour of a place: rows of a colour are ``modulus`` apart along some axis, so their bases don't meet. Last axis first, as places are ordered."""
    out = F.lit(0)
    for a in reversed(list(axes)):
        out = out * modulus + F.pmod(F.col(a), F.lit(modulus))
    return out


def residual_norms(m: DataFrame, x: DataFrame, b: DataFrame, level: Column) -> DataFrame:
    """Rows (level, before, after): norms of the right side and of what a solution leaves over, by level."""
    rows = add(b, scaled(b, 0.0)).select("r", F.col("v").alias("b")).join(residual(m, x, b), "r")
    return rows.groupBy(level.alias("level")).agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("before"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("after"))


def jacobi(m: DataFrame, b: DataFrame, x: DataFrame, omega: float = 1.0) -> DataFrame:
    """One sweep x + omega * (b - m x) / diag(m)."""
    d = diagonal(m).withColumnRenamed("v", "d")
    step = residual(m, x, b).join(d, "r").select("r", (F.col("v") / F.col("d") * omega).alias("v"))
    return add(x, step)


def gauss_seidel(m: DataFrame, b: DataFrame, x: DataFrame, color: Column, colors: int, forward: bool = True, omega: float = 1.0) -> DataFrame:
    """One sweep, colour by colour: rows of a colour don't meet in ``m``, so each is one join and one sum."""
    d = diagonal(m).withColumnRenamed("v", "d")
    for c in range(colors) if forward else range(colors - 1, -1, -1):
        rows = m.filter(color == c)
        step = residual(rows, x, b.filter(color == c)).join(d, "r").select("r", (F.col("v") / F.col("d") * omega).alias("v"))
        x = written(add(x, step))
    return x


def conjugate_gradients(m: DataFrame, b: DataFrame, x: DataFrame | None = None, iterations: int = 100, tolerance: float = 1e-10, precondition: bool = False, null_space: bool = False) -> DataFrame:
    """Solution of m x = b for symmetric positive (semi)definite m.

    Each iteration is one product and two sums; vectors are written between. ``null_space``:
    constants are in it, so the mean of the right side is taken off.
    """
    spark = b.sparkSession
    if null_space:
        mean = b.agg(F.avg("v")).first()[0] or 0.0
        b = b.withColumn("v", F.col("v") - mean)
    inverse = diagonal(m, reciprocal=True).withColumnRenamed("v", "d") if precondition else None
    z_of = lambda r: r.join(inverse, "r").select("r", (F.col("v") * F.col("d")).alias("v")) if precondition else r
    x = x if x is not None else spark.createDataFrame([], "r long, v double")
    r = written(residual(m, x, b))
    p = z = written(z_of(r))
    rz = first = dot(r, z)
    for _ in range(iterations):
        if rz <= tolerance * tolerance * max(first, 1e-300):
            break
        mp = written(spmv(m, p))
        a = rz / dot(p, mp)
        x, r = written(add(x, scaled(p, a))), written(add(r, scaled(mp, -a)))
        z = written(z_of(r)) if precondition else r
        rz, before = dot(r, z), rz
        p = written(add(z, scaled(p, rz / before)))
    return x


def laplacian_1d(spark, n: int) -> DataFrame:
    """Stiffness of n + 1 hats on n intervals of width 1/n, free at both ends."""
    i = spark.range(n + 1).select(F.col("id").alias("r"), F.explode(F.array(*(F.lit(o) for o in (-1, 0, 1)))).alias("o"))
    i = i.select("r", (F.col("r") + F.col("o")).alias("c"), "o").filter((F.col("c") >= 0) & (F.col("c") <= n))
    v = F.when(F.col("o") != 0, -float(n)).when((F.col("r") == 0) | (F.col("r") == n), float(n)).otherwise(2.0 * n)
    return i.select("r", "c", v.alias("v"))


def mass_1d(spark, n: int) -> DataFrame:
    k = laplacian_1d(spark, n)
    v = F.when(F.col("r") != F.col("c"), 1 / (6.0 * n)).when((F.col("r") == 0) | (F.col("r") == n), 1 / (3.0 * n)).otherwise(2 / (3.0 * n))
    return k.select("r", "c", v.alias("v"))


def prolongation_1d(spark, n: int) -> DataFrame:
    """From the n + 1 coarse hats to the 2 n + 1 fine ones."""
    i = spark.range(n + 1).select(F.col("id").alias("c"), F.explode(F.array(*(F.lit(o) for o in (-1, 0, 1)))).alias("o"))
    return i.select((2 * F.col("c") + F.col("o")).alias("r"), "c", F.when(F.col("o") == 0, 1.0).otherwise(0.5).alias("v")).filter((F.col("r") >= 0) & (F.col("r") <= 2 * n))


def galerkin(m: DataFrame, p: DataFrame) -> DataFrame:
    return matmul(transpose(p), matmul(m, p))


def cycle(matrices: list[DataFrame], prolongations: list[DataFrame], b: DataFrame, x: DataFrame, smooth: Callable[[DataFrame, DataFrame, DataFrame, bool], DataFrame], gamma: int = 1) -> DataFrame:
    """A V (``gamma`` 1) or W (2) cycle; ``matrices`` from fine to coarse, the coarsest solved by conjugate gradients."""
    m = matrices[0]
    if len(matrices) == 1:
        return conjugate_gradients(m, b, x, iterations=50)
    p = prolongations[0]
    x = written(smooth(m, b, x, True))
    coarse_b = written(spmv(transpose(p), residual(m, x, b)))
    e = b.sparkSession.createDataFrame([], "r long, v double")
    for _ in range(gamma):
        e = cycle(matrices[1:], prolongations[1:], coarse_b, e, smooth, gamma)
    x = written(add(x, spmv(p, e)))
    return written(smooth(m, b, x, False))


def cascade(matrices: list[DataFrame], prolongations: list[DataFrame], rights: list[DataFrame], smooth: Callable[[DataFrame, DataFrame, DataFrame, bool], DataFrame]) -> DataFrame:
    """Coarse to fine: each level starts from the prolonged solution of the one before."""
    x = conjugate_gradients(matrices[-1], rights[-1], iterations=50)
    for m, p, b in zip(matrices[-2::-1], prolongations[::-1], rights[-2::-1], strict=True):
        x = written(smooth(m, b, written(spmv(p, x)), True))
    return x
