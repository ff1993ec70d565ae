"""Queries of the sparse operators: a one-dimensional system of 65 hats whose load comes from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear as ops
from ..registry import query
from .data import q, quant

N = 64

_K = f"""i AS (SELECT range AS r FROM range({N + 1})), o AS (SELECT unnest([-1, 0, 1]) o),
k AS (SELECT r, r + o AS c, CASE WHEN o <> 0 THEN -{N}.0 WHEN r IN (0, {N}) THEN {N}.0 ELSE {2 * N}.0 END::DOUBLE v FROM i, o WHERE r + o BETWEEN 0 AND {N}),
ms AS (SELECT r, c, CASE WHEN r <> c THEN 1 / {6 * N}.0::DOUBLE WHEN r IN (0, {N}) THEN 1 / {3 * N}.0::DOUBLE ELSE 2 / {3 * N}.0::DOUBLE END v FROM k),
m AS (SELECT r, c, k.v + 100 * ms.v AS v FROM k JOIN ms USING (r, c)),
b AS (SELECT l_orderkey % {N + 1} AS r, avg(l_quantity) v FROM lineitem GROUP BY 1),
pr AS (SELECT 2 * r + o AS r, r AS c, CASE WHEN o = 0 THEN 1.0 ELSE 0.5 END::DOUBLE v FROM (SELECT range AS r FROM range({N // 2 + 1})), o WHERE 2 * r + o BETWEEN 0 AND {N})"""


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.groupBy((F.col("l_orderkey") % (N + 1)).alias("r")).agg(F.avg("l_quantity").alias("v"))


def system(spark: SparkSession) -> DataFrame:
    return ops.add(ops.laplacian_1d(spark, N), ops.scaled(ops.mass_1d(spark, N), 100.0))


def _out(x: DataFrame) -> DataFrame:
    return x.select(*(c for c in x.columns if c != "v"), quant(F.col("v")).alias("v"))


@query(f"WITH {_K} SELECT m.r, {q('sum(m.v * b.v)')} v FROM m JOIN b ON m.c = b.r GROUP BY m.r")
def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ops.spmv(system(spark), load(spark, sf_dir)))


@query(f"WITH {_K} SELECT c AS r, r AS c, {q('v')} v FROM pr")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ops.transpose(ops.prolongation_1d(spark, N // 2)))


@query(f"WITH {_K}, mp AS (SELECT m.r, pr.c, sum(m.v * pr.v) v FROM m JOIN pr ON m.c = pr.r GROUP BY 1, 2) SELECT pr.c AS r, mp.c, {q('sum(pr.v * mp.v)')} v FROM pr JOIN mp ON pr.r = mp.r GROUP BY 1, 2")
def galerkin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ops.galerkin(system(spark), ops.prolongation_1d(spark, N // 2)))


def _sweep(old: str, new: str) -> str:
    return f"""{new} AS (SELECT r, coalesce(x, 0) + coalesce(bv - coalesce(mx, 0), 0) / d AS v FROM i LEFT JOIN (SELECT r, v AS x FROM {old}) x USING (r) LEFT JOIN (SELECT r, v AS bv FROM b) b USING (r)
  LEFT JOIN (SELECT m.r, sum(m.v * x.v) mx FROM m JOIN {old} x ON m.c = x.r GROUP BY m.r) s USING (r) JOIN (SELECT r, v AS d FROM m WHERE r = c) d USING (r))"""


@query(f"WITH {_K}, x0 AS (SELECT r, 0.0::DOUBLE AS v FROM i), {_sweep('x0', 'x1')}, {_sweep('x1', 'x2')}, {_sweep('x2', 'x3')} SELECT r, {q('v')} v FROM x3")
def jacobi_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b = system(spark), load(spark, sf_dir)
    x = spark.range(N + 1).select(F.col("id").alias("r"), F.lit(0.0).alias("v"))
    for _ in range(3):
        x = ops.jacobi(m, b, x)
    return _out(x)


@query(f"""WITH {_K}, r0 AS (SELECT r, v FROM b), z0 AS (SELECT sum(v * v) s FROM r0), m0 AS (SELECT m.r, sum(m.v * p.v) v FROM m JOIN r0 p ON m.c = p.r GROUP BY m.r),
a0 AS (SELECT (SELECT s FROM z0) / (SELECT sum(p.v * m0.v) FROM r0 p JOIN m0 USING (r)) a), x1 AS (SELECT r, a * v AS v FROM r0, a0), r1 AS (SELECT r, r0.v - a * m0.v AS v FROM r0 JOIN m0 USING (r), a0),
z1 AS (SELECT sum(v * v) s FROM r1), p1 AS (SELECT r, r1.v + (SELECT s FROM z1) / (SELECT s FROM z0) * r0.v AS v FROM r1 JOIN r0 USING (r)), m1 AS (SELECT m.r, sum(m.v * p.v) v FROM m JOIN p1 p ON m.c = p.r GROUP BY m.r),
a1 AS (SELECT (SELECT s FROM z1) / (SELECT sum(p.v * m1.v) FROM p1 p JOIN m1 USING (r)) a) SELECT r, {q('x1.v + a * p1.v')} v FROM x1 JOIN p1 USING (r), a1""")
def cg_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ops.conjugate_gradients(system(spark), load(spark, sf_dir), iterations=2))


@query(f"WITH {_K} SELECT {q('sum(v * v)')} v FROM m")
def matrix_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ops.square_norm(system(spark)))


@query(f"""WITH {_K}, e AS (SELECT r, b.v / d.v AS v FROM b JOIN (SELECT r, v FROM m WHERE r = c) d USING (r) WHERE r % 2 = 0)
SELECT r, {q('v')} v FROM (SELECT r, v FROM e UNION ALL
SELECT r, (b.v - coalesce(s.mx, 0)) / d.v FROM b JOIN (SELECT r, v FROM m WHERE r = c) d USING (r) LEFT JOIN (SELECT m.r, sum(m.v * e.v) mx FROM m JOIN e ON m.c = e.r WHERE m.r % 2 = 1 GROUP BY m.r) s USING (r) WHERE r % 2 = 1)""")
def gauss_seidel_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.createDataFrame([], "r long, v double")
    return _out(ops.gauss_seidel(system(spark), load(spark, sf_dir), x, F.pmod("r", F.lit(2)), 2))


@query("SELECT true AS converges")
def v_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual's share left after a V-cycle over three levels."""
    p = [ops.prolongation_1d(spark, N // 2), ops.prolongation_1d(spark, N // 4)]
    m = [system(spark)]
    for x in p:
        m.append(ops.written(ops.galerkin(m[-1], x)))
    b = ops.written(load(spark, sf_dir))
    zero = spark.createDataFrame([], "r long, v double")
    x = ops.cycle(m, p, b, zero, lambda m, b, x, forward: ops.gauss_seidel(m, b, x, F.pmod("r", F.lit(2)), 2, forward))
    left, whole = ops.square_norm(ops.residual(m[0], x, b)).first()[0], ops.square_norm(b).first()[0]
    return spark.createDataFrame([(bool(left < 0.05 * whole),)], "converges boolean")
