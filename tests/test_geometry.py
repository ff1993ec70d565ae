import math

import numpy as np
from pyspark.sql import functions as F

from voxelark.functions import geometry as g
from voxelark.functions import splines as s
from voxelark.operators import cells, points


def test_normals_must_be_finite(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (float("nan"), 1.0, 0.0), (float("inf"), 0.0, 0.0), (1.0, 0.0, 0.0)], "nx double, ny double, nz double")
    assert df.filter(g.finite_normal(g.vector("nx", "ny", "nz"))).count() == 1


def test_ties_go_to_the_lower_cell(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.26,), (0.5,), (1.0,)], "u double")
    assert [r[0] for r in df.select(cells.locate(F.col("u"), 2)).collect()] == [0, 0, 1, 1, 3]


def test_splines_sum_to_one():
    for degree in (0, 1, 2, 3):
        for t in (0.0, 0.3, 0.99):
            assert math.isclose(sum(s.spline(degree, t + k) for k in range(degree + 1)), 1.0)
        assert math.isclose(s.integral(degree, 0, degree + 1), 1.0)
        assert math.isclose(sum(s.two_scale(degree)), 2.0)


def test_inner_products():
    assert np.allclose(s.inner_products(1), [1 / 6, 2 / 3, 1 / 6])
    assert np.allclose(s.inner_products(1, 1, 1), [-1, 2, -1])
    assert np.allclose(sum(s.inner_products(2, 1, 1)), 0)


def test_reflection():
    assert s.reflect(-1, 8, "neumann") == (1, 1)
    assert s.reflect(9, 8, "dirichlet") == (7, -1)
    assert s.reflect(-2, 8, "free") == (-2, 1)


def test_roots():
    assert np.allclose(g.real_roots([-6, 11, -6, 1]), [1, 2, 3])
    assert g.real_roots([1, 0, 1]) == []
    assert math.isclose(g.poly_integral([0, 0, 3], 0, 2), 8)


def test_balanced_ranges():
    assert points.balanced_ranges([1, 1, 1, 9, 1, 1], 3) == [3, 4, 6]
    assert points.balanced_ranges([4, 4], 1) == [2]


def test_splat_keeps_the_weight_away_from_the_border(spark):
    df = spark.range(50).select(*((0.3 + F.pmod(F.col("id") * k, F.lit(50)) / 130).alias(u) for u, k in zip("uvw", (1, 7, 11), strict=True)))
    for degree in (1, 2):
        out = cells.splat(cells.with_cell(df, 4), {"w": F.lit(1.0)}, degree)
        assert math.isclose(out.agg(F.sum("w")).first()[0], 50.0, rel_tol=1e-9)


def test_roll_up_conserves(spark):
    c = spark.range(100).select(F.lit(4).alias("d"), *((F.col("id") * k % 16).cast("int").alias(a) for a, k in zip("ijk", (1, 3, 5), strict=True)), F.lit(1.0).alias("n"))
    per = cells.roll_up(c, ["n"]).groupBy("d").agg(F.sum("n").alias("s")).collect()
    assert len(per) == 5 and all(r["s"] == 100 for r in per)


def test_row_numbers_are_dense(spark):
    r = points.row_numbers(spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7), ["x"])
    assert r.filter("x <> place").count() == 0


def test_rotation_is_orthonormal():
    for d in range(9):
        m = points.rotation_to_last(d)
        assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(m @ np.array(points.directions()[d]), [0, 0, 1])


def test_interleaved_bits(spark):
    r = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 3, 3)], "i int, j int, k int").select(cells.morton()).collect()
    assert [x[0] for x in r] == [1, 2, 4, 63]
