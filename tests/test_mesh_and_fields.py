import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelark.operators import fem, levelset, linear, mesh
from voxelark.operators.points import unit_cube
from voxelark.plans import apps


def box(spark):
    v = [(n, float(n & 1), float(n >> 1 & 1), float(n >> 2 & 1)) for n in range(8)]
    q = [[0, 2, 3, 1], [4, 5, 7, 6], [0, 1, 5, 4], [2, 6, 7, 3], [0, 4, 6, 2], [1, 3, 7, 5]]
    return spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(list(enumerate(q)), "fid long, ids array<long>")


def test_box(spark):
    v, f = box(spark)
    assert abs(mesh.polygon_areas(f, v).agg(F.sum("area")).first()[0] - 6) < 1e-9
    assert mesh.edges(f).filter("n <> 2").count() == 0
    t = mesh.triangulate(v, f)
    assert t.count() == 12
    at = spark.createDataFrame([(0, 0.5, 0.4, 0.3), (1, 0.2, 0.6, 1.4), (2, 0.3, 0.2, -0.5)], "p int, x double, y double, z double")
    assert [r["inside"] for r in apps.inside_mesh(at, v, t, "p").orderBy("p").collect()] == [True, False, False]
    s = apps.area_samples(v, t, 0.2)
    assert abs(s.agg(F.sum("weight")).first()[0] - 6) < 1e-9


def test_split_polygon():
    parts = mesh.split_polygon([7, 3, 5, 9], [1.0, 3.0, 3.0, 1.0], 2.0)
    assert sorted(parts) == sorted([(True, [(3, 7), (3, 3), (5, 5), (5, 9)]), (False, [(5, 9), (9, 9), (7, 7), (3, 7)])])
    assert mesh.split_polygon([1, 2, 3], [2.0, 2.0, 2.0], 2.0) == [(False, [(1, 1), (2, 2), (3, 3)])]


def test_trim_surface_drops_what_is_under(spark):
    n = 6
    v = spark.range(n * n).select(F.col("id").alias("vid"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"), F.lit(0.0).alias("z"), (F.col("id") % n).cast("double").alias("value"))
    f = spark.createDataFrame([(r * 10 + c, [r * n + c, r * n + c + 1, (r + 1) * n + c + 1, (r + 1) * n + c]) for r in range(n - 1) for c in range(n - 1)], "fid long, ids array<long>")
    w, g = apps.trim_surface(v, f, 2.5)
    assert abs(mesh.polygon_areas(g, w).agg(F.sum("area")).first()[0] - 12.5) < 1e-9
    assert w.agg(F.min("value")).first()[0] == 2.5


def test_small_components_merge():
    assert mesh.merge_small({0: 100.0, 1: 0.01, 2: 50.0}, [(0, 1), (1, 2)], 0.001) == {0: 0, 1: 0, 2: 0}
    assert mesh.merge_small({0: 100.0, 1: 0.01}, [], 0.001) == {0: 0, 1: 1}


def test_best_triangles_cover_the_polygon():
    p = np.array([[np.cos(a), np.sin(a), 0.0] for a in np.linspace(0, 2 * np.pi, 7)[:-1]])
    t = mesh.best_triangles(p)
    assert len(t) == 4 and {i for x in t for i in x} == set(range(6))


def test_cube_cases_are_closed_loops():
    for case in range(256):
        over = tuple(bool(case >> n & 1) for n in range(8))
        loops = levelset.cube_polygons(over)
        keys = [k for loop in loops for k in loop]
        assert len(keys) == len(set(keys))
        crossed = {tuple(a[d] + b[d] for d in range(3)) for x in range(8) for d0 in range(3) if not x >> d0 & 1
                   for a, b in [((x & 1, x >> 1 & 1, x >> 2 & 1), ((x | 1 << d0) & 1, (x | 1 << d0) >> 1 & 1, (x | 1 << d0) >> 2 & 1))] if over[x] != over[x | 1 << d0]}
        assert set(keys) == crossed


def test_quadratic_fit(spark):
    r = np.random.default_rng(0).uniform(-1, 1, (1000, 2))
    p = spark.createDataFrame(pd.DataFrame({"x": r[:, 0], "y": r[:, 1], "value": (r**2).sum(axis=1)}))
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 0.5, 0.5), (3, 2.0, 2.0)], "k int, x double, y double")
    got = [x["value"] for x in apps.fit(p).evaluate(at, "k").orderBy("k").collect()]
    assert np.allclose(got[:3], [0, 0.25, 0.5], atol=1e-3) and got[3] is None


def test_finer_levels_agree_with_the_dense_solution(spark):
    r = np.random.default_rng(1).uniform(0.1, 0.9, (300, 2))
    s = spark.createDataFrame(pd.DataFrame({"u": r[:, 0], "v": r[:, 1], "weight": 1.0, "target": np.sin(4 * r[:, 0]) + r[:, 1]}))
    at = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(r[:20])], "key int, u double, v double")
    whole = fem.evaluate(at, fem.solve(spark, 4, 4, 2, 0.0, 1e-3, None, s), "key", 4, 4, 2).orderBy("key").toPandas()
    steps = fem.evaluate(at, fem.solve(spark, 3, 4, 2, 0.0, 1e-3, None, s, iterations=25), "key", 3, 4, 2).orderBy("key").toPandas()
    assert np.allclose(whole["value"], steps["value"], atol=2e-2)


def test_constants_are_in_the_null_space(spark):
    ones = spark.range(17 * 17).select((F.col("id") % 17).cast("int").alias("i"), F.floor(F.col("id") / 17).cast("int").alias("j"), F.lit(1.0).alias("v"))
    assert fem.apply_system(ones, 4, 0.0, 1.0, ("i", "j")).agg(F.max(F.abs("v"))).first()[0] < 1e-9
    assert abs(fem.apply_system(ones, 4, 1.0, 0.0, ("i", "j")).agg(F.sum("v")).first()[0] - 1) < 1e-9


def test_stitching_takes_offsets_out(spark):
    n = 8
    px = spark.createDataFrame([(r, c, int(c >= 3), 10.0 + 40.0 * (c >= 3)) for r in range(n) for c in range(n)], "row int, col int, label int, val double")
    out = apps.stitch(px).agg(F.stddev_pop("val").alias("s"), F.count("val").alias("n")).first()
    assert out["s"] < 1e-3 and out["n"] == n * n


def test_cg_solves(spark):
    m = linear.add(linear.laplacian_1d(spark, 16), linear.mass_1d(spark, 16))
    b = spark.range(17).select(F.col("id").alias("r"), (F.col("id") % 3).cast("double").alias("v"))
    x = linear.conjugate_gradients(m, b, precondition=True)
    assert linear.square_norm(linear.residual(m, x, b)).first()[0] < 1e-12
    assert linear.asymmetry(m) < 1e-12


def test_save_and_load(spark, tmp_path):
    im = apps.poisson(apps.sphere(spark, 3000, color=True), 3, 3, aux=("red",))
    im.save(spark, str(tmp_path))
    back = apps.Implicit.load(spark, str(tmp_path))
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.95, 0.0, 0.0)], "p int, x double, y double, z double")
    assert im.evaluate(at, "p").orderBy("p").collect() == back.evaluate(at, "p").orderBy("p").collect()
    assert back.aux_at(at, "p").count() == 2


def test_designators_of_a_box(spark):
    from voxelark.operators import envelope

    v, f = box(spark)
    t = mesh.triangulate(v, f)
    s = apps.area_samples(v, t, 0.02).select(*((F.col(a) * 0.5 + 0.25).alias(u) for a, u in zip("xyz", "uvw", strict=True)))
    cells = envelope.designators(envelope.touched_cells(s, 4), 4)
    n = {r["geometry"]: r["count"] for r in cells.filter("d = 4").groupBy("geometry").count().collect()}
    assert n["interior"] >= 6**3 and n["exterior"] >= 16**3 - 10**3 and sum(n.values()) == 16**3
    assert cells.filter("d = 0").first()["geometry"] == "boundary"
    locked = envelope.locked_corners(envelope.eroded(cells, envelope.touched_cells(s, 4)), 4)
    assert 0 < locked.count() < 17**3


def test_simplex_cells_hold_all_points_of_a_triangle(spark):
    from voxelark.operators import envelope
    from voxelark.operators.cells import with_cell

    t = spark.createDataFrame([(0, 0.1, 0.2, 0.3, 0.9, 0.3, 0.2, 0.4, 0.8, 0.7)], "fid long, " + ", ".join(f"{c}{n} double" for n in range(3) for c in "uvw"))
    got = envelope.simplex_cells(t, 4).drop("fid")
    r = np.random.default_rng(0).dirichlet((1, 1, 1), 3000)
    p = r @ np.array([[0.1, 0.2, 0.3], [0.9, 0.3, 0.2], [0.4, 0.8, 0.7]])
    inside = with_cell(spark.createDataFrame(pd.DataFrame(p, columns=list("uvw"))), 4).select("d", "i", "j", "k").distinct()
    assert inside.join(got, ["d", "i", "j", "k"], "left_anti").count() == 0
    assert got.count() < 3 * inside.count()


def test_sphere_is_closed_and_round(spark):
    im = apps.poisson(apps.sphere(spark, 10_000), 4, 4)
    v, f = im.surface()
    assert mesh.edges(f).filter("n <> 2").count() == 0
    r = v.select(F.sqrt(F.expr("x*x + y*y + z*z")).alias("r"), F.expr("(x*nx + y*ny + z*nz)").alias("out") if "nx" in v.columns else F.lit(1.0).alias("out")).agg(F.min("r"), F.max("r")).first()
    assert 0.97 < r[0] and r[1] < 1.03
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.09, 1.09, 1.09), (2, 9.0, 0.0, 0.0)], "k int, x double, y double, z double")
    a, b, c = (x["value"] for x in im.evaluate(at, "k").orderBy("k").collect())
    assert a > im.level > b and c is None


def test_smooth_reconstruction_tells_inside_from_outside(spark):
    im = apps.poisson(apps.sphere(spark, 5000), 4, 4, smooth=True)
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.09, 0.0, 0.0)], "p int, x double, y double, z double")
    a, b = (x["value"] for x in im.evaluate(at, "p").orderBy("p").collect())
    assert (a - im.level) * (b - im.level) < 0


def test_smooth_surface_is_one_closed_sphere(spark):
    v, f = apps.poisson(apps.sphere(spark, 10_000), 4, 4, smooth=True).surface()
    assert mesh.edges(f).filter("n <> 2").count() == 0
    r = v.select(F.sqrt(F.expr("x*x + y*y + z*z")).alias("r")).agg(F.min("r"), F.max("r")).first()
    assert 0.98 < r[0] and r[1] < 1.02


def test_sparse_parts_are_closed_at_a_fine_depth(spark):
    """Points so far apart on one half that their cells at the finest depth don't touch."""
    p = apps.sphere(spark, 20_000).filter("x > 0 OR pid % 50 = 0")
    v, f = apps.poisson(p, 5, 5).surface()
    assert mesh.edges(f).filter("n <> 2").count() == 0
    r = v.select(F.sqrt(F.expr("x*x + y*y + z*z")).alias("r")).agg(F.min("r"), F.max("r")).first()
    assert 0.9 < r[0] and r[1] < 1.1


def test_samples_of_low_depth_can_be_left_out(spark):
    """A point near a corner of the cube, far from a dense sphere: left out, it keeps only its small part in the density."""
    at = spark.createDataFrame([(100_000 + n, 0.9 + n / 100, 0.9, 0.9, 1.0, 0.0, 0.0) for n in range(1)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    s = apps.sphere(spark, 10_000)
    al = unit_cube(s)
    value = lambda p, c: apps.poisson(p, 4, 4, cut_off=c, alignment=al).evaluate(at, "pid").agg(F.avg("value")).first()[0]
    alone, whole, cut = value(s, 5.0), value(s.unionByName(at), 0.0), value(s.unionByName(at), 5.0)
    assert 10 * abs(cut - alone) < abs(whole - alone)


def test_vectors_of_coarse_cells_load_fine_corners(spark):
    """One constant vector in the whole cube, given at depth 1, pulls as it does given at depth 3."""
    one = lambda d: fem.full_level(spark, d, ("i", "j")).withColumns({"vx": F.lit(1.0), "vy": F.lit(-2.0)})
    got = fem.coarser_loads(fem.full_level(spark, 3, ("i", "j")).select("i", "j"), 3, one(1), ("vx", "vy"), ("i", "j"))
    want = fem.divergence(one(3), 3, ("vx", "vy"), ("i", "j"))
    assert got.join(want.withColumnRenamed("v", "y"), ["i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("y"))), F.count("y")).first() == (0.0, 81)


def test_distance_grows_away_from_the_mesh(spark):
    v, f = box(spark)
    d = apps.distance_transform(v, mesh.triangulate(v, f), 4)
    at = spark.createDataFrame([(0, 1.0, 0.5, 0.5), (1, 1.2, 0.5, 0.5), (2, 1.4, 0.5, 0.5)], "p int, x double, y double, z double")
    x = [r["value"] for r in d.evaluate(at, "p").orderBy("p").collect()]
    assert x[0] < x[1] < x[2]


def test_colours_are_read_at_every_point(spark):
    from voxelark.plans import field_queries

    assert field_queries.interpolated_colors(spark, "").first()["n"] == 3000


def test_joined_meshes_keep_their_ids_apart(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, [0, 0, 0])], "fid long, ids array<long>")
    vertices, faces = mesh.concatenate([(v, f), (v.filter("false"), f.filter("false")), (v, f)])
    assert [r["vid"] for r in vertices.orderBy("vid").collect()] == [0, 1]
    assert [tuple(r) for r in faces.orderBy("fid").collect()] == [(0, [0, 0, 0]), (1, [1, 1, 1])]
