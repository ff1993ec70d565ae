"""Queries of grids, level sets and fields; applications over generated shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fem, levelset
from ..registry import query
from . import apps
from .data import q, quant

W = 24

_G = f"""r AS (SELECT CAST(range AS INTEGER) AS i FROM range({W})), n AS (SELECT a.i, b.i AS j FROM r a, r b),
s AS (SELECT CAST(event_id % {W} AS INTEGER) i, CAST(user_id % {W} AS INTEGER) j, avg(value) m FROM events GROUP BY 1, 2),
g AS (SELECT n.i, n.j, coalesce(m, 0.0) AS val FROM n LEFT JOIN s USING (i, j)), mid AS (SELECT avg(val) iso FROM g)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = t.groupBy((F.col("event_id") % W).cast("int").alias("i"), (F.col("user_id") % W).cast("int").alias("j")).agg(F.avg("value").alias("m"))
    n = spark.range(W * W).select(F.floor(F.col("id") / W).cast("int").alias("i"), (F.col("id") % W).cast("int").alias("j"))
    return n.join(m, ["i", "j"], "left").select("i", "j", F.coalesce("m", F.lit(0.0)).alias("val"))


@query(f"WITH {_G} SELECT {q('avg(val)')} mean, {q('stddev_pop(val)')} deviation FROM g")
def grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fem.grid_statistics(grid(spark, sf_dir)).select(quant(F.col("mean")).alias("mean"), quant(F.col("deviation")).alias("deviation"))


@query(f"""WITH {_G}, t AS (SELECT avg(val) m, stddev_pop(val) d FROM g)
SELECT i, j, CAST(floor((greatest(-1.0, least(1.0, (val - m) / (2 * d))) + 1) / 2 * 255 + 0.3719) AS INTEGER) AS grey FROM g, t""")
def grey_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fem.grey(grid(spark, sf_dir)).select("i", "j", F.floor(F.col("grey") + 0.3719).cast("int").alias("grey"))


@query(f"""WITH {_G}, p AS (SELECT event_id, (event_id * 7 % 1000) / 1000.0::DOUBLE * {W - 2} AS x, (user_id * 13 % 1000) / 1000.0::DOUBLE * {W - 2} AS y FROM events),
c AS (SELECT event_id, CAST(floor(x) AS INTEGER) i, CAST(floor(y) AS INTEGER) j, x - floor(x) s, y - floor(y) t FROM p)
SELECT event_id, {q('sum(val * w)')} val FROM (SELECT event_id, i + a AS i, j + b AS j, (CASE WHEN a = 1 THEN s ELSE 1 - s END) * (CASE WHEN b = 1 THEN t ELSE 1 - t END) AS w FROM c, (SELECT unnest([0, 1]) a), (SELECT unnest([0, 1]) b)) JOIN g USING (i, j) GROUP BY event_id""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    x, y = (F.col("event_id") * 7 % 1000) / F.lit(1000.0) * (W - 2), (F.col("user_id") * 13 % 1000) / F.lit(1000.0) * (W - 2)
    return fem.sample_grid(t.select("event_id", x.alias("x"), y.alias("y")), grid(spark, sf_dir), "event_id").select("event_id", quant(F.col("val")).alias("val"))


@query(f"""WITH {_G}, e AS (SELECT 0 AS axis, a.i, a.j, a.val va, b.val vb FROM g a JOIN g b ON b.i = a.i + 1 AND b.j = a.j UNION ALL SELECT 1, a.i, a.j, a.val, b.val FROM g a JOIN g b ON b.i = a.i AND b.j = a.j + 1)
SELECT axis, i, j, {q('CASE WHEN va = vb THEN 0.5 ELSE (iso - va) / (vb - va) END')} t FROM e, mid WHERE (va > iso) <> (vb > iso)""")
def level_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    iso = g.agg(F.avg("val")).first()[0]
    return levelset.crossing_edges(g, iso, ("i", "j")).select("axis", "i", "j", quant(F.col("t")).alias("t"))


@query(f"""WITH {_G}, c AS (SELECT a.i, a.j, a.val > iso p, b.val > iso q, c.val > iso r, d.val > iso s FROM g a JOIN g b ON b.i = a.i + 1 AND b.j = a.j JOIN g c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN g d ON d.i = a.i AND d.j = a.j + 1, mid)
SELECT CAST(p AS INTEGER) + 2 * CAST(q AS INTEGER) + 8 * CAST(r AS INTEGER) + 4 * CAST(s AS INTEGER) AS square, count(*) n,
  CAST(sum((CAST(p <> q AS INTEGER) + CAST(q <> r AS INTEGER) + CAST(r <> s AS INTEGER) + CAST(s <> p AS INTEGER)) // 2) AS BIGINT) segments FROM c GROUP BY 1""")
def marching_squares_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    iso = g.agg(F.avg("val")).first()[0]
    c = levelset.cells_with_corners(g, ("i", "j")).select(levelset.square_index(F.col("c"), iso).alias("square"))
    cases = [(k, len(levelset.square_segments((bool(k & 1), bool(k & 2), bool(k & 8), bool(k & 4))))) for k in range(16)]
    table = spark.createDataFrame(cases, "square int, s int")
    return c.join(F.broadcast(table), "square").groupBy("square").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("segments"))


@query(f"""WITH {_G}, c AS (SELECT (a.val > iso) p, (b.val > iso) q, (c.val > iso) r, (d.val > iso) s FROM g a JOIN g b ON b.i = a.i + 1 AND b.j = a.j JOIN g c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN g d ON d.i = a.i AND d.j = a.j + 1, mid)
SELECT CAST(sum((CAST(p <> q AS INTEGER) + CAST(q <> r AS INTEGER) + CAST(r <> s AS INTEGER) + CAST(s <> p AS INTEGER)) // 2) AS BIGINT) AS segments FROM c""")
def marching_squares_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return levelset.curve(g, g.agg(F.avg("val")).first()[0])[1].agg(F.count(F.lit(1)).alias("segments"))


_PX = """px AS (SELECT CAST(l_orderkey % 24 AS INTEGER) AS "row", CAST(l_linenumber % 24 AS INTEGER) AS col, CAST(CAST(sum(l_suppkey) AS BIGINT) % 3 AS INTEGER) - 1 AS label, avg(l_quantity) AS val FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_PX} SELECT a."row", a.col, d AS dir, {q('b.val - a.val')} AS change FROM px a, (SELECT unnest([0, 1]) d) JOIN px b ON b."row" = a."row" + d AND b.col = a.col + 1 - d WHERE a.label <> b.label AND a.label >= 0 AND b.label >= 0""")
def label_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    px = t.groupBy((F.col("l_orderkey") % 24).cast("int").alias("row"), (F.col("l_linenumber") % 24).cast("int").alias("col")).agg(((F.sum("l_suppkey") % 3).cast("int") - 1).alias("label"), F.avg("l_quantity").alias("val"))
    return apps.label_seams(px).select("row", "col", "dir", quant(F.col("change")).alias("change"))


@query("SELECT * FROM (VALUES (0, 1), (1, 1), (2, 1), (3, -1)) t(k, close)")
def point_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x^2 + y^2 through a thousand points of the square, held against its values; nothing outside."""
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1
    p = spark.range(1000).select(unit(1).alias("x"), unit(2).alias("y")).withColumn("value", F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.5, 0.0, 0.25), (2, 0.5, 0.5, 0.5), (3, 2.0, 2.0, 0.0)], "k int, x double, y double, true_value double")
    return apps.fit(p).evaluate(at, "k").join(at, "k").select("k", F.when(F.col("value").isNull(), -1).when(F.abs(F.col("value") - F.col("true_value")) < 1e-3, 1).otherwise(0).alias("close"))


@query("SELECT true AS closed, true AS near")
def reconstruct_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit sphere from 10,000 oriented points: is the surface closed and its radius right to 3 %?"""
    from ..operators import mesh

    v, f = apps.poisson(apps.sphere(spark, 10_000), 4, 4).surface()
    r = v.agg(F.min("r").alias("a"), F.max("r").alias("b")) if "r" in v.columns else v.select(F.sqrt(F.expr("x*x + y*y + z*z")).alias("r")).agg(F.min("r").alias("a"), F.max("r").alias("b"))
    open_edges = mesh.edges(f).agg(F.bool_and(F.col("n") == 2).alias("closed"))
    return open_edges.crossJoin(F.broadcast(r)).select("closed", ((F.col("a") > 0.97) & (F.col("b") < 1.03)).alias("near"))


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, false)) t(p, inside)")
def reconstruct_smooth_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with values and gradients fitted under a curvature term: field values inside and outside the sphere."""
    im = apps.poisson(apps.sphere(spark, 10_000), 4, 4, smooth=True)
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.9, 0.0, 0.0), (2, 1.09, 0.0, 0.0)], "p int, x double, y double, z double")
    return im.evaluate(at, "p").select("p", (F.col("value") > im.level).alias("inside"))


@query("SELECT true AS closed, true AS near")
def reconstruct_uneven_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sphere with a fiftieth of the points on one half, one level over the base: is the surface closed and its radius right to a tenth?"""
    from ..operators import mesh

    v, f = apps.poisson(apps.sphere(spark, 20_000).filter("x > 0 OR pid % 50 = 0"), 5, 4).surface()
    r = v.select(F.sqrt(F.expr("x*x + y*y + z*z")).alias("r")).agg(F.min("r").alias("a"), F.max("r").alias("b"))
    return mesh.edges(f).agg(F.bool_and(F.col("n") == 2).alias("closed")).crossJoin(F.broadcast(r)).select("closed", ((F.col("a") > 0.9) & (F.col("b") < 1.1)).alias("near"))


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, true), (3, true)) t(k, near)")
def gradient_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x^2 + y^2 through sixty points with their slopes, one level over the base: values between them right to 0.01?"""
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1
    p = spark.range(60).select(unit(1).alias("x"), unit(2).alias("y"))
    p = p.withColumns({"value": F.expr("x * x + y * y"), "gx": F.col("x") * 2, "gy": F.col("y") * 2})
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.5, 0.0, 0.25), (2, 0.5, 0.5, 0.5), (3, -0.7, 0.6, 0.85)], "k int, x double, y double, true_value double")
    return apps.fit(p, base=5, gradient_weight=1000.0).evaluate(at, "k").join(at, "k").select("k", (F.abs(F.col("value") - F.col("true_value")) < 0.01).alias("near"))


@query("SELECT 3000::BIGINT AS n, true AS inside, true AS banded")
def interpolated_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of a banded sphere read at its own points: weighted means, so inside the range of the data and mostly of their own band."""
    p = apps.sphere(spark, 3000, color=True)
    im = apps.poisson(p, 4, 4, aux=("red", "green", "blue"))
    got = im.aux_at(p, "pid").join(p.select("pid", "x"), "pid")
    own = F.when(F.col("x") < -1 / 3, F.col("red")).when(F.col("x") < 1 / 3, F.col("green")).otherwise(F.col("blue"))
    inside = F.least("red", "green", "blue") >= -1e-6
    return got.agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside & (F.greatest("red", "green", "blue") <= 255 + 1e-6)).alias("inside"), (F.avg((own > 127).cast("int")) > 0.9).alias("banded"))


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, true)) t(p, near)")
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to a reconstructed sphere's surface, on it, outside and inside: right to a fifth?"""
    v, f = apps.poisson(apps.sphere(spark, 5000), 4, 4).surface()
    at = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 1.5, 0.0, 0.0), (2, 0.5, 0.0, 0.0)], "p int, x double, y double, z double")
    true_distance = F.when(F.col("p") == 0, 0.0).otherwise(0.5)
    return apps.distance_transform(v, f, 4).evaluate(at, "p").select("p", (F.abs(F.col("value") - true_distance) < 0.2).alias("near"))


@query("SELECT 0.0::DOUBLE AS spread, 64::BIGINT AS n")
def stitched_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of an image a constant apart, stitched: spread of what was constant."""
    px = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"))
    px = px.select("row", "col", (F.col("col") >= 3).cast("int").alias("label"), F.when(F.col("col") >= 3, 50.0).otherwise(10.0).alias("val"))
    return apps.stitch(px).agg(quant(F.stddev_pop("val"), 2).alias("spread"), F.count("val").alias("n"))


@query()
def trimmed_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid mesh of line items trimmed at its middle value, small parts merged: faces and area."""
    from ..operators import mesh
    from .mesh_queries import mesh as grid_mesh

    v, f = apps.trim_surface(*grid_mesh(spark, sf_dir), 25.5)
    return mesh.polygon_areas(f, v).agg(F.count(F.lit(1)).alias("faces"), quant(F.sum("area"), 2).alias("area"))


@query("""WITH px AS (SELECT CAST(a.range AS INTEGER) i, CAST(b.range AS INTEGER) j FROM range(16) a, range(16) b), l AS (SELECT i, j, CASE WHEN i < 8 AND j < 8 THEN 100 + (i // 4) * 10 + j // 4 ELSE (i // 8) * 10 + j // 8 END leaf FROM px)
SELECT l.i, l.j, coalesce(l.leaf <> r.leaf, false) OR coalesce(l.leaf <> b.leaf, false) AS border FROM l LEFT JOIN l r ON r.i = l.i + 1 AND r.j = l.j LEFT JOIN l b ON b.i = l.i AND b.j = l.j + 1""")
def leaf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell borders of an adaptive tree on a regular grid: where right or lower neighbours lie in different leaves."""
    t = spark.createDataFrame([(0, 0, 0)] + [(1, i, j) for i in (0, 1) for j in (0, 1)] + [(2, i, j) for i in (0, 1) for j in (0, 1)], "d int, i int, j int")
    return fem.cell_borders(t, 4)
