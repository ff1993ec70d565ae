"""Queries of finite-element fields in the plane: two levels of corner values from line items, read at events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, splines
from ..operators import cells, fem, linear
from ..operators import density as den
from ..registry import query
from .cell_queries import _KERNEL, _SAMPLES, _TARGET, _spn
from .data import U, cell_sql, cells_cte, q, quant, spline_cte, unit_points

IJ = ("i", "j")

_F = """fd AS (SELECT 2 AS d, CAST(l_orderkey % 5 AS INTEGER) i, CAST(l_partkey % 5 AS INTEGER) j, avg(l_quantity) / 10 v FROM lineitem GROUP BY 1, 2, 3
UNION ALL SELECT 3, CAST(l_orderkey % 9 AS INTEGER), CAST(l_partkey % 9 AS INTEGER), avg(l_quantity) / 100 FROM lineitem GROUP BY 1, 2, 3),
pts AS (SELECT event_id, (event_id * 7 % 1000) / 1000.0::DOUBLE u, (user_id * 13 % 1000) / 1000.0::DOUBLE v, CAST(event_id % 5 + 1 AS DOUBLE) weight FROM events),
hat AS (SELECT event_id, weight, fd.d, greatest(1 - abs(u * pow(2, fd.d) - i), 0) * greatest(1 - abs(pts.v * pow(2, fd.d) - j), 0) * fd.v AS y FROM pts, fd),
val AS (SELECT event_id, any_value(weight) weight, sum(y) y, sum(y) FILTER (WHERE d = 2) coarse FROM hat GROUP BY 1)"""
#: Values of the whole field at the corners of depth 3, and products of hats along an axis there.
_WHOLE = _F + """, n9 AS (SELECT a.range AS i, b.range AS j FROM range(9) a, range(9) b),
fine AS (SELECT n9.i, n9.j, coalesce(any_value(f.v), 0) + sum(coalesce(c.v, 0) * greatest(1 - abs(n9.i / 2.0 - c.i), 0) * greatest(1 - abs(n9.j / 2.0 - c.j), 0)) v
  FROM n9 LEFT JOIN fd f ON f.d = 3 AND f.i = n9.i AND f.j = n9.j JOIN fd c ON c.d = 2 GROUP BY 1, 2),
ax AS (SELECT a.range AS p, b.range AS r, CASE WHEN a.range <> b.range THEN 1 / 48.0 WHEN a.range IN (0, 8) THEN 1 / 24.0 ELSE 1 / 12.0 END::DOUBLE m,
  CASE WHEN a.range <> b.range THEN -8.0 WHEN a.range IN (0, 8) THEN 8.0 ELSE 16.0 END::DOUBLE k FROM range(9) a, range(9) b WHERE abs(a.range - b.range) <= 1),
st AS (SELECT x.p AS i, y.p AS j, x.r AS i2, y.r AS j2, x.m * y.m AS m, x.k * y.m + x.m * y.k AS k FROM ax x, ax y)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    level = lambda d, n, s: t.groupBy((F.col("l_orderkey") % n).cast("int").alias("i"), (F.col("l_partkey") % n).cast("int").alias("j")).agg((F.avg("l_quantity") / s).alias("v")).select(F.lit(d).alias("d"), "i", "j", "v")
    return level(2, 5, 10).union(level(3, 9, 100))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select("event_id", (F.col("event_id") * 7 % 1000 / 1000.0).alias("u"), (F.col("user_id") * 13 % 1000 / 1000.0).alias("v"), (F.col("event_id") % 5 + 1).cast("double").alias("weight"))


@query(f"WITH {_F} SELECT event_id, {q('y')} AS val FROM val")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fem.evaluate(places(spark, sf_dir), field(spark, sf_dir), "event_id", 2, 3, 2).select("event_id", quant(F.col("value")).alias("val"))


@query(f"WITH {_F} SELECT event_id, {q('coarse')} AS coarse, {q('y - coarse')} AS finer FROM val")
def partial_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the coarse level and the finer one each add at points."""
    p, f = places(spark, sf_dir), field(spark, sf_dir)
    a = fem.evaluate(p, fem.trim_to(f, 2), "event_id", 2, 2, 2).withColumnRenamed("value", "a")
    b = fem.evaluate(p, f.filter("d = 3"), "event_id", 3, 3, 2).withColumnRenamed("value", "b")
    return a.join(b, "event_id").select("event_id", quant(F.col("a")).alias("coarse"), quant(F.col("b")).alias("finer"))


@query(f"""WITH {_F}, spot AS (SELECT event_id, u, v, d, {cell_sql('u', 'd')} ci, {cell_sql('v', 'd')} cj FROM pts, (SELECT unnest([2, 3]) d)),
g AS (SELECT event_id, sum((CASE WHEN f.i > ci THEN 1 ELSE -1 END) * pow(2, spot.d) * (1 - abs(spot.v * pow(2, spot.d) - f.j)) * f.v) gi, sum((CASE WHEN f.j > cj THEN 1 ELSE -1 END) * pow(2, spot.d) * (1 - abs(u * pow(2, spot.d) - f.i)) * f.v) gj
  FROM spot JOIN fd f ON f.d = spot.d AND f.i BETWEEN ci AND ci + 1 AND f.j BETWEEN cj AND cj + 1 GROUP BY 1) SELECT event_id, {q('gi')} gi, {q('gj')} gj FROM g""")
def field_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fem.evaluate(places(spark, sf_dir), field(spark, sf_dir), "event_id", 2, 3, 2, gradient=True)
    return g.select("event_id", quant(F.col("gi")).alias("gi"), quant(F.col("gj")).alias("gj"))


@query(f"WITH {_F} SELECT {q('sum(y * weight) / sum(weight)', 6)} AS iso FROM val")
def iso_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean of a field at samples."""
    level = fem.average_at(places(spark, sf_dir).withColumnRenamed("event_id", "key"), field(spark, sf_dir), 2, 3, 2)
    return spark.createDataFrame([(level,)], "iso double").select(quant(F.col("iso"), 6).alias("iso"))


_upto = "(CASE WHEN {t} < 0 THEN pow(1 + {t}, 2) / 2 ELSE 1 - pow(1 - {t}, 2) / 2 END)"
_part = lambda a, x: _upto.format(t=f"greatest(-1.0, least(1.0, {x} * pow(2, d) - {a}))")


@query(f"WITH {_F} SELECT {q('sum(v * (' + _part('i', 0.7) + ' - ' + _part('i', 0.1) + ') * (' + _part('j', 0.9) + ' - ' + _part('j', 0.2) + ') * pow(4, -d)) / (0.6 * 0.7)', 6)} AS mean FROM fd")
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fem.box_average(field(spark, sf_dir), IJ, (0.1, 0.2), (0.7, 0.9)).select(quant(F.col("mean"), 6).alias("mean"))


@query(f"WITH {_F} SELECT d, i, {q('sum(v * (1 - abs(0.37 * pow(2, d) - j)))')} v FROM fd WHERE abs(0.37 * pow(2, d) - j) < 1 GROUP BY 1, 2")
def axis_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field on a line across its last axis."""
    return fem.slice_values(field(spark, sf_dir), 0.37, 2).select("d", "i", quant(F.col("v")).alias("v"))


@query(f"WITH {_F} SELECT d, i, j, {q('sum(v)')} v FROM (SELECT * FROM fd UNION ALL SELECT d, i, j, -2 * v FROM fd WHERE d = 3 AND i < 5) GROUP BY 1, 2, 3")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = field(spark, sf_dir)
    other = f.filter("d = 3 AND i < 5").withColumn("v", F.col("v") * -2)
    return fem.merged(f, other).select("d", "i", "j", quant(F.col("v")).alias("v"))


def _out(x: DataFrame) -> DataFrame:
    return x.select(*(c for c in x.columns if c != "v"), quant(F.col("v")).alias("v"))


@query(f"WITH {_WHOLE} SELECT CAST(i AS INTEGER) i, CAST(j AS INTEGER) j, {q('v')} v FROM fine")
def cumulative_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels as values of the finest."""
    return _out(fem.cumulative(field(spark, sf_dir), 2, 3, IJ))


@query(f"WITH {_WHOLE} SELECT CAST(n9.i AS INTEGER) i, CAST(n9.j AS INTEGER) j, {q('sum(c.v * greatest(1 - abs(n9.i / 2.0 - c.i), 0) * greatest(1 - abs(n9.j / 2.0 - c.j), 0))')} v FROM n9 JOIN fd c ON c.d = 2 AND abs(n9.i / 2.0 - c.i) < 1 AND abs(n9.j / 2.0 - c.j) < 1 GROUP BY 1, 2")
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fem.finer_level(field(spark, sf_dir).filter("d = 2").select("i", "j", "v"), 2, IJ))


@query(f"WITH {_WHOLE}, n5 AS (SELECT a.range AS i, b.range AS j FROM range(5) a, range(5) b) SELECT CAST(n5.i AS INTEGER) i, CAST(n5.j AS INTEGER) j, {q('sum(c.v * greatest(1 - abs(c.i / 2.0 - n5.i), 0) * greatest(1 - abs(c.j / 2.0 - n5.j), 0))')} v FROM n5 JOIN fd c ON c.d = 3 AND abs(c.i / 2.0 - n5.i) < 1 AND abs(c.j / 2.0 - n5.j) < 1 GROUP BY 1, 2")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right side on the next coarser corners."""
    return _out(fem.restrict(field(spark, sf_dir).filter("d = 3").select("i", "j", "v"), IJ))


@query(f"WITH {_WHOLE} SELECT CAST(st.i2 AS INTEGER) i, CAST(st.j2 AS INTEGER) j, {q('sum((2 * st.m + st.k) * f.v)')} v FROM st JOIN fd f ON f.d = 3 AND f.i = st.i AND f.j = st.j GROUP BY 1, 2")
def system_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass and stiffness stencils on the corners of one level."""
    return _out(fem.apply_system(field(spark, sf_dir).filter("d = 3").select("i", "j", "v"), 3, 2.0, 1.0, IJ))


@query(f"WITH {_WHOLE} SELECT {q('sum((st.m + 0.5 * st.k) * a.v * b.v)')} product FROM st JOIN fine a ON a.i = st.i AND a.j = st.j JOIN fine b ON b.i = st.i2 AND b.j = st.j2")
def field_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's inner product with itself, across levels."""
    f = field(spark, sf_dir)
    return fem.inner_product(f, f, 2, 3, IJ, 1.0, 0.5).select(quant(F.col("product")).alias("product"))


@query(f"WITH {_F} SELECT {q('sum(weight * y * coarse)', 2)} product FROM val")
def point_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = field(spark, sf_dir)
    return fem.point_product(places(spark, sf_dir), f, fem.trim_to(f, 2), "event_id", 2, 3, 2).select(quant(F.col("product"), 2).alias("product"))


_QUAD = [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 0, 1), (2, 1, 0), (2, 1, 1)]


@query(f"""WITH {_F}, leaf AS (SELECT * FROM (VALUES {", ".join(map(str, [c for c in _QUAD if c[0] and c != (1, 0, 0)]))}) t(ld, li, lj))
SELECT ld AS d, li AS i, lj AS j, {q('sum(v * greatest(1 - abs((li + 0.5) / pow(2, ld) * pow(2, d) - i), 0) * greatest(1 - abs((lj + 0.5) / pow(2, ld) * pow(2, d) - j), 0))')} AS val FROM leaf, fd GROUP BY 1, 2, 3""")
def leaf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = spark.createDataFrame(_QUAD, "d int, i int, j int")
    return fem.leaf_values(field(spark, sf_dir), tree, 2, 3, IJ).select("d", "i", "j", quant(F.col("value")).alias("val"))


@query(f"""WITH {_F}, n AS (SELECT a.range AS gi, b.range AS gj FROM range(16) a, range(16) b)
SELECT CAST(gi AS INTEGER) i, CAST(gj AS INTEGER) j, {q('sum(v * greatest(1 - abs((gi + 0.5) / 16 * pow(2, d) - i), 0) * greatest(1 - abs((gj + 0.5) / 16 * pow(2, d) - j), 0))')} AS val FROM n, fd GROUP BY 1, 2""")
def grid_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field at the cell centres of a regular grid finer than its own."""
    return fem.grid_values(spark, field(spark, sf_dir), 2, 3, 4, 2, dual=True).select("i", "j", quant(F.col("val")).alias("val"))


@query(f"""WITH {cells_cte(4)}, t AS (SELECT DISTINCT i, j FROM c WHERE x > 40 AND a < 0.03), o AS (SELECT i + a AS i, j + b AS j FROM t, (SELECT unnest([0, 1]) a), (SELECT unnest([0, 1]) b))
SELECT 4 AS d, CAST(i AS INTEGER) i, CAST(j AS INTEGER) j, {q('count(*) / any_value((CASE WHEN i IN (0, 16) THEN 1.0 ELSE 2.0 END) * (CASE WHEN j IN (0, 16) THEN 1.0 ELSE 2.0 END))')} weight FROM o GROUP BY 2, 3""")
def support_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each hat that cells with points cover."""
    t = cells.with_cell(unit_points(spark, sf_dir).filter("x > 40 AND a < 0.03"), 4).select("d", "i", "j").distinct()
    return fem.support_weights(t, IJ).select("d", "i", "j", quant(F.col("weight")).alias("weight"))


@query(f"""WITH {_F}, p AS (SELECT {cell_sql('u', '3')} i, {cell_sql('v', '3')} j, weight w, u, v, weight * 2 AS target FROM pts)
SELECT 3 AS d, i, j, {q('sum(w)')} weight, {q('sum(w * u) / sum(w)')} u, {q('sum(w * v) / sum(w)')} v, {q('sum(w * target) / sum(w)')} target FROM p GROUP BY i, j""")
def point_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as one constraint a cell."""
    t = fem.point_terms(places(spark, sf_dir).withColumn("target", F.col("weight") * 2), 3, IJ)
    return t.select("d", "i", "j", *(quant(F.col(c)).alias(c) for c in ("weight", "u", "v", "target")))


@query(f"""WITH {_F}, p AS (SELECT {cell_sql('u', '3')} i, {cell_sql('v', '3')} j, avg(weight) vx, avg(u) vy FROM pts GROUP BY 1, 2)
SELECT CAST(i + a AS INTEGER) i, CAST(j + b AS INTEGER) j, {q('sum(vx * (2 * a - 1) + vy * (2 * b - 1)) / 16')} v FROM p, (SELECT unnest([0, 1]) a), (SELECT unnest([0, 1]) b) GROUP BY 1, 2""")
def divergence_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell field's inner products with the gradients of hats."""
    c = cells.with_cell(places(spark, sf_dir), 3, ("u", "v"), IJ).groupBy("i", "j").agg(F.avg("weight").alias("vx"), F.avg("u").alias("vy"))
    return _out(fem.divergence(c, 3, ("vx", "vy"), IJ))


@query(f"""WITH {cells_cte(4)} SELECT CAST((k % 3 * 3 + j % 3) * 3 + i % 3 AS INTEGER) color, count(*) n FROM (SELECT DISTINCT i, j, k FROM c) GROUP BY 1""")
def colored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the colour in which a sweep may treat them at once."""
    c = cells.with_cell(unit_points(spark, sf_dir), 4).select("i", "j", "k").distinct()
    return c.groupBy(linear.color(("i", "j", "k"), 3).alias("color")).agg(F.count(F.lit(1)).alias("n"))


_DW = f"""{_SAMPLES}, f AS (SELECT *, lead(spn) OVER (PARTITION BY key ORDER BY d) finer FROM spn), pick AS (SELECT key, max(d) d FROM f WHERE spn >= {_TARGET} OR d = 0 GROUP BY key),
dw AS (SELECT key, CASE WHEN d = {_KERNEL} THEN d + ln(spn / {_TARGET}) / (ln(2.0) * 2) ELSE d + ln(spn / {_TARGET}) / ln(spn / finer) END depth, pow(pow(2.0, -d), 2.0) / spn weight FROM f JOIN pick USING (key, d))"""


def _dw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = den.samples(unit_points(spark, sf_dir), _KERNEL + 1, F.lit(1.0))
    return den.depth_and_weight(_spn(spark, sf_dir), "key", _TARGET, _KERNEL), s.withColumn("key", F.expr("i * 289 + j * 17 + k"))


@query(f"WITH {_DW} SELECT key FROM dw WHERE depth >= 4.5")
def deep_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that a depth cut-off keeps."""
    return den.deep_enough(_dw(spark, sf_dir)[0], 4.5).select("key")


@query(f"WITH {_DW}, own AS (SELECT i * 289 + j * 17 + k AS key, n FROM g) SELECT {q('sum(depth * n) / sum(n)', 3)} depth, {q('sum(weight * n) / sum(n)', 6)} weight FROM dw JOIN own USING (key)")
def mean_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = den.mean_depth_and_weight(*_dw(spark, sf_dir), "key")
    return m.select(quant(F.col("depth"), 3).alias("depth"), quant(F.col("weight"), 6).alias("weight"))


@query(f"""WITH {_DW}, own AS (SELECT i * 289 + j * 17 + k AS key, n, u, v, w FROM g), spot AS (SELECT dw.weight * n * pow(8.0, greatest(least(ceil(depth), 4), 2)) AS vx, CAST(greatest(least(ceil(depth), 4), 2) AS INTEGER) d, u, v, w FROM dw JOIN own USING (key)),
put AS (SELECT d, vx, u, v, w, {cell_sql('u', 'd')} i, {cell_sql('v', 'd')} j, {cell_sql('w', 'd')} k FROM spot), {spline_cte('put', 2, 'vx', 'vs')}
SELECT d, i, j, k, {q('sum(basis * vx)', 2)} vx FROM vs GROUP BY 1, 2, 3, 4""")
def adaptive_splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors splatted at the depth that the density about them suggests."""
    dw, s = _dw(spark, sf_dir)
    s = s.select("key", "u", "v", "w", F.col("weight").alias("n"), F.lit(0.0).alias("zero"))
    return den.vector_field(s, dw, "key", ("n", "zero", "zero"), 2, 4).select("d", "i", "j", "k", quant(F.col("vx"), 2).alias("vx"))


@query(f"""WITH x AS (SELECT (range + 0.5) / 10 AS t FROM range(10)), s AS (SELECT pow((1 - t) * (1 - t) / 2, 2) + pow((1 + 2 * t - 2 * t * t) / 2, 2) + pow(t * t / 2, 2) a FROM x) SELECT {q('avg(1 / a)', 8)} scale FROM s""")
def density_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(splines.density_scale(),)], "scale double").select(quant(F.col("scale"), 8).alias("scale"))


_sp = "(CASE WHEN t < 0 OR t >= 3 THEN 0 WHEN t < 1 THEN t * t / 2 WHEN t < 2 THEN -t * t + 3 * t - 1.5 ELSE (3 - t) * (3 - t) / 2 END)"
_ds = "(CASE WHEN t < 0 OR t >= 3 THEN 0 WHEN t < 1 THEN t WHEN t < 2 THEN 3 - 2 * t ELSE t - 3 END)"
_is = "(CASE WHEN t <= 0 THEN 0 WHEN t < 1 THEN pow(t, 3) / 6 WHEN t < 2 THEN -pow(t, 3) / 3 + 1.5 * t * t - 1.5 * t + 0.5 WHEN t < 3 THEN 1 - pow(3 - t, 3) / 6 ELSE 1 END)"


@query(f"SELECT CAST(range AS INTEGER) AS n, {q(_sp, 6)} AS val, {q(_ds, 6)} AS slope, {q(_is, 6)} AS upto FROM (SELECT range, range / 8.0 - 0.5 AS t FROM range(33))")
def spline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadratic spline, its derivative and its integral from the left at even places, beyond its support too."""
    at = [(n, n / 8 - 0.5) for n in range(33)]
    rows = [(n, splines.spline(2, t), splines.spline(2, t, 1), splines.integral(2, -1.0, t)) for n, t in at]
    return spark.createDataFrame(rows, "n int, val double, slope double, upto double").select("n", *(quant(F.col(c), 6).alias(c) for c in ("val", "slope", "upto")))


_PRODUCTS = {(1, 0): [1 / 6, 2 / 3, 1 / 6], (1, 1): [-1.0, 2.0, -1.0], (2, 0): [1 / 120, 26 / 120, 66 / 120, 26 / 120, 1 / 120], (2, 1): [-1 / 6, -1 / 3, 1.0, -1 / 3, -1 / 6]}
_products_sql = ", ".join(f"({g}, {e}, {o - g}, {v!r}::DOUBLE)" for (g, e), x in _PRODUCTS.items() for o, v in enumerate(x))


@query(f"SELECT degree, derivative, place, {q('v', 6)} AS val FROM (VALUES {_products_sql}) t(degree, derivative, place, v)")
def spline_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrals of products of neighbouring splines and of their derivatives."""
    rows = [(g, e, o - g, v) for g, e in _PRODUCTS for o, v in enumerate(splines.inner_products(g, e, e))]
    return spark.createDataFrame(rows, "degree int, derivative int, place int, val double").select("degree", "derivative", "place", quant(F.col("val"), 6).alias("val"))


@query("""SELECT CAST(i AS INTEGER) i, b AS boundary, CAST(CASE WHEN b = 'free' THEN i WHEN i < 0 THEN -i WHEN i > 8 THEN 16 - i ELSE i END AS INTEGER) place, CASE WHEN b = 'dirichlet' AND NOT i BETWEEN 0 AND 8 THEN -1 ELSE 1 END sign
FROM range(-8, 17) t(i), (SELECT unnest(['free', 'neumann', 'dirichlet']) b)""")
def reflected_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, b, *splines.reflect(i, 8, b)) for i in range(-8, 17) for b in ("free", "neumann", "dirichlet")]
    return spark.createDataFrame(rows, "i int, boundary string, place int, sign int")


@query(f"SELECT degree, place, {q('w', 6)} weight FROM (VALUES (1, 0, 0.5), (1, 1, 1.0), (1, 2, 0.5), (2, 0, 0.25), (2, 1, 0.75), (2, 2, 0.75), (2, 3, 0.25)) t(degree, place, w)")
def two_scale_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g, n, w) for g in (1, 2) for n, w in enumerate(splines.two_scale(g))]
    return spark.createDataFrame(rows, "degree int, place int, weight double").select("degree", "place", quant(F.col("weight"), 6).alias("weight"))


@query(f"WITH {U} SELECT pid, {q('0.5 - 2 * u + 3 * u * u - u * u * u', 6)} y FROM u")
def polynomial_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_points(spark, sf_dir).select("pid", quant(geometry.polynomial([0.5, -2.0, 3.0, -1.0], F.col("u")), 6).alias("y"))


@query(f"SELECT n, {q('x', 6)} AS root FROM (VALUES (1, -0.5), (2, 1.0), (2, 2.0), (3, -1.0), (3, 0.25), (3, 3.0), (4, 2.0)) t(n, x)")
def polynomial_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real roots of 2x + 1, (x - 1)(x - 2), (x + 1)(4x - 1)(x - 3) and (x - 2)(x^2 + 1); x^2 + 1 has none."""
    known = [(1, [1.0, 2.0]), (2, [2.0, -3.0, 1.0]), (3, [3.0, -10.0, -9.0, 4.0]), (4, [-2.0, 1.0, -2.0, 1.0]), (5, [1.0, 0.0, 1.0])]
    rows = [(n, r) for n, c in known for r in geometry.real_roots(c)]
    return spark.createDataFrame(rows, "n int, root double").select("n", quant(F.col("root"), 6).alias("root"))
