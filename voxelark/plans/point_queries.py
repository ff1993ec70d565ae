"""Queries of the point operators over line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import points as ops
from ..operators.cells import locate
from ..registry import query
from .data import AXES3, P, U, cell_sql, points, q, quant, unit_points


def _xyz() -> list:
    return g.vector(*AXES3)


def _n() -> list:
    return g.vector("nx", "ny", "nz")


@query(f"""WITH {P}, e AS (SELECT (min(x) + max(x)) / 2 cx, (min(y) + max(y)) / 2 cy, (min(z) + max(z)) / 2 cz,
  1.1 * greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) s FROM p),
u AS (SELECT a, (x - (cx - s / 2)) / s u, (y - (cy - s / 2)) / s v, (z - (cz - s / 2)) / s w FROM p, e)
SELECT {cell_sql('u', '8')} i, {cell_sql('v', '8')} j, {cell_sql('w', '8')} k, count(*) n, {q('avg(a)')} mean_a, {q('sum(a)')} sum_a
FROM u WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 GROUP BY 1, 2, 3""")
def voxel_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    u = ops.unit_cube(p).apply(_xyz())
    rows = p.select("a", *(c.alias(n) for c, n in zip(u, "uvw", strict=True))).filter(g.in_unit_cube(g.vector("u", "v", "w")))
    cell = [locate(F.col(n), 8).alias(a) for n, a in zip("uvw", "ijk", strict=True)]
    return rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), quant(F.avg("a")).alias("mean_a"), quant(F.sum("a")).alias("sum_a"))


@query(f"WITH {P} " + " UNION ALL ".join(
    f"SELECT {i} direction, {q(f'min({x}*x + ({y})*y + ({z})*z)')} low, {q(f'max({x}*x + ({y})*y + ({z})*z)')} high FROM p" for i, (x, y, z) in enumerate(ops.directions())))
def extent_9dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extent(points(spark, sf_dir)).select("direction", quant(F.col("low")).alias("low"), quant(F.col("high")).alias("high"))


@query(f"""WITH {P}, e AS (SELECT (min(x) + max(x)) / 2 cx, (min(y) + max(y)) / 2 cy, (min(z) + max(z)) / 2 cz,
  1.1 * greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) s FROM p)
SELECT pid, {q('(x - (cx - s / 2)) / s', 6)} u, {q('(y - (cy - s / 2)) / s', 6)} v, {q('(z - (cz - s / 2)) / s', 6)} w FROM p, e""")
def unit_cube_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    u = ops.unit_cube(p).apply(_xyz())
    rows = p.select("pid", *(c.alias(n) for c, n in zip(u, "uvw", strict=True))).filter(g.in_unit_cube(g.vector("u", "v", "w")))
    return rows.select("pid", *(quant(F.col(c), 6).alias(c) for c in "uvw"))


#: A rotation by 30 degrees about z, a stretch by 2 in y and a shift.
_M = np.array([[0.8660254037844387, -0.5, 0.0, 1.0], [1.0, 1.7320508075688774, 0.0, -2.0], [0.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]])
_T = np.linalg.inv(_M[:3, :3]).T
_mx = [" + ".join(f"{_M[r, c]!r} * {a}" for c, a in enumerate("xyz")) + f" + {_M[r, 3]!r}" for r in range(3)]
_mn = [" + ".join(f"{float(_T[r, c])!r}::DOUBLE * n{a}" for c, a in enumerate("xyz")) for r in range(3)]


@query(f"""WITH {P}, t AS (SELECT pid, {_mx[0]} x, {_mx[1]} y, {_mx[2]} z, {_mn[0]} nx, {_mn[1]} ny, {_mn[2]} nz FROM p WHERE nx*nx + ny*ny + nz*nz > 0)
SELECT pid, {q('x')} x, {q('y')} y, {q('z')} z, {', '.join(q(f'n{a} / sqrt(nx*nx + ny*ny + nz*nz)') + f' n{a}' for a in 'xyz')} FROM t""".replace("np.float64(", "(")) # fmt: skip
def oriented_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).filter(g.finite_normal(_n()))
    t = p.select("pid", *(c.alias(a) for c, a in zip(g.apply_affine(_xyz(), _M), AXES3, strict=True)), *(c.alias(f"n{a}") for c, a in zip(g.apply_normal(_n(), _M), AXES3, strict=True)))
    return t.select("pid", *(quant(c).alias(a) for c, a in zip(_xyz(), AXES3, strict=True)), *(quant(c / g.norm(_n())).alias(f"n{a}") for c, a in zip(_n(), AXES3, strict=True)))


@query(f"WITH {P} SELECT pid, {q('nx * pow(a + 1, 2) * pow(x, 0.5)')} nx, {q('ny * pow(a + 1, 2) * pow(x, 0.5)')} ny, {q('nz * pow(a + 1, 2) * pow(x, 0.5)')} nz FROM p")
def confidence_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = g.confidence([F.col("a") + 1, F.col("x")], [2.0, 0.5])
    return points(spark, sf_dir).select("pid", *(quant(c * s).alias(f"n{a}") for c, a in zip(_n(), AXES3, strict=True)))


_l = "sqrt(nx*nx + ny*ny + nz*nz)"


@query(f"""WITH {P}, n AS (SELECT pid, nx / {_l} a, ny / {_l} b, nz / {_l} c FROM p WHERE nx*nx + ny*ny + nz*nz > 0)
SELECT pid, {q('least(255.0, 255 * (greatest(a, 0) + greatest(-b, 0) + greatest(-c, 0)))', 3)} red,
  {q('least(255.0, 255 * (greatest(-a, 0) + greatest(b, 0) + greatest(-c, 0)))', 3)} green,
  {q('least(255.0, 255 * (greatest(-a, 0) + greatest(-b, 0) + greatest(c, 0)))', 3)} blue FROM n""")
def normal_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).filter(g.finite_normal(_n()))
    n = p.select("pid", *((c / g.norm(_n())).alias(a) for c, a in zip(_n(), "abc", strict=True)))
    return n.select("pid", *(quant(c, 3).alias(x) for c, x in zip(g.normal_color(g.vector("a", "b", "c")), ("red", "green", "blue"), strict=True)))


@query(f"WITH {P} SELECT pid, x, y, z FROM p WHERE x >= 10 AND x < 30 AND y >= 5000 AND y < 40000 AND z >= 0.02 AND z < 0.08")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter(g.in_box(_xyz(), (10, 5000, 0.02), (30, 40000, 0.08))).select("pid", *AXES3)


@query(f"WITH {P} SELECT pid, x, y, z FROM p WHERE x * 1000.0 + y * -1.0 + z * 0.0 + 0.0 <= 0 AND x * 1.0 + y * 0.0 + z * 100.0 + -20.0 <= 0")
def halfspace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = [(1000.0, -1.0, 0.0, 0.0), (1.0, 0.0, 100.0, -20.0)]
    return points(spark, sf_dir).filter(g.in_half_spaces(_xyz(), planes)).select("pid", *AXES3)


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM n JOIN (SELECT range AS i FROM range(100)) s ON n.r = (s.i * n.n) // 100""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return ops.systematic_sample(t, 100, ["o_orderkey"])


@query(f"""WITH {P}, b AS (SELECT 0.005 * sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) r FROM p),
n AS (SELECT pid, x, y, z, {_l} l, nx / {_l} a, ny / {_l} b, nz / {_l} c FROM p WHERE {_l} > 0),
f AS (SELECT *, CASE WHEN a*a + c*c < 1e-7 THEN 1.0 ELSE -c END ux, CASE WHEN a*a + c*c < 1e-7 THEN 0.0 ELSE a END uz FROM n),
w AS (SELECT *, b * uz wx, c * ux - a * uz wy, -b * ux wz FROM f),
t AS (SELECT w.*, s.range AS corner, 2 * pi() / 12 * s.range AS th, r * pow(l, 0.66) AS rr FROM w, b, range(12) s)
SELECT count(*) n, {q('avg(x + (ux / sqrt(ux*ux + uz*uz) * cos(th) + wx / sqrt(wx*wx + wy*wy + wz*wz) * sin(th)) * rr)', 2)} mx,
  {q('max(y + wy / sqrt(wx*wx + wy*wy + wz*wz) * sin(th) * rr)', 2)} my,
  {q('min(z + (uz / sqrt(ux*ux + uz*uz) * cos(th) + wz / sqrt(wx*wx + wy*wy + wz*wz) * sin(th)) * rr)', 2)} mz, corner FROM t GROUP BY corner""")
def disk_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ops.disks(points(spark, sf_dir))
    return d.groupBy(F.col("corner").cast("long").alias("corner")).agg(F.count(F.lit(1)).alias("n"), quant(F.avg("x"), 2).alias("mx"), quant(F.max("y"), 2).alias("my"), quant(F.min("z"), 2).alias("mz"))


@query(f"WITH {U} SELECT CAST(least(floor(u * 16), 15) AS INTEGER) slab, count(*) n, {q('sum(a)')} sum_a FROM u GROUP BY 1")
def slab_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = unit_points(spark, sf_dir).withColumn("slab", F.least(ops.slab(F.col("u"), 16), F.lit(15)))
    return p.groupBy("slab").agg(F.count(F.lit(1)).alias("n"), quant(F.sum("a")).alias("sum_a"))


@query(f"""WITH {U}, s AS (SELECT CAST(least(floor(u * 16), 15) AS INTEGER) own FROM u)
SELECT CAST(own + o AS INTEGER) slab, o = 0 AS own, count(*) n FROM s, (SELECT unnest([-2, -1, 0, 1, 2]) o) WHERE own + o BETWEEN 0 AND 15 GROUP BY 1, 2""")
def ghost_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ghosted(unit_points(spark, sf_dir).select("pid", "u"), "u", 16, 2).groupBy("slab", "own").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {U}, g AS (SELECT CASE WHEN w < 0.4 THEN 0.4 - w WHEN w > 0.6 THEN w - 0.6 END g FROM u)
SELECT CASE WHEN g IS NULL THEN 8 ELSE greatest(least(CAST(floor(log2(4.0 / g)) AS INTEGER), 8), 2) END depth, count(*) n FROM g GROUP BY 1""")
def padded_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ops.padded_depth(F.col("w"), 0.4, 0.6, 4, 2, 8)
    return unit_points(spark, sf_dir).groupBy(d.alias("depth")).agg(F.count(F.lit(1)).alias("n"))


_DP = "".join(f", b{p} AS (SELECT e.n, min(b.e + pow(e.c - s.c, 2)) e FROM cum e JOIN cum s ON s.n < e.n JOIN b{p - 1} b ON b.n = s.n GROUP BY e.n)" for p in range(2, 9))


@query(f"""WITH {U}, s AS (SELECT CAST(least(floor(u * 64), 63) AS INTEGER) slab, count(*) n FROM u GROUP BY 1), cum AS (SELECT r.range AS n, CAST(coalesce(sum(s.n), 0) AS DOUBLE) c FROM range(65) r LEFT JOIN s ON s.slab < r.range GROUP BY 1),
b1 AS (SELECT n, c * c AS e FROM cum WHERE n > 0){_DP} SELECT 8 AS parts, count(*) AS slabs, CAST((SELECT e FROM b8 WHERE n = 64) AS BIGINT) AS energy FROM range(64)""")
def balanced_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slab ranges of balanced size by dynamic programming over 64 counts: none has a smaller sum of squares."""
    p = unit_points(spark, sf_dir).groupBy(F.least(ops.slab(F.col("u"), 64), F.lit(63)).alias("slab")).count()
    counts = [0] * 64
    for r in p.collect():
        counts[r["slab"]] = r["count"]
    ends = ops.balanced_ranges(counts, 8)
    return spark.createDataFrame([(len(ends), ends[-1], ops.partition_energy(counts, ends))], "parts int, slabs long, energy long")


@query(f"WITH {U}, s AS (SELECT CAST(floor(u * 16) AS INTEGER) slab FROM u) SELECT slab BETWEEN 3 AND 9 AS inside, count(*) n FROM s GROUP BY 1")
def slabs_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a range of slabs, and how many lie out of it."""
    return ops.in_slabs(unit_points(spark, sf_dir), "u", 16, 3, 10).groupBy("inside").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT pid, CAST((CAST(x AS BIGINT) % 7 * 5 + pid % 5) * 4 + CAST(y AS BIGINT) % 4 AS BIGINT) AS idx, CAST(CAST(y AS BIGINT) % 4 AS INTEGER) i, CAST(pid % 5 AS INTEGER) j, CAST(CAST(x AS BIGINT) % 7 AS INTEGER) k FROM (SELECT pid, floor(x) x, floor(y) y FROM p)")
def grid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid places as one number and back."""
    p = points(spark, sf_dir).select("pid", (F.floor("y") % 4).alias("i"), (F.col("pid") % 5).alias("j"), (F.floor("x") % 7).alias("k"))
    p = p.select("pid", ops.grid_index("ijk", (4, 5, 7)).alias("idx"))
    return p.select("pid", "idx", *ops.grid_coordinates(F.col("idx"), "ijk", (4, 5, 7)))


@query(f"WITH {P} SELECT CAST(ceil(greatest(0.0, log2(100.0 / x))) AS INTEGER) depth, count(*) n FROM p GROUP BY 1")
def width_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy(ops.depth_of_width(100.0, F.col("x")).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT pid, {q('ny * z - nz * y', 3)} a, {q('nz * x - nx * z', 3)} b, {q('nx * y - ny * x', 3)} c, {q('sqrt(pow(x - nx, 2) + pow(y - ny, 2) + pow(z - nz, 2))', 3)} distance FROM p")
def cross_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.cross(_n(), _xyz())
    return points(spark, sf_dir).select("pid", *(quant(v, 3).alias(n) for v, n in zip(c, "abc", strict=True)), quant(g.distance(_xyz(), _n()), 3).alias("distance"))


_STREAMS = "s AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS stream, o_orderkey AS idx, o_totalprice AS a FROM orders)"


#: What a key leaves by 3: a negative one a negative number, null null.
_REMAINDERS = (-2, -1, 0, 1, 2, None)


def _streams(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("a"))
    return [p.filter((F.col("idx") % 3).eqNullSafe(F.lit(n).cast("long"))) for n in _REMAINDERS]


@query(f"WITH {_STREAMS} SELECT stream, idx, a, row_number() OVER (ORDER BY stream, idx) - 1 AS place FROM s")
def streams_one_after_another(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.one_after_another(_streams(spark, sf_dir), _REMAINDERS).select("stream", "idx", "a", "place")


@query(f"WITH {_STREAMS} SELECT idx, a, row_number() OVER (ORDER BY idx) - 1 AS place FROM s")
def streams_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed streams merged by their index; the place of each row after the merge."""
    merged = ops.interleaved(_streams(spark, sf_dir))
    return ops.row_numbers(merged, ["idx"]).select("idx", "a", "place")


@query(f"WITH {U}, s AS (SELECT CAST(least(floor(u * 8), 7) AS INTEGER) slab, a FROM u) SELECT slab, count(*) n, {q('sum(a)')} a FROM s GROUP BY 1")
def merged_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slab fragments of three clients put together."""
    p = unit_points(spark, sf_dir).select("pid", F.least(ops.slab(F.col("u"), 8), F.lit(7)).alias("slab"), "a")
    out = ops.merged_slabs([p.filter(F.col("pid") % 3 == n) for n in range(3)])
    return out.groupBy("slab").agg(F.count(F.lit(1)).alias("n"), quant(F.sum("a")).alias("a"))


def _level_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_points(spark, sf_dir).select(F.col("pid").alias("vid"), "u", "v", "w", F.col("nx").alias("gu"), F.col("ny").alias("gv"), F.col("nz").alias("gw"), "a")


_AL = ops.Alignment((10.0, -3.0, 0.25), (2.0, 4.0, 0.5))


@query(f"WITH {U} SELECT pid AS vid, {q('u * 2 + 10')} x, {q('v * 4 - 3')} y, {q('w / 2 + 0.25')} z, {q('nx / 2')} nx, {q('ny / 4')} ny, {q('nz * 2')} nz, {q('a')} AS value FROM u")
def output_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a level set with gradients and density in the data's own space."""
    from .apps import output_points

    out = output_points(_level_set(spark, sf_dir), _AL, density="a")
    return out.select("vid", *(quant(F.col(c)).alias(c) for c in out.columns if c != "vid"))


@query(f"WITH {U} SELECT pid AS vid, {q('u * 256')} x, {q('v * 256')} y, {q('w * 256')} z, a FROM u")
def output_grid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .apps import output_points

    out = output_points(_level_set(spark, sf_dir), _AL, gradient=False, aux=("a",), grid_depth=8)
    return out.select("vid", *(quant(F.col(c)).alias(c) for c in "xyz"), "a")


@query(f"""WITH {P}, t AS (SELECT pid, a, {_mx[0]} x, {_mx[1]} y, {_mx[2]} z, {_mn[0]} nx, {_mn[1]} ny, {_mn[2]} nz FROM p)
SELECT pid, a, {', '.join(q(c) + ' ' + c for c in ('x', 'y', 'z', 'nx', 'ny', 'nz'))} FROM t""".replace("np.float64(", "("))
def transformed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and normals move, other columns pass."""
    from .apps import transform_points

    t = transform_points(points(spark, sf_dir), _M)
    return t.select("pid", "a", *(quant(F.col(c)).alias(c) for c in (*AXES3, "nx", "ny", "nz")))


@query(f"""WITH {P}, c AS (SELECT pid, CASE WHEN pid % 4 = 0 THEN 255 ELSE pid % 256 END r, CASE WHEN pid % 4 = 0 THEN 255 ELSE pid % 11 END g, CASE WHEN pid % 4 = 0 THEN 255 ELSE pid % 7 END b, x FROM p)
SELECT pid, CAST(CASE WHEN r = 255 AND g = 255 AND b = 255 THEN -1 ELSE r * 65536 + g * 256 + b END AS INTEGER) label, CAST(least(greatest(trunc((x / 40 - 0.1) * 255), 0), 255) AS INTEGER) pixel FROM c""")
def pixel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as labels, white as none, and values as bytes."""
    from ..sources.files import label_of, to_pixel

    pid = F.col("pid")
    r, gr, b = (F.when(pid % 4 == 0, 255).otherwise(pid % n).cast("int") for n in (256, 11, 7))
    return points(spark, sf_dir).select("pid", label_of(r, gr, b).alias("label"), to_pixel(F.col("x") / 40 - 0.1).alias("pixel"))


@query("""WITH v AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, floor(list_dot_product(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) * 1e4 + 0.3719) / 1e4 AS dot,
  floor(sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[]))) * 1e4 + 0.3719) / 1e4 AS length FROM v WHERE b IS NOT NULL""")
def embedding_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("a"))
    n = ops.row_numbers(v, ["vec_id"])
    pairs = n.join(n.select((F.col("place") - 1).alias("place"), F.col("a").alias("b")).filter("b IS NOT NULL"), "place")
    return pairs.select("vec_id", quant(g.array_dot("a", "b")).alias("dot"), quant(g.array_norm("a")).alias("length"))


@query(f"WITH {P} SELECT returnflag, count(*) n, {q('sum(area)', 2)} area FROM (SELECT l_returnflag returnflag, {q('0', 1)} + 0.5 * sqrt(greatest((l_quantity*l_quantity + 1) * (l_tax*l_tax + 4) - pow(l_quantity * l_tax + 2, 2), 0.0)) area FROM lineitem) GROUP BY 1")
def triangle_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles with a corner at the origin and sides (quantity, 1) and (tax, 2)."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o = [F.lit(0.0), F.lit(0.0)]
    area = g.triangle_area(o, [F.col("l_quantity"), F.lit(1.0)], [F.col("l_tax"), F.lit(2.0)])
    return t.groupBy(F.col("l_returnflag").alias("returnflag")).agg(F.count(F.lit(1)).alias("n"), quant(F.sum(area), 2).alias("area"))


@query(f"""WITH {P}, t AS (SELECT pid, x / 50 - 0.7 x0, x / 50 + 0.2 x1, a * 10 d0, nz / 5 d1 FROM p),
c AS (SELECT *, x0 - 0.1 c, x1 - x0 s, (d1 - d0) / 2 a FROM t),
r AS (SELECT *, (s - a) * (s - a) - 4 * a * c disc, CASE WHEN x0 = x1 THEN 0.5 ELSE (0.1 - x0) / (x1 - x0) END line FROM c),
z AS (SELECT *, CASE WHEN abs(a) < 1e-12 THEN NULL ELSE (-(s - a) - sqrt(greatest(disc, 0.0))) / (2 * a) END t0, CASE WHEN abs(a) < 1e-12 THEN NULL ELSE (-(s - a) + sqrt(greatest(disc, 0.0))) / (2 * a) END t1 FROM r)
SELECT pid, {q('''greatest(0.0, least(1.0, CASE WHEN abs(a) < 1e-12 OR disc < 0 THEN line WHEN t0 BETWEEN 0 AND 1 AND t1 BETWEEN 0 AND 1 THEN (t0 + t1) / 2
  WHEN t0 BETWEEN 0 AND 1 THEN t0 WHEN t1 BETWEEN 0 AND 1 THEN t1 ELSE line END))''')} t FROM z""")
def edge_root_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, x1 = F.col("x") / 50 - 0.7, F.col("x") / 50 + 0.2
    return points(spark, sf_dir).select("pid", quant(g.hermite_root(x0, x1, F.col("a") * 10, F.col("nz") / 5, 0.1)).alias("t"))
