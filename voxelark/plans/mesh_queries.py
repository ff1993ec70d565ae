"""Queries of the mesh operators over a grid of quads whose values come from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh as ops
from ..registry import query
from .data import P, points, q, quant

W = 24

_V = f"""g AS (SELECT CAST(r.range AS INTEGER) r, CAST(c.range AS INTEGER) c FROM range({W}) r, range({W}) c),
s AS (SELECT CAST(l_orderkey % {W} AS INTEGER) r, CAST(l_partkey % {W} AS INTEGER) c, avg(l_quantity) m FROM lineitem GROUP BY 1, 2),
v AS (SELECT CAST(g.r * {W} + g.c AS BIGINT) vid, CAST(g.c AS DOUBLE) x, CAST(g.r AS DOUBLE) y, coalesce(m, 0.0) / 10 z, coalesce(m, 0.0) AS val FROM g LEFT JOIN s USING (r, c))"""
_M = _V + f""", f AS (SELECT CAST(r * {W - 1} + c AS BIGINT) fid, [r * {W} + c, r * {W} + c + 1, (r + 1) * {W} + c + 1, (r + 1) * {W} + c]::BIGINT[] ids FROM g WHERE r < {W - 1} AND c < {W - 1}),
h AS (SELECT fid, ids[p] a, ids[p % 4 + 1] b, p FROM f, (SELECT unnest([1, 2, 3, 4]) p))"""


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = t.groupBy((F.col("l_orderkey") % W).cast("int").alias("r"), (F.col("l_partkey") % W).cast("int").alias("c")).agg(F.avg("l_quantity").alias("m"))
    g = spark.range(W * W).select(F.floor(F.col("id") / W).cast("int").alias("r"), (F.col("id") % W).cast("int").alias("c"))
    v = g.join(m, ["r", "c"], "left").select((F.col("r") * W + F.col("c")).cast("long").alias("vid"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"),
        (F.coalesce("m", F.lit(0.0)) / 10).alias("z"), F.coalesce("m", F.lit(0.0)).alias("value"))
    r, c = F.col("r"), F.col("c")
    f = g.filter((r < W - 1) & (c < W - 1)).select((r * (W - 1) + c).cast("long").alias("fid"), F.array(*(x.cast("long") for x in (r * W + c, r * W + c + 1, (r + 1) * W + c + 1, (r + 1) * W + c))).alias("ids"))
    return v, f


@query(f"""WITH {_M}, m AS (SELECT fid, avg(x) x, avg(y) y, avg(z) z FROM h JOIN v ON h.a = v.vid GROUP BY fid),
t AS (SELECT h.fid, p.x - m.x ux, p.y - m.y uy, p.z - m.z uz, o.x - m.x wx, o.y - m.y wy, o.z - m.z wz FROM h JOIN m USING (fid) JOIN v p ON h.a = p.vid JOIN v o ON h.b = o.vid)
SELECT fid, {q('sum(sqrt(greatest((ux*ux+uy*uy+uz*uz)*(wx*wx+wy*wy+wz*wz) - pow(ux*wx+uy*wy+uz*wz, 2), 0.0)) / 2)')} area FROM t GROUP BY fid""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh(spark, sf_dir)
    return ops.polygon_areas(f, v).select("fid", quant(F.col("area")).alias("area"))


@query(f"WITH {_M} SELECT least(a, b) a, greatest(a, b) b, count(*) n FROM h GROUP BY 1, 2")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.edges(mesh(spark, sf_dir)[1])


def _islands(f: DataFrame) -> DataFrame:
    """Faces but one column of them and the last row's."""
    return f.filter(f"fid % {W - 1} <> 10 AND fid < {(W - 1) * (W - 2)}")


_ISL = f"{_M}, i AS (SELECT h.* FROM h WHERE fid % {W - 1} <> 10 AND fid < {(W - 1) * (W - 2)})"


@query(f"WITH {_ISL} SELECT CASE WHEN fid % {W - 1} < 10 THEN 0 ELSE 11 END AS comp, a, b FROM i WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.a = i.b AND o.b = i.a)".replace("AS comp", "::BIGINT AS comp"))
def boundary_halfedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _islands(mesh(spark, sf_dir)[1])
    return ops.boundary_half_edges(f, ops.components(f))


@query(f"WITH {_ISL} SELECT DISTINCT fid, CASE WHEN fid % {W - 1} < 10 THEN 0 ELSE 11 END::BIGINT AS comp FROM i")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.components(_islands(mesh(spark, sf_dir)[1]))


@query(f"""WITH {_ISL}, u AS (SELECT DISTINCT a AS vid FROM i)
SELECT row_number() OVER (ORDER BY vid) - 1 AS vid, {q('val')} AS value FROM u JOIN v USING (vid)""")
def hanging_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh(spark, sf_dir)
    kept, _ = ops.used_vertices(v, _islands(f))
    return kept.select("vid", quant(F.col("value")).alias("value"))


@query(f"""WITH {_M}, e AS (SELECT DISTINCT least(a, b) a, greatest(a, b) b FROM h), c AS (SELECT a, b, p.val pv, o.val ov, p.z pz, o.z oz FROM e JOIN v p ON a = p.vid JOIN v o ON b = o.vid WHERE (p.val > 25.5) <> (o.val > 25.5))
SELECT {W * W} + row_number() OVER (ORDER BY a, b) - 1 AS vid, {q('pz * (1 - (pv - 25.5) / (pv - ov)) + oz * ((pv - 25.5) / (pv - ov))')} z FROM c""")
def trim_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh(spark, sf_dir)
    new, _ = ops.trim(v, f, 25.5)
    return new.filter(F.col("vid") >= W * W).select("vid", quant(F.col("z")).alias("z"))


@query(f"""WITH {_M}, n AS (SELECT fid, count(*) FILTER (WHERE val > 25.5) n, count(*) FILTER (WHERE (val > 25.5) <> (nv > 25.5)) turns FROM (SELECT fid, p.val, o.val nv FROM h JOIN v p ON a = p.vid JOIN v o ON b = o.vid) GROUP BY fid)
SELECT over_, CAST(sum(CASE WHEN turns = 0 THEN CASE WHEN (n > 0) = over_ THEN 1 ELSE 0 END ELSE turns / 2 END) AS BIGINT) n FROM n, (SELECT unnest([true, false]) over_) GROUP BY over_""")
def trimmed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh(spark, sf_dir)
    return ops.trim(v, f, 25.5)[1].groupBy(F.col("over").alias("over_")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_M}, c AS (SELECT f.fid, p.x x0, p.y y0, p.z z0, q.x x1, q.y y1, q.z z1, r.x x2, r.y y2, r.z z2, s.x x3, s.y y3, s.z z3, f.ids FROM f JOIN v p ON ids[1] = p.vid JOIN v q ON ids[2] = q.vid JOIN v r ON ids[3] = r.vid JOIN v s ON ids[4] = s.vid),
k AS (SELECT *, (pow(x3-x2,2)+pow(y3-y2,2)+pow(z3-z2,2))*(pow(x0-x2,2)+pow(y0-y2,2)+pow(z0-z2,2)) - pow((x3-x2)*(x0-x2)+(y3-y2)*(y0-y2)+(z3-z2)*(z0-z2),2) a,
  (pow(x1-x3,2)+pow(y1-y3,2)+pow(z1-z3,2))*(pow(x2-x3,2)+pow(y2-y3,2)+pow(z2-z3,2)) - pow((x1-x3)*(x2-x3)+(y1-y3)*(y2-y3)+(z1-z3)*(z2-z3),2) b FROM c)
SELECT ids[1] a, CASE WHEN a > b + 1e-9 THEN ids[2] ELSE ids[2] END b, CASE WHEN a > b + 1e-9 THEN ids[4] ELSE ids[3] END c FROM k WHERE abs(a - b) > 1e-9""")
def quad_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first triangle of every quad whose diagonals differ."""
    from ..functions.geometry import square_norm

    v, f = mesh(spark, sf_dir)
    t = ops.triangulate(v, f)
    first = t.withColumn("face", F.floor(F.col("fid") / 2)).filter("fid % 2 = 0").select(*(F.col("ids")[n].alias(x) for n, x in enumerate("abc")), "face")
    p = [v.select(F.col("vid").alias(f"v{n}"), *(F.col(a).alias(f"{a}{n}") for a in "xyz")) for n in range(4)]
    c = f.select("fid", *(F.col("ids")[n].alias(f"v{n}") for n in range(4)))
    for n in range(4):
        c = c.join(p[n], f"v{n}")

    def square(i: int, j: int, k: int):
        u, w = ([F.col(f"{a}{x}") - F.col(f"{a}{i}") for a in "xyz"] for x in (j, k))
        d = sum((x * y for x, y in zip(u, w, strict=True)), F.lit(0.0))
        return square_norm(u) * square_norm(w) - d * d

    differ = c.filter(F.abs(square(2, 3, 0) - square(3, 1, 2)) > 1e-9).select(F.col("fid").alias("face"))
    return first.join(differ, "face").select("a", "b", "c")


@query(f"""WITH {P}, c AS (SELECT pid, CAST(floor((x - 1) / 10) AS INTEGER) x0, CAST(ceil((x + 1) / 10) AS INTEGER) x1, CAST(floor((y/1000 - 1) / 10) AS INTEGER) y0, CAST(ceil((y/1000 + 1) / 10) AS INTEGER) y1 FROM p)
SELECT CAST(a.range AS INTEGER) cx, CAST(b.range AS INTEGER) cy, count(*) n FROM c, range(-1, 12) a, range(-1, 20) b WHERE a.range BETWEEN x0 AND greatest(x1 - 1, x0) AND b.range BETWEEN y0 AND greatest(y1 - 1, y0) GROUP BY 1, 2""")
def chunk_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("pid", "x", (F.col("y") / 1000).alias("y"))
    return ops.chunks(p, 10.0, 0.1, ("x", "y")).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def _two_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping halves of the grid, each with its own vertex numbers, merged back into the whole."""
    v, f = mesh(spark, sf_dir)
    half = W * W // 2
    a = v.filter(F.col("vid") < half + W).withColumn("part", F.lit(0))
    b = v.filter(F.col("vid") >= half).withColumn("vid", F.col("vid") - half).withColumn("part", F.lit(1))
    low = F.array_min("ids") >= half
    faces = f.filter(~low).withColumn("part", F.lit(0)).union(f.filter(low).withColumn("ids", F.transform("ids", lambda x: x - half)).withColumn("part", F.lit(1)))
    return ops.merge_shared(a.union(b), faces, [W])


@query(f"WITH {_V} SELECT vid, {q('val')} AS value FROM v")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_parts(spark, sf_dir)[0].select("vid", quant(F.col("value")).alias("value"))


@query(f"WITH {_M} SELECT fid, ids[1] a, ids[2] b, ids[3] c, ids[4] d FROM f")
def merged_part_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_parts(spark, sf_dir)[1].select("fid", *(F.col("ids")[n].alias(x) for n, x in enumerate("abcd")))


@query(f"""WITH {_M} SELECT fid, list_reverse(ids)[1] AS first, list_reverse(ids)[4] AS last FROM f""")
def flipped_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.flip(mesh(spark, sf_dir)[1]).select("fid", F.col("ids")[0].alias("first"), F.col("ids")[3].alias("last"))


@query(f"WITH {_M} SELECT fid, {q('avg(x)')} x, {q('avg(y)')} y, {q('avg(z)')} z, {q('avg(val)')} AS value FROM h JOIN v ON h.a = v.vid GROUP BY fid")
def face_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh(spark, sf_dir)
    return ops.centroids(f, v, ("x", "y", "z", "value")).select("fid", *(quant(F.col(c)).alias(c) for c in ("x", "y", "z", "value")))


@query(f"WITH {_M} SELECT fid FROM h JOIN v ON h.a = v.vid GROUP BY fid HAVING avg(x) >= 3 AND avg(x) < 15.5 AND avg(y) >= 2.5 AND avg(y) < 20 AND avg(x) + avg(y) - 30 <= 0")
def faces_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces whose mean corner lies in a box and in a half-space."""
    from ..functions.geometry import in_box, in_half_spaces

    v, f = mesh(spark, sf_dir)
    keep = lambda p: in_box(p[:2], (3, 2.5), (15.5, 20)) & in_half_spaces(p[:2], [(1.0, 1.0, -30.0)])
    return ops.faces_inside(f, v, keep).select("fid")


@query(f"""WITH {_M}, one AS (SELECT [0, 1, 2]::BIGINT[] ids), w AS (SELECT count(*) n FROM v), m AS (SELECT count(*) n FROM f)
SELECT 0::BIGINT AS fid, 0::BIGINT AS first UNION ALL SELECT fid + 1, ids[1] + 3 FROM f UNION ALL SELECT m.n + 1, w.n + 3 FROM m, w""")
def concatenated_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle, the grid and the triangle again as one mesh."""
    v, f = mesh(spark, sf_dir)
    tv = spark.createDataFrame([(k, float(k), 0.0, 0.0, 0.0) for k in range(3)], v.schema)
    tf = spark.createDataFrame([(0, [0, 1, 2])], f.schema)
    return ops.concatenate([(tv, tf), (v, f), (tv, tf)])[1].select("fid", F.col("ids")[0].alias("first"))


_AREAS = """m AS (SELECT fid, avg(x) x, avg(y) y, avg(z) z FROM h JOIN v ON h.a = v.vid GROUP BY fid),
t AS (SELECT h.fid, p.x - m.x ux, p.y - m.y uy, p.z - m.z uz, o.x - m.x wx, o.y - m.y wy, o.z - m.z wz FROM h JOIN m USING (fid) JOIN v p ON h.a = p.vid JOIN v o ON h.b = o.vid),
ar AS (SELECT fid, sum(sqrt(greatest((ux*ux+uy*uy+uz*uz)*(wx*wx+wy*wy+wz*wz) - pow(ux*wx+uy*wy+uz*wz, 2), 0.0)) / 2) area FROM t GROUP BY fid)"""


@query(f"WITH {_ISL}, {_AREAS} SELECT CASE WHEN fid % {W - 1} < 10 THEN 0 ELSE 11 END::BIGINT AS comp, count(*) n, {q('sum(area)', 2)} area FROM ar WHERE fid IN (SELECT fid FROM i) GROUP BY 1")
def component_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh(spark, sf_dir)
    f = _islands(f)
    return ops.component_areas(ops.components(f), ops.polygon_areas(f, v)).select("comp", "n", quant(F.col("area"), 2).alias("area"))


@query(f"WITH {_M}, {_AREAS} SELECT {q('sum(area)', 2)} area FROM ar")
def mesh_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = mesh(spark, sf_dir)
    return ops.polygon_areas(f, v).agg(quant(F.sum("area"), 2).alias("area"))


def _bands(f: DataFrame) -> DataFrame:
    """Faces in blocks of eight columns by seven rows, as components."""
    return f.select("fid", F.expr(f"cast(floor(fid % {W - 1} / 8) * 10 + floor(floor(fid / {W - 1}) / 7) as long)").alias("comp"))


@query("SELECT (a * 10 + b)::BIGINT AS comp, (a2 * 10 + b2)::BIGINT AS other FROM (SELECT unnest([0, 1, 2]) a), (SELECT unnest([0, 1, 2, 3]) b), (SELECT unnest([0, 1, 2]) a2), (SELECT unnest([0, 1, 2, 3]) b2) WHERE (a2 = a + 1 AND b2 = b) OR (a2 = a AND b2 = b + 1)")
def adjacent_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that share an edge."""
    f = mesh(spark, sf_dir)[1]
    return ops.component_links(ops.boundary_half_edges(f, _bands(f)))


@query("SELECT * FROM (VALUES (0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5)) t(comp, head)")
def merged_small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest component goes to its neighbours, which become one; one without neighbours stays, however small."""
    into = ops.merge_small({0: 50.0, 1: 0.01, 2: 30.0, 3: 40.0, 4: 0.001, 5: 20.0}, [(0, 1), (1, 2), (2, 3), (3, 5)], 0.001)
    return spark.createDataFrame(sorted(into.items()), "comp int, head int")


@query(f"WITH {_V} SELECT {q('min(val)')} low, {q('max(val)')} high FROM v")
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.value_range(mesh(spark, sf_dir)[0]).select(quant(F.col("low")).alias("low"), quant(F.col("high")).alias("high"))


@query("""WITH p AS (SELECT o_orderkey AS pid, CAST(o_custkey % 50 AS DOUBLE) x, o_totalprice y, (o_orderkey % 100) / 1000.0::DOUBLE z FROM orders)
SELECT pid, x > 10.25 AND x < 40.25 AND y > 100000.5 AND y < 300000.5 AND z > 0.0153 AND z < 0.0653 AS inside FROM p""")
def inside_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside a closed mesh, by the nearest hit of a ray."""
    from .apps import inside_mesh

    low, high = (10.25, 100000.5, 0.0153), (40.25, 300000.5, 0.0653)
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pid"), (F.col("o_custkey") % 50).cast("double").alias("x"), F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 100 / 1000.0).alias("z"))
    v = spark.createDataFrame([(n, *(high[a] if n >> a & 1 else low[a] for a in range(3))) for n in range(8)], "vid long, x double, y double, z double")
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = spark.createDataFrame([(2 * n + m, t) for n, (a, b, c, d) in enumerate(quads) for m, t in enumerate(([a, b, c], [a, c, d]))], "fid long, ids array<long>")
    return inside_mesh(p, v, f, "pid")


@query("SELECT b AS removed, CASE WHEN b THEN 200 ELSE 201 END::BIGINT AS faces FROM (SELECT unnest([true, false]) b)")
def island_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane of 10 x 20 quads over the level and a tiny quad apart from it, which goes if asked."""
    from .apps import trim_surface

    v = spark.range(11 * 21).select(F.col("id").alias("vid"), (F.col("id") % 21).cast("double").alias("x"), F.floor(F.col("id") / 21).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("value"))
    r, c = F.floor(F.col("id") / 20), F.col("id") % 20
    f = spark.range(200).select(F.col("id").alias("fid"), F.array(*((r * 21 + c + o).cast("long") for o in (0, 1, 22, 21))).alias("ids"))
    v = v.union(spark.createDataFrame([(231 + n, 50 + x, y, 0.0, 1.0) for n, (x, y) in enumerate(((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1)))], v.schema))
    f = f.union(spark.createDataFrame([(200, [231, 232, 233, 234])], f.schema))
    rows = [(b, trim_surface(v, f, 0.5, remove_islands=b)[1].count()) for b in (True, False)]
    return spark.createDataFrame(rows, "removed boolean, faces long")


@query("SELECT true AS closed, 2::BIGINT AS euler")
def level_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface of a ball on a grid of 12 x 12 x 12 corners: its edges have two faces each, and V - E + F = 2."""
    from ..operators import levelset

    g = spark.range(12**3).select(*(F.floor(F.col("id") / 12**k % 12).cast("int").alias(a) for k, a in enumerate("ijk")))
    g = g.withColumn("val", 17.3 - (F.pow(F.col("i") - 5.5, 2.0) + F.pow(F.col("j") - 5.4, 2.0) + F.pow(F.col("k") - 5.6, 2.0)))
    v, f = levelset.surface(g, 0.0)
    e = ops.edges(f).agg(F.bool_and(F.col("n") == 2).alias("closed"), F.count(F.lit(1)).alias("n")).first()
    return spark.createDataFrame([(bool(e["closed"]), v.count() - e["n"] + f.count())], "closed boolean, euler long")
