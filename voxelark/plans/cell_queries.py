"""Queries of the cell operators over line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.splines import density_scale
from ..operators import cells as ops
from ..operators import density as den
from ..registry import query
from .data import U, cell_sql, cells_cte, q, quant, spline_cte, unit_points

_C5, _C4 = cells_cte(5), cells_cte(4)


def _cells(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    return ops.with_cell(unit_points(spark, sf_dir), d)


def _sums(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    return _cells(spark, sf_dir, d).groupBy("d", "i", "j", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"))


@query(f"""WITH {_C5}, l AS (SELECT range AS dd FROM range(6)),
r AS (SELECT CAST(dd AS INTEGER) d, i >> (5 - dd) i, j >> (5 - dd) j, k >> (5 - dd) k, a FROM c, l)
SELECT d, CAST(i AS INTEGER) i, CAST(j AS INTEGER) j, CAST(k AS INTEGER) k, count(*) n, {q('sum(a)')} a FROM r GROUP BY 1, 2, 3, 4""")
def octree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.roll_up(_sums(spark, sf_dir, 5), ["n", "a"])
    return out.select("d", "i", "j", "k", "n", quant(F.col("a")).alias("a"))


@query(f"""WITH {_C4}, s AS (SELECT d, i, j, k, sum(a) wa, count(*) n FROM c GROUP BY ALL)
SELECT d, i, j, k, n, {q('wa / n')} mean FROM s""")
def projective_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _cells(spark, sf_dir, 4).groupBy("d", "i", "j", "k").agg(*ops.projective({"a": F.col("a")}, F.lit(1.0)))
    return s.select("d", "i", "j", "k", F.col("weight").cast("long").alias("n"), quant(ops.mean("a")).alias("mean"))


@query(f"""WITH {_C5}, t AS (SELECT DISTINCT CAST(4 AS INTEGER) d, i >> 1 i, j >> 1 j, k >> 1 k FROM c WHERE x < 25 UNION SELECT DISTINCT 2, i >> 3, j >> 3, k >> 3 FROM c),
m AS (SELECT c.pid, c.x, c.y, c.z, max(t.d) d FROM (SELECT DISTINCT pid, x, y, z, i, j, k FROM c) c JOIN t ON c.i >> (5 - t.d) = t.i AND c.j >> (5 - t.d) = t.j AND c.k >> (5 - t.d) = t.k GROUP BY ALL)
SELECT d, count(*) n FROM m GROUP BY d""")
def deepest_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir, 5)
    up = lambda df, n: df.select(F.lit(5 - n).alias("d"), *(F.expr(f"shiftright({a}, {n})").alias(a) for a in "ijk"))
    tree = up(c.filter("x < 25"), 1).union(up(c, 3)).distinct()
    p = c.select(F.xxhash64("pid", "x", "y", "z").alias("key"), "u", "v", "w").distinct()
    return ops.deepest_cell(p, tree, "key", 4).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_C4}, s AS (SELECT i, j, k, count(*) n FROM c GROUP BY ALL)
SELECT a.i, a.j, a.k, a.n, CAST(sum(b.n) AS BIGINT) near, count(*) cells FROM s a JOIN s b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND b.k BETWEEN a.k - 1 AND a.k + 1 GROUP BY ALL""")
def stencil_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sums(spark, sf_dir, 4).drop("a")
    return ops.stencil_join(s, s).groupBy("i", "j", "k", "n").agg(F.sum("n_n").alias("near"), F.count(F.lit(1)).alias("cells"))


def _splat_sql(degree: int) -> str:
    return f"WITH {_C4}, {spline_cte('c', degree, 'a')} SELECT d, i, j, k, {q('sum(basis)')} weight, {q('sum(basis * a)')} a FROM s GROUP BY ALL"


def _splat(spark: SparkSession, sf_dir: str, degree: int) -> DataFrame:
    s = ops.splat(_cells(spark, sf_dir, 4).select("d", "i", "j", "k", "u", "v", "w", "a"), {"weight": F.lit(1.0), "a": F.col("a")}, degree)
    return s.select("d", "i", "j", "k", quant(F.col("weight")).alias("weight"), quant(F.col("a")).alias("a"))


@query(_splat_sql(1))
def splat_deg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splat(spark, sf_dir, 1)


@query(_splat_sql(2))
def splat_deg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splat(spark, sf_dir, 2)


_KERNEL, _TARGET = 3, 1.5
_SAMPLES = f"""{cells_cte(_KERNEL + 1)}, g AS (SELECT i, j, k, CAST(count(*) AS DOUBLE) n, avg(u) u, avg(v) v, avg(w) w FROM c GROUP BY ALL),
r AS (SELECT CAST(dd AS INTEGER) d, i >> ({_KERNEL + 1} - dd) i, j >> ({_KERNEL + 1} - dd) j, k >> ({_KERNEL + 1} - dd) k, sum(n) n, sum(n * u) / sum(n) u, sum(n * v) / sum(n) v, sum(n * w) / sum(n) w
  FROM g, (SELECT range AS dd FROM range({_KERNEL + 1})) GROUP BY ALL),
{spline_cte('r', 2, 'n')}, dens AS (SELECT d, i, j, k, sum(basis * n) * {density_scale()!r}::DOUBLE AS w FROM s GROUP BY ALL),
pt AS (SELECT i * 289 + j * 17 + k AS key, u, v, w FROM g),
place AS (SELECT key, CAST(dd AS INTEGER) d, u, v, w, {cell_sql('u', 'dd')} i, {cell_sql('v', 'dd')} j, {cell_sql('w', 'dd')} k FROM pt, (SELECT range AS dd FROM range({_KERNEL + 1}))),
{spline_cte('place', 2, 'key', 'b')}, spn AS (SELECT key, b.d, sum(basis * dens.w) spn FROM b JOIN dens ON b.d = dens.d AND b.i = dens.i AND b.j = dens.j AND b.k = dens.k GROUP BY 1, 2)"""


def _spn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = den.samples(unit_points(spark, sf_dir), _KERNEL + 1, F.lit(1.0))
    dens = den.density(s, _KERNEL)
    return den.samples_per_node(s.select((F.col("i") * 289 + F.col("j") * 17 + F.col("k")).alias("key"), "u", "v", "w"), dens, "key", _KERNEL)


@query(f"WITH {_SAMPLES} SELECT key, d, {q('spn', 2)} spn FROM spn")
def samples_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spn(spark, sf_dir).select("key", "d", quant(F.col("spn"), 2).alias("spn"))


@query(f"""WITH {_SAMPLES}, f AS (SELECT *, lead(spn) OVER (PARTITION BY key ORDER BY d) finer FROM spn),
pick AS (SELECT key, max(d) d FROM f WHERE spn >= {_TARGET} OR d = 0 GROUP BY key)
SELECT key, {q(f'CASE WHEN d = {_KERNEL} THEN d + ln(spn / {_TARGET}) / (ln(2.0) * 2) ELSE d + ln(spn / {_TARGET}) / ln(spn / finer) END')} depth, {q('pow(pow(2.0, -d), 2.0) / spn', 8)} weight
FROM f JOIN pick USING (key, d)""")
def sample_depth_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    dw = den.depth_and_weight(_spn(spark, sf_dir), "key", _TARGET, _KERNEL)
    return dw.select("key", quant(F.col("depth")).alias("depth"), quant(F.col("weight"), 8).alias("weight"))


@query(f"""WITH {cells_cte(3)}, g AS (SELECT i, j, k, CAST(count(*) AS DOUBLE) n, sum(a) a, avg(u) u, avg(v) v, avg(w) w FROM c GROUP BY ALL),
r AS (SELECT CAST(dd AS INTEGER) d, i >> (3 - dd) i, j >> (3 - dd) j, k >> (3 - dd) k, n * pow(128.0, dd) n, a * pow(128.0, dd) a, u, v, w FROM g, (SELECT range AS dd FROM range(4))),
{spline_cte('r', 1, 'n, a')}, f AS (SELECT d, i, j, k, sum(basis * n) n, sum(basis * a) a FROM s GROUP BY ALL),
pt AS (SELECT i * 64 + j * 8 + k AS key, u, v, w FROM g),
place AS (SELECT key, CAST(dd AS INTEGER) d, u, v, w, {cell_sql('u', 'dd')} i, {cell_sql('v', 'dd')} j, {cell_sql('w', 'dd')} k FROM pt, (SELECT range AS dd FROM range(4))),
{spline_cte('place', 1, 'key', 'b')} SELECT key, {q('sum(basis * a) / sum(basis * n)', 6)} a FROM b JOIN f ON b.d = f.d AND b.i = f.i AND b.j = f.j AND b.k = f.k GROUP BY key""")
def aux_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = den.samples(unit_points(spark, sf_dir), 3, F.lit(1.0), {"a": F.col("a")})
    f = den.extrapolation(s, ["a"])
    at = s.select((F.col("i") * 64 + F.col("j") * 8 + F.col("k")).alias("key"), "u", "v", "w")
    return den.read_extrapolation(at, f, "key", ["a"], 3).select("key", quant(F.col("a"), 6).alias("a"))


@query(f"WITH {_C4}, s AS (SELECT DISTINCT d, i, j, k FROM c) SELECT d, i, j, k, row_number() OVER (ORDER BY d, k, j, i) - 1 AS sid FROM s")
def cell_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.numbered(_sums(spark, sf_dir, 4).select("d", "i", "j", "k"))


@query(f"WITH {_C5}, s AS (SELECT d, k, count(DISTINCT i * 1000 + j) n FROM c GROUP BY 1, 2) SELECT d, k, n, CAST(coalesce(sum(n) OVER (ORDER BY d, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s")
def slab_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.slice_starts(_sums(spark, sf_dir, 5)).select("d", "k", "n", F.col("start").cast("long").alias("start"))


_HALVES = f"""{_C4}, l AS (SELECT d, i, j, k, sum(a) a FROM c WHERE pid % 2 = 0 GROUP BY ALL), r AS (SELECT d, i, j, k, sum(a) a FROM c WHERE pid % 2 = 1 AND x > 20 GROUP BY ALL)"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _cells(spark, sf_dir, 4)
    sums = lambda f: c.filter(f).groupBy("d", "i", "j", "k").agg(F.sum("a").alias("a"))
    return sums("pid % 2 = 0"), sums("pid % 2 = 1 AND x > 20")


@query(f"WITH {_HALVES} SELECT d, i, j, k FROM l UNION SELECT d, i, j, k FROM r")
def tree_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tree_union(*_halves(spark, sf_dir))


@query(f"WITH {_HALVES} SELECT coalesce(l.d, r.d) d, coalesce(l.i, r.i) i, coalesce(l.j, r.j) j, coalesce(l.k, r.k) k, {q('coalesce(l.a, 0) + coalesce(r.a, 0)')} a FROM l FULL JOIN r ON l.i = r.i AND l.j = r.j AND l.k = r.k")
def sparse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ops.sparse_merge(*_halves(spark, sf_dir), ["a"])
    return m.select("d", "i", "j", "k", quant(F.col("a")).alias("a"))


@query(f"""WITH {_C4}, s AS (SELECT i, j, k, sum(a) > 8 f FROM c GROUP BY ALL)
SELECT CAST(dd AS INTEGER) d, CAST(i >> (4 - dd) AS INTEGER) i, CAST(j >> (4 - dd) AS INTEGER) j, CAST(k >> (4 - dd) AS INTEGER) k, bool_or(f) has_data FROM s, (SELECT range AS dd FROM range(5)) GROUP BY 1, 2, 3, 4""")
def has_data_pullup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pull_up(_sums(spark, sf_dir, 4).withColumn("has_data", F.col("a") > 8), "has_data")


@query(f"""WITH {_C4}, s AS (SELECT i, j, k, CASE WHEN count(*) < 3 THEN 'exterior' WHEN count(*) > 20 THEN 'interior' ELSE 'boundary' END g FROM c GROUP BY ALL)
SELECT 3 AS d, CAST(i >> 1 AS INTEGER) i, CAST(j >> 1 AS INTEGER) j, CAST(k >> 1 AS INTEGER) k, CASE WHEN bool_and(g = 'interior') THEN 'interior' WHEN bool_and(g = 'exterior') THEN 'exterior' ELSE 'boundary' END AS geometry FROM s GROUP BY 2, 3, 4""")
def geometry_pullup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sums(spark, sf_dir, 4).withColumn("geometry", F.when(F.col("n") < 3, "exterior").when(F.col("n") > 20, "interior").otherwise("boundary"))
    return ops.pull_up_geometry(s)


@query(f"""WITH {_C4}, s AS (SELECT DISTINCT i, j, k FROM c),
t AS (SELECT DISTINCT CAST(dd AS INTEGER) d, CAST(i >> (4 - dd) AS INTEGER) i, CAST(j >> (4 - dd) AS INTEGER) j, CAST(k >> (4 - dd) AS INTEGER) k FROM s, (SELECT range AS dd FROM range(5)) WHERE dd < 4 OR i < 8)
SELECT d, count(*) n FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.d = t.d + 1 AND b.i >> 1 = t.i AND b.j >> 1 = t.j AND b.k >> 1 = t.k) GROUP BY d""")
def leaf_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sums(spark, sf_dir, 4).select("d", "i", "j", "k")
    t = ops.ancestors(s).distinct().filter("d < 4 OR i < 8")
    return ops.leaves(t).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE t AS (SELECT 0 AS d, 0 AS i, 0 AS j, 0 AS k UNION ALL
SELECT d + 1, 2 * i + a, 2 * j + b, 2 * k + c FROM t, (SELECT unnest([0, 1]) a), (SELECT unnest([0, 1]) b), (SELECT unnest([0, 1]) c) WHERE d < 4 AND i <= j AND j <= k)
SELECT d, i, j, k FROM t""")
def predicate_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.refine(spark, 4, lambda t: (F.col("i") <= F.col("j")) & (F.col("j") <= F.col("k")))


@query(f"""WITH {_C4}, s AS (SELECT DISTINCT i, j, k FROM c), o AS (SELECT unnest([-1, 0, 1]) o)
SELECT DISTINCT 4 AS d, CAST(s.i + a.o AS INTEGER) i, CAST(s.j + b.o AS INTEGER) j, CAST(s.k + e.o AS INTEGER) k FROM s, o a, o b, o e WHERE s.i + a.o BETWEEN 0 AND 15 AND s.j + b.o BETWEEN 0 AND 15 AND s.k + e.o BETWEEN 0 AND 15""")
def thickened_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sums(spark, sf_dir, 4).select("d", "i", "j", "k")
    return ops.neighbours(s).select("d", *(F.col(f"n_{a}").alias(a) for a in "ijk")).distinct()


@query(f"WITH {U} SELECT d.range AS d, {q('min((floor(u * pow(2, d.range)) + 0.5) / pow(2, d.range))', 6)} low, count(DISTINCT CAST(floor(u * pow(2, d.range)) AS INTEGER)) n FROM u, range(5) d WHERE u < 1 GROUP BY 1")
def cell_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unit_points(spark, sf_dir).filter("u < 1").select("u", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("d"))
    rows = rows.select("d", F.floor(F.col("u") * F.pow(F.lit(2.0), F.col("d"))).cast("int").alias("i"))
    return rows.groupBy(F.col("d").cast("long").alias("d")).agg(quant(F.min(ops.center("d", "i")), 6).alias("low"), F.count_distinct("i").alias("n"))




@query()
def simplex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells at depth 4 that eight triangles meet."""
    from ..operators.envelope import simplex_cells as cells_of

    i = F.col("id")
    t = spark.range(8).select(i.alias("fid"), (0.1 + i * 0.05).alias("u0"), F.lit(0.2).alias("v0"), F.lit(0.15).alias("w0"), (0.3 + i * 0.05).alias("u1"), (0.25 + i * 0.03).alias("v1"), F.lit(0.4).alias("w1"), (0.15 + i * 0.02).alias("u2"), F.lit(0.5).alias("v2"), (0.2 + i * 0.04).alias("w2"))
    return cells_of(t, 4)


@query(f"""WITH {_C4}, s AS (SELECT i, j, k, bool_or(x > 45) h FROM c GROUP BY ALL), fam AS (SELECT DISTINCT i >> 1 i, j >> 1 j, k >> 1 k FROM s WHERE h)
SELECT count(*) n FROM s JOIN fam ON s.i >> 1 = fam.i AND s.j >> 1 = fam.j AND s.k >> 1 = fam.k""")
def clipped_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells at depth 4 left when families without data below depth 3 go."""
    s = _cells(spark, sf_dir, 4).groupBy("d", "i", "j", "k").agg(F.bool_or(F.col("x") > 45).alias("h"))
    return ops.clip(s, "h", 3).filter("d = 4").agg(F.count(F.lit(1)).alias("n"))
