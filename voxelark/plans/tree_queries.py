"""Queries of tree structure, envelopes and node flags over line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as ops
from ..operators import envelope
from ..operators.fem import full_level
from ..registry import query
from .data import cells_cte, unit_points


def _tree(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """All cells over those that hold a point with x > 25."""
    s = ops.with_cell(unit_points(spark, sf_dir).filter("x > 25"), depth).select("d", "i", "j", "k").distinct()
    return ops.ancestors(s).distinct()


def _t(depth: int, name: str = "t", where: str = "x > 25") -> str:
    up = f"CAST(i >> ({depth} - dd) AS INTEGER) i, CAST(j >> ({depth} - dd) AS INTEGER) j, CAST(k >> ({depth} - dd) AS INTEGER) k"
    return f"{name} AS (SELECT DISTINCT CAST(dd AS INTEGER) d, {up} FROM c, (SELECT range AS dd FROM range({depth + 1})) WHERE {where})"


_EIGHT = "(SELECT unnest([0, 1]) a), (SELECT unnest([0, 1]) b), (SELECT unnest([0, 1]) e)"
_C3, _C4 = cells_cte(3), cells_cte(4)


@query(f"""WITH {_C3}, {_t(3)}, ch AS (SELECT d + 1 AS d, 2 * i + a AS i, 2 * j + b AS j, 2 * k + e AS k FROM t, {_EIGHT}),
fam AS (SELECT DISTINCT d, i >> 1 i, j >> 1 j, k >> 1 k FROM ch WHERE (i + j + k) % 7 = 0)
SELECT d, count(*) n, sum(i + 3 * j + 5 * k)::BIGINT s FROM (SELECT * FROM t UNION SELECT d, 2 * i + a, 2 * j + b, 2 * k + e FROM fam, {_EIGHT}) GROUP BY d""")
def grown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.grow(_tree(spark, sf_dir, 3), lambda: (F.col("i") + F.col("j") + F.col("k")) % 7 == 0)
    return out.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("i + 3 * j + 5 * k")).alias("s"))


@query(f"""WITH {_C4}, {_t(4)} SELECT d, count(*) n, sum(i + 3 * j + 5 * k)::BIGINT s FROM t
WHERE NOT (d > 2 AND (i >> (d - 2)) = (j >> (d - 2))) GROUP BY d""")
def pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.pruned(_tree(spark, sf_dir, 4), (F.col("d") == 2) & (F.col("i") == F.col("j")))
    return out.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("i + 3 * j + 5 * k")).alias("s"))


@query(f"""WITH {_C4}, {_t(4)}, kept AS (SELECT * FROM t WHERE d >= 1 AND i >> (d - 1) = 1 AND j >> (d - 1) = 0 AND k >> (d - 1) = 1 AND (d < 4 OR k % 2 = 0) AND (d < 3 OR j < 3))
SELECT DISTINCT CAST(dd AS INTEGER) d, CAST(i >> (d - dd) AS INTEGER) i, CAST(j >> (d - dd) AS INTEGER) j, CAST(k >> (d - dd) AS INTEGER) k FROM kept, (SELECT range AS dd FROM range(1, 5)) WHERE dd <= d""")
def subtree_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.expr("(d < 4 OR k % 2 = 0) AND (d < 3 OR j < 3)")
    return ops.subtree(_tree(spark, sf_dir, 4), (1, 1, 0, 1), keep)


@query(f"""WITH {_C3}, {_t(3, "w")}, t AS (SELECT * FROM w WHERE d < 3 OR i < 6), leaf AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.d = t.d + 1 AND b.i >> 1 = t.i AND b.j >> 1 = t.j AND b.k >> 1 = t.k)),
own AS (SELECT * FROM t WHERE d = 3 AND (i + j) % 3 = 0), near AS (SELECT own.d, own.i, own.j, own.k, own.i + a AS ni, own.j + b AS nj, own.k + e AS nk FROM own, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b), (SELECT unnest([-1, 0, 1]) e)
  WHERE own.i + a BETWEEN 0 AND 7 AND own.j + b BETWEEN 0 AND 7 AND own.k + e BETWEEN 0 AND 7)
SELECT DISTINCT n.d, n.i, n.j, n.k, l.d AS l_d, l.i AS l_i, l.j AS l_j, l.k AS l_k FROM near n JOIN leaf l ON l.i = n.ni >> (3 - l.d) AND l.j = n.nj >> (3 - l.d) AND l.k = n.nk >> (3 - l.d)""")
def neighbouring_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir, 3).filter("d < 3 OR i < 6")
    return ops.neighbour_leaves(t.filter("d = 3 AND (i + j) % 3 = 0"), t)


@query(f"""WITH {_C4}, {_t(4)}, {_t(4, "o", "a > 0.04")}, a AS (SELECT *, row_number() OVER (ORDER BY d, k, j, i) - 1 AS client FROM t), b AS (SELECT *, row_number() OVER (ORDER BY d, k, j, i) - 1 AS server FROM o)
SELECT client, server FROM a JOIN b ON a.d = b.d AND a.i = b.i AND a.j = b.j AND a.k = b.k""")
def client_node_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.with_cell(unit_points(spark, sf_dir).filter("a > 0.04"), 4).select("d", "i", "j", "k").distinct()
    return ops.node_map(_tree(spark, sf_dir, 4), ops.ancestors(s).distinct())


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of all cells, one place beyond the cube among them; active where points are."""
    t = _tree(spark, sf_dir, 3)
    rows = ops.children(t.filter("d < 3").select("d", "i", "j", "k")).union(t.filter("d = 3").selectExpr("d", "i + 1", "j", "k")).distinct()
    return rows.join(t.withColumn("active", F.lit(True)), ["d", "i", "j", "k"], "left").fillna(False, ["active"])


_FLAGS = f"""WITH {_C3}, {_t(3)}, r AS (SELECT d + 1 AS d, 2 * i + a AS i, 2 * j + b AS j, 2 * k + e AS k FROM t, {_EIGHT} WHERE d < 3 UNION SELECT d, i + 1, j, k FROM t WHERE d = 3),
x AS (SELECT r.*, t.d IS NOT NULL AS active FROM r LEFT JOIN t ON t.d = r.d AND t.i = r.i AND t.j = r.j AND t.k = r.k),
g AS (SELECT x.*, NOT bool_or(active) OVER (PARTITION BY d, i >> 1, j >> 1, k >> 1) AS ghost FROM x)
SELECT d, active, ghost, NOT ghost AND i < pow(2, d) AS space, NOT ghost AND i <= pow(2, d) AS fem, count(*) n FROM g GROUP BY ALL"""


@query(_FLAGS)
def node_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.validity(_flagged(spark, sf_dir), 1).groupBy("d", "active", "ghost", "space", "fem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(d AS INTEGER) d, deg AS degree, greatest(pow(2, d) - CASE WHEN deg = 1 THEN 1 ELSE 2 END, 0)::BIGINT n FROM range(6) t(d), (SELECT unnest([1, 2]) deg)""")
def interior_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many offsets along an axis have a basis wholly inside, of corners (degree 1) and cells (degree 2)."""
    rows = spark.range(6).select(F.col("id").cast("int").alias("d")).withColumn("i", F.explode(F.expr("sequence(0, shiftleft(1, d))")))
    one, two = (rows.groupBy("d").agg(F.count_if(ops.interiorly_supported(g, ("i",))).alias("n")).withColumn("degree", F.lit(g)) for g in (1, 2))
    return one.union(two)


@query(f"""WITH {_C4}, {_t(4)} SELECT d, i, j, k FROM t WHERE d <= 3 AND (k - 1) * pow(2, 3 - d) < 6 AND (k + 2) * pow(2, 3 - d) > 4""")
def shared_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose quadratic spline reaches slices 4 and 5 of depth 3."""
    return _tree(spark, sf_dir, 4).filter(ops.support_meets("k", 3, 4, 6, 2))


@query("SELECT CAST(d AS INTEGER) d, pow(8, d)::BIGINT n, (pow(8, d) * (pow(2, d) - 1) / 2)::BIGINT s FROM range(5) t(d)")
def full_tree_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.full_tree(spark, 4).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))


_near = "SELECT DISTINCT d - 1 AS d, (i >> 1) + a AS i, (j >> 1) + b AS j, (k >> 1) + e AS k FROM {t}, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b), (SELECT unnest([-1, 0, 1]) e) WHERE (i >> 1) + a BETWEEN 0 AND pow(2, d - 1) - 1 AND (j >> 1) + b BETWEEN 0 AND pow(2, d - 1) - 1 AND (k >> 1) + e BETWEEN 0 AND pow(2, d - 1) - 1"


@query(f"""WITH {_C4}, l4 AS (SELECT DISTINCT d, i, j, k FROM c WHERE x > 45 AND a > 0.06), l3 AS ({_near.format(t='l4')}), l2 AS ({_near.format(t='l3')}), l1 AS ({_near.format(t='l2')}), l0 AS ({_near.format(t='l1')})
SELECT CAST(d AS INTEGER) d, count(*) n, sum(i + 3 * j + 5 * k)::BIGINT s FROM (SELECT * FROM l4 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0) GROUP BY d""")
def support_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and all coarser ones whose support overlaps theirs, by depth."""
    s = ops.with_cell(unit_points(spark, sf_dir).filter("x > 45 AND a > 0.06"), 4).select("d", "i", "j", "k").distinct()
    return ops.support_closure(s).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("i + 3 * j + 5 * k")).alias("s"))


#: A box of cells 4 to 11 of 16 along each axis; its outermost layer holds the surface.
_BOX = """c4 AS (SELECT 4 AS d, a.range AS i, b.range AS j, e.range AS k FROM range(16) a, range(16) b, range(16) e),
g4 AS (SELECT d, i, j, k, CASE WHEN least(i, j, k) < 4 OR greatest(i, j, k) > 11 THEN 'exterior' WHEN least(i, j, k) = 4 OR greatest(i, j, k) = 11 THEN 'boundary' ELSE 'interior' END geometry FROM c4)"""
_UP = "SELECT d - 1 AS d, i >> 1 AS i, j >> 1 AS j, k >> 1 AS k, CASE WHEN bool_and(geometry = 'interior') THEN 'interior' WHEN bool_and(geometry = 'exterior') THEN 'exterior' ELSE 'boundary' END geometry FROM {t} GROUP BY 1, 2, 3, 4"
_BOX += "".join(f", g{d} AS ({_UP.format(t=f'g{d + 1}')})" for d in (3, 2, 1, 0)) + ", g AS (" + " UNION ALL ".join(f"SELECT * FROM g{d}" for d in range(5)) + ")"


def _box(spark: SparkSession) -> DataFrame:
    shell = F.expr("least(i, j, k) >= 4 AND greatest(i, j, k) <= 11 AND (least(i, j, k) = 4 OR greatest(i, j, k) = 11)")
    return envelope.designators(full_level(spark, 4, ops.AXES).filter(shell), 4)


@query(f"WITH {_BOX} SELECT CAST(d AS INTEGER) d, geometry, count(*) n FROM g GROUP BY 1, 2")
def envelope_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside, outside and border of a closed box, flooded from the cube's faces."""
    return _box(spark).groupBy("d", "geometry").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BOX}, {_C4}, s AS (SELECT DISTINCT i, j, k FROM c WHERE x > 48),
near AS (SELECT DISTINCT s.i + a AS i, s.j + b AS j, s.k + e AS k FROM s, (SELECT unnest([-1, 0, 1]) a), (SELECT unnest([-1, 0, 1]) b), (SELECT unnest([-1, 0, 1]) e))
SELECT CASE WHEN n.i IS NOT NULL AND geometry = 'exterior' THEN 'boundary' ELSE geometry END geometry, count(*) n FROM g4 LEFT JOIN near n USING (i, j, k) GROUP BY 1""")
def eroded_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outside drawn back from cells with points."""
    near = ops.with_cell(unit_points(spark, sf_dir).filter("x > 48"), 4).select("d", "i", "j", "k").distinct()
    return envelope.eroded(_box(spark).filter("d = 4"), near).groupBy("geometry").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BOX}, o AS (SELECT i + a AS i, j + b AS j, k + e AS k, geometry FROM g4, {_EIGHT})
SELECT count(*) n, sum(i + 3 * j + 5 * k)::BIGINT s FROM (SELECT i, j, k FROM o GROUP BY 1, 2, 3 HAVING bool_and(geometry = 'exterior'))""")
def locked_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners where a field is held at 0: all of their cells lie outside."""
    return envelope.locked_corners(_box(spark), 4).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("i + 3 * j + 5 * k")).alias("s"))
