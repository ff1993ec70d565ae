"""Cell tables keyed by (d, i, j, k): location, hierarchy, neighbourhoods, roll-ups, splats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.splines import component_values

KEY = ["d", "i", "j", "k"]
AXES = KEY[1:]


def locate(u: Column, depth: Column | int) -> Column:
    """Offset of the cell that holds ``u``: on a border the lower one."""
    return F.greatest(F.ceil(u * F.pow(F.lit(2.0), depth if isinstance(depth, Column) else F.lit(float(depth)))).cast("int") - 1, F.lit(0))


def with_cell(df: DataFrame, depth: Column | int, unit: Sequence[str] = ("u", "v", "w"), axes: Sequence[str] = AXES) -> DataFrame:
    d = depth if isinstance(depth, Column) else F.lit(depth)
    return df.withColumns({"d": d.cast("int")} | {a: locate(F.col(u), depth) for a, u in zip(axes, unit, strict=True)})


def morton(axes: Sequence[str] = AXES, bits: int = 21) -> Column:
    """Interleaved bits of the offsets in one number, for partitioning by place."""
    def spread(c: Column) -> Column:
        x = c.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
        for s, m in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            x = x.bitwiseOR(F.shiftleft(x, s)).bitwiseAND(F.lit(m))
        return x

    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(spread(F.col(a)), n) for n, a in enumerate(axes)))


def center(d: Column | str = "d", axis: Column | str = "i") -> Column:
    d, axis = (F.col(c) if isinstance(c, str) else c for c in (d, axis))
    return (axis + 0.5) / F.pow(F.lit(2.0), d)


def parents(df: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    return df.withColumns({"d": F.col("d") - 1} | {a: F.shiftright(a, 1) for a in axes})


def children(df: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    offsets = F.array(*(F.struct(*(F.lit(b).alias(a) for a, b in zip(axes, bits, strict=True))) for bits in product((0, 1), repeat=len(axes))))
    return df.withColumn("_o", F.explode(offsets)).withColumns({"d": F.col("d") + 1} | {a: F.col(a) * 2 + F.col(f"_o.{a}") for a in axes}).drop("_o")


def ancestors(df: DataFrame, least: int = 0, axes: Sequence[str] = AXES) -> DataFrame:
    """Each row for its cell and all above it, down to depth ``least``."""
    out = df.withColumn("_a", F.explode(F.sequence(F.lit(least), F.col("d"))))
    return out.withColumns({a: F.expr(f"shiftright({a}, d - _a)") for a in axes}).withColumn("d", F.col("_a")).drop("_a")


def projective(values: dict[str, Column], weight: Column) -> list[Column]:
    """Sums of weight and weighted values: additive, and read as their quotient."""
    return [F.sum(weight).alias("weight"), *(F.sum(c * weight).alias(n) for n, c in values.items())]


def mean(value: Column | str, weight: Column | str = "weight") -> Column:
    """A weighted mean; null without weight."""
    return F.try_divide(value if isinstance(value, Column) else F.col(value), weight if isinstance(weight, Column) else F.col(weight))


def roll_up(cells: DataFrame, sums: Sequence[str], least: int = 0, axes: Sequence[str] = AXES) -> DataFrame:
    """Every ancestor with the sum of its subtree. Level by level, so a row is read once per level of its own."""
    depth = cells.agg(F.max("d")).first()[0]
    level = cells.select("d", *axes, *sums)
    out = [level.filter(F.col("d") == depth)] if depth is not None else [level]
    for d in range((depth or 0) - 1, least - 1, -1):
        up = parents(out[-1], axes).unionByName(level.filter(F.col("d") == d))
        out.append(up.groupBy("d", *axes).agg(*(F.sum(s).alias(s) for s in sums)))
    return reduce(DataFrame.unionByName, out)


def pull_up(cells: DataFrame, flag: str, axes: Sequence[str] = AXES) -> DataFrame:
    """A flag that holds for a cell if it holds for any below it."""
    return ancestors(cells.select("d", *axes, flag), axes=axes).groupBy("d", *axes).agg(F.bool_or(flag).alias(flag))


def pull_up_geometry(children_: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """``geometry`` of parents: interior or exterior if all children are, else boundary."""
    g = F.col("geometry")
    return parents(children_, axes).groupBy("d", *axes).agg(
        F.when(F.bool_and(g == "interior"), "interior").when(F.bool_and(g == "exterior"), "exterior").otherwise("boundary").alias("geometry"))


def offsets(low: int, high: int, axes: Sequence[str] = AXES) -> Column:
    return F.array(*(F.struct(*(F.lit(x).alias(a) for a, x in zip(axes, o, strict=True))) for o in product(range(low, high + 1), repeat=len(axes))))


def neighbours(df: DataFrame, low: int = -1, high: int = 1, axes: Sequence[str] = AXES) -> DataFrame:
    """Each row for every cell of a window about its own, inside the cube, as columns ``n_<axis>``; for an equi-join, never a range join."""
    out = df.withColumn("_o", F.explode(offsets(low, high, axes))).withColumns({f"n_{a}": F.col(a) + F.col(f"_o.{a}") for a in axes})
    size = F.expr("shiftleft(1, d)")
    return out.filter(reduce(lambda a, b: a & b, ((F.col(f"n_{a}") >= 0) & (F.col(f"n_{a}") < size) for a in axes))).drop("_o")


def stencil_join(df: DataFrame, cells: DataFrame, low: int = -1, high: int = 1, axes: Sequence[str] = AXES) -> DataFrame:
    """Rows of ``df`` with the cells of their window that exist; the cells' columns but the key get ``n_`` before them."""
    other = cells.select("d", *(F.col(a).alias(f"n_{a}") for a in axes), *(F.col(c).alias(f"n_{c}") for c in cells.columns if c not in ("d", *axes)))
    return neighbours(df, low, high, axes).join(other, ["d", *(f"n_{a}" for a in axes)])


def deepest_cell(points: DataFrame, cells: DataFrame, key: str, most: int, unit: Sequence[str] = ("u", "v", "w"), axes: Sequence[str] = AXES) -> DataFrame:
    """For each point the deepest existing cell that holds it, at depth ``most`` at most."""
    rows = points.select(key, *unit, F.explode(F.sequence(F.lit(0), F.lit(most))).alias("d"))
    rows = with_cell(rows, F.col("d"), unit, axes)
    found = rows.join(cells.select("d", *axes).distinct(), ["d", *axes])
    return found.groupBy(key).agg(F.max_by(F.struct("d", *axes), "d").alias("c")).select(key, "c.*")


def leaves(cells: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Cells without children."""
    return cells.join(parents(cells, axes).select("d", *axes).distinct(), ["d", *axes], "left_anti")


def full_tree(spark, depth: int, axes: Sequence[str] = AXES) -> DataFrame:
    """All cells to a depth."""
    rows = spark.range(depth + 1).select(F.col("id").cast("int").alias("d"))
    for a in axes:
        rows = rows.withColumn(a, F.explode(F.expr("sequence(0, cast(shiftleft(1, d) - 1 as int))")))
    return rows


def tree_union(a: DataFrame, b: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    return a.select("d", *axes).union(b.select("d", *axes)).distinct()


def sparse_merge(a: DataFrame, b: DataFrame, values: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """Values added where both have a cell, taken over where one has."""
    both = a.select("d", *axes, *values).union(b.select("d", *axes, *values))
    return both.groupBy("d", *axes).agg(*(F.sum(v).alias(v) for v in values))


def clip(cells: DataFrame, flag: str, base: int, axes: Sequence[str] = AXES) -> DataFrame:
    """Cells to depth ``base``, and those below of which one sibling at least has data."""
    up = pull_up(cells, flag, axes)
    families = parents(up.filter(F.col(flag)), axes).select("d", *axes).distinct()
    kept = parents(up.withColumns({f"_{a}": F.col(a) for a in axes}), axes).join(families, ["d", *axes], "left_semi")
    kept = kept.select((F.col("d") + 1).alias("d"), *(F.col(f"_{a}").alias(a) for a in axes), flag).filter(F.col("d") > base)
    return up.filter(F.col("d") <= base).select("d", *axes, flag).union(kept)


def support_closure(cells: DataFrame, low: int = -1, high: int = 1, axes: Sequence[str] = AXES) -> DataFrame:
    """Cells and, for each, all cells of its parent's window, on every level up to the root."""
    depth = cells.agg(F.max("d")).first()[0] or 0
    levels = cells.select("d", *axes).distinct()
    for d in range(depth, 0, -1):
        up = parents(levels.filter(F.col("d") == d), axes).distinct()
        near = neighbours(up, low, high, axes).select("d", *(F.col(f"n_{a}").alias(a) for a in axes))
        levels = levels.union(near).distinct()
    return levels


def refine(spark, depth: int, wants: Callable[[DataFrame], Column], axes: Sequence[str] = AXES) -> DataFrame:
    """The tree that grows from the root wherever ``wants`` holds for a cell."""
    level = full_tree(spark, 0, axes)
    out = [level]
    for _ in range(depth):
        level = children(level.filter(wants(level)), axes)
        out.append(level)
    return reduce(DataFrame.union, out)


def grow(tree: DataFrame, wants: Callable[[], Column], axes: Sequence[str] = AXES) -> DataFrame:
    """The tree with all children of every cell one of whose children is wanted; ``wants`` is asked about the children's key columns."""
    wanted = parents(children(tree.select("d", *axes), axes).filter(wants()), axes).select("d", *axes).distinct()
    return tree_union(tree, children(wanted, axes), axes)


def pruned(tree: DataFrame, prune: Column, axes: Sequence[str] = AXES) -> DataFrame:
    """The tree without what is below a cell for which ``prune`` holds; the cell itself stays."""
    cut = tree.filter(prune).select("d", *axes)
    below = ancestors(tree.select("d", *axes, *(F.col(a).alias(f"_{a}") for a in axes), F.col("d").alias("_d")), axes=axes).filter("d < _d")
    gone = below.join(cut, ["d", *axes], "left_semi").select(F.col("_d").alias("d"), *(F.col(f"_{a}").alias(a) for a in axes)).distinct()
    return tree.join(gone, ["d", *axes], "left_anti")


def subtree(tree: DataFrame, root: Sequence[int], keep: Column, axes: Sequence[str] = AXES) -> DataFrame:
    """Cells at or below ``root`` (depth, offsets) for which ``keep`` holds, with those between; no cell without its parent."""
    d, *at = root
    inside = reduce(lambda p, q: p & q, (F.expr(f"shiftright({a}, greatest(d - {d}, 0))") == x for a, x in zip(axes, at, strict=True)))
    kept = tree.filter((F.col("d") >= d) & inside & keep)
    return ancestors(kept.select("d", *axes), d, axes).distinct()


def neighbour_leaves(cells: DataFrame, tree: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Rows of ``cells`` with the leaves of ``tree`` (l_d, l_<axis>), at their depth or coarser, that touch their window of 3; each leaf once."""
    leaf = leaves(tree, axes).select("d", *axes, F.lit(True).alias("_leaf"))
    key = [*("_d", *(f"_{a}" for a in axes))]
    near = neighbours(cells.select("d", *axes, F.col("d").alias("_d"), *(F.col(a).alias(f"_{a}") for a in axes)), -1, 1, axes)
    near = near.select("d", *(F.col(f"n_{a}").alias(a) for a in axes), *key).distinct()
    found = ancestors(near, axes=axes).distinct().join(leaf, ["d", *axes])
    return found.select(F.col("_d").alias("d"), *(F.col(f"_{a}").alias(a) for a in axes), F.col("d").alias("l_d"), *(F.col(a).alias(f"l_{a}") for a in axes))


def node_map(client: DataFrame, server: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Rows (client, server): both trees' numbers of the cells that both have."""
    a, b = (numbered(t.select("d", *axes)).withColumnRenamed("sid", n) for t, n in ((client, "client"), (server, "server")))
    return a.join(b, ["d", *axes]).select("client", "server")


def validity(tree: DataFrame, degree: int, axes: Sequence[str] = AXES) -> DataFrame:
    """The tree with flags: ``space`` for cells of the cube, ``ghost`` for families without an active cell, ``fem`` for bases in bounds.

    ``tree`` has a boolean column active. A basis of odd degree sits at the cell's lower corner, one of even
    degree at its centre; in bounds are those from 0 to 2^d (odd) or to 2^d - 1 (even).
    """
    size = F.expr("shiftleft(1, d)")
    inside = lambda last: reduce(lambda p, q: p & q, ((F.col(a) >= 0) & (F.col(a) <= last) for a in axes))
    family = [F.shiftright(a, 1) for a in axes]
    alive = tree.filter("active").select((F.col("d")), *(f.alias(f"_{a}") for f, a in zip(family, axes, strict=True))).distinct().withColumn("_alive", F.lit(True))
    rows = tree.withColumns({f"_{a}": f for f, a in zip(family, axes, strict=True)}).join(alive, ["d", *(f"_{a}" for a in axes)], "left")
    ghost = F.col("_alive").isNull()
    return rows.select("d", *axes, "active", ghost.alias("ghost"), (~ghost & inside(size - 1)).alias("space"), (~ghost & inside(size if degree % 2 else size - 1)).alias("fem"))


def interior_span(degree: int) -> tuple[Column, Column]:
    """(begin, end) of the offsets whose bases lie wholly inside the cube, as columns of d; odd degrees sit on corners."""
    left, right = ((degree + 1) // 2, (degree + 1) // 2) if degree % 2 else (degree // 2, degree // 2 + 1)
    return F.lit(left), F.expr("shiftleft(1, d)") - right + 1


def interiorly_supported(degree: int, axes: Sequence[str] = AXES) -> Column:
    """Whether a basis' support doesn't leave the cube."""
    begin, end = interior_span(degree)
    return reduce(lambda p, q: p & q, ((F.col(a) >= begin) & (F.col(a) < end) for a in axes))


def support_meets(axis: str, shared: int, first: int, last: int, degree: int) -> Column:
    """Whether the support of a basis at depth ``shared`` or above meets the slices from ``first`` to before ``last`` of depth ``shared``."""
    low, high = (-(degree // 2), degree // 2 + 1) if degree % 2 == 0 else (-((degree + 1) // 2), (degree + 1) // 2)
    scale = F.expr(f"shiftleft(1, {shared} - d)")
    return (F.col("d") <= shared) & ((F.col(axis) + low) * scale < last) & ((F.col(axis) + high) * scale > first)


def numbered(cells: DataFrame) -> DataFrame:
    """Dense numbers ``sid`` in order of (d, k, j, i), from sorted ranges."""
    from .points import row_numbers

    return row_numbers(cells, ["d", "k", "j", "i"], "sid")


def slice_starts(cells: DataFrame) -> DataFrame:
    """(d, k, n, start): size of each slice and the running sum before it; one row a slice."""
    counts = cells.groupBy("d", "k").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("d", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def spline_weights(df: DataFrame, degree: int, unit: Sequence[str] = ("u", "v", "w"), axes: Sequence[str] = AXES) -> DataFrame:
    """Each row for every basis that its cell supports: offsets moved to the basis', and ``basis`` its value at the point.

    Degree 2 bases belong to cells, degree 1 bases to corners, so that offsets run to 2^d.
    """
    first = {0: 0, 1: 0, 2: -1}[degree]
    size = F.pow(F.lit(2.0), F.col("d"))
    out = df
    for a, u in zip(axes, unit, strict=True):
        v = component_values(F.col(u) * size - F.col(a), degree)
        out = out.withColumn(f"_w{a}", F.array(*(F.struct(F.lit(first + n).alias("o"), x.cast("double").alias("v")) for n, x in enumerate(v))))
    for a in axes:
        out = out.withColumn(f"_x{a}", F.explode(f"_w{a}"))
    basis = reduce(mul, (F.col(f"_x{a}.v") for a in axes))
    out = out.withColumn("basis", basis).withColumns({a: F.col(a) + F.col(f"_x{a}.o") for a in axes})
    last = F.expr("shiftleft(1, d)") if degree == 1 else F.expr("shiftleft(1, d) - 1")
    inside = reduce(lambda p, q: p & q, ((F.col(a) >= 0) & (F.col(a) <= last) for a in axes))
    return out.filter(inside).drop(*(f"_w{a}" for a in axes), *(f"_x{a}" for a in axes))


def splat(df: DataFrame, values: dict[str, Column], degree: int, unit: Sequence[str] = ("u", "v", "w"), axes: Sequence[str] = AXES) -> DataFrame:
    """Scatter-add of values times basis; rows have d, axes and unit coordinates.

    A cell's points all reach the same bases, so their products are summed per cell and basis
    first, without multiplying rows; only cells are then spread over their bases.
    """
    first = {0: 0, 1: 0, 2: -1}[degree]
    size = F.pow(F.lit(2.0), F.col("d"))
    rows = df.select("d", *axes, *(v.cast("double").alias(f"_v{n}") for n, v in enumerate(values.values())),
        *(c.cast("double").alias(f"_{a}{m}") for a, u in zip(axes, unit, strict=True) for m, c in enumerate(component_values(F.col(u) * size - F.col(a), degree))))
    places = list(product(range(degree + 1), repeat=len(axes)))
    basis = [reduce(mul, (F.col(f"_{a}{m}") for a, m in zip(axes, o, strict=True))) for o in places]
    sums = rows.groupBy("d", *axes).agg(*(F.sum(b * F.col(f"_v{n}")).alias(f"_s{n}_{m}") for n in range(len(values)) for m, b in enumerate(basis)))
    spread = F.array(*(F.struct(*(F.lit(first + m).alias(a) for a, m in zip(axes, o, strict=True)), *(F.col(f"_s{n}_{k}").alias(v) for n, v in enumerate(values))) for k, o in enumerate(places)))
    out = sums.select("d", *axes, F.explode(spread).alias("_o")).select("d", *((F.col(a) + F.col(f"_o.{a}")).alias(a) for a in axes), *(F.col(f"_o.{v}").alias(v) for v in values))
    last = F.expr("shiftleft(1, d)") if degree == 1 else F.expr("shiftleft(1, d) - 1")
    inside = reduce(lambda p, q: p & q, (F.col(a).between(0, last) for a in axes))
    return out.filter(inside).groupBy("d", *axes).agg(*(F.sum(v).alias(v) for v in values))
