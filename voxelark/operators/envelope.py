"""Inside and outside of a closed mesh on the cell hierarchy, and constraints that follow from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .cells import AXES, locate, neighbours, pull_up, pull_up_geometry, with_cell

UNIT = ("u", "v", "w")


def touched_cells(samples: DataFrame, depth: int) -> DataFrame:
    """Cells at a depth that hold a piece of the surface, from points spread over it closer than a cell."""
    return with_cell(samples, depth).select("d", *AXES).distinct()


def simplex_cells(triangles: DataFrame, depth: int) -> DataFrame:
    """Rows (fid, d, i, j, k) of the cells that a triangle meets: those of its box that no face normal,
    triangle normal or edge cross product separates from it.

    triangles: fid, u0, v0, w0 ... u2, v2, w2 in unit coordinates. Candidates come by exploding the
    box, an equi-key for later joins; the separating-axis test keeps the rest exact.
    """
    size = float(1 << depth)
    rows = triangles
    for a, c in zip(AXES, UNIT, strict=True):
        low, high = F.least(*(F.col(f"{c}{n}") for n in range(3))), F.greatest(*(F.col(f"{c}{n}") for n in range(3)))
        last = F.lit((1 << depth) - 1)
        rows = rows.withColumn(a, F.explode(F.sequence(locate(low, depth), F.least(F.greatest(locate(high, depth), locate(low, depth)), last))))
    p = [[F.col(f"{c}{n}") * size - (F.col(a) + 0.5) for a, c in zip(AXES, UNIT, strict=True)] for n in range(3)]
    sub = lambda x, y: [m - n for m, n in zip(x, y, strict=True)]
    dot = lambda x, y: reduce(lambda m, n: m + n, (m * n for m, n in zip(x, y, strict=True)))
    edges = [sub(p[1], p[0]), sub(p[2], p[1]), sub(p[0], p[2])]
    axes = []
    for e in edges:
        axes += [[F.lit(0.0), -e[2], e[1]], [e[2], F.lit(0.0), -e[0]], [-e[1], e[0], F.lit(0.0)]]
    a, b = edges[0], edges[1]
    axes.append([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])
    meets = F.lit(True)
    for x in axes:
        at = [dot(q, x) for q in p]
        reach = (F.abs(x[0]) + F.abs(x[1]) + F.abs(x[2])) / 2 + 1e-12
        meets = meets & (F.least(*at) <= reach) & (F.greatest(*at) >= -reach)
    return rows.filter(meets).select("fid", F.lit(depth).alias("d"), *AXES)


def designators(boundary: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """Rows (d, i, j, k, geometry) of all cells to ``depth``: boundary, interior or exterior.

    The outside is flooded from the cube's faces through cells without surface, a step of face
    neighbours a round; what it doesn't reach is inside. Coarser cells follow from their children.
    No path is longer than the cells there are; a flood cut off by a smaller ``most`` is an error.
    """
    spark = boundary.sparkSession
    n = 1 << depth
    cells = spark.range(n**3).select(F.lit(depth).alias("d"), *(F.floor(F.col("id") / n**k % n).cast("int").alias(a) for k, a in enumerate(AXES)))
    free = written(cells.join(boundary, ["d", *AXES], "left_anti"))
    edge = reduce(lambda x, y: x | y, ((F.col(a) == 0) | (F.col(a) == n - 1) for a in AXES))
    out = front = written(free.filter(edge))
    for _ in range(most or n**3 + 1):
        steps = neighbours(front).filter(reduce(lambda x, y: x + y, (F.abs(F.col(f"n_{a}") - F.col(a)) for a in AXES)) == 1)
        new = steps.select("d", *(F.col(f"n_{a}").alias(a) for a in AXES)).distinct()
        front = written(new.join(free, ["d", *AXES], "left_semi").join(out, ["d", *AXES], "left_anti"))
        if front.isEmpty():
            break
        out = written(out.union(front))
    else:
        raise RuntimeError("the flood was cut off before it had reached all of the outside")
    inside = free.join(out, ["d", *AXES], "left_anti")
    level = written(boundary.select("d", *AXES, F.lit("boundary").alias("geometry")).union(out.select("d", *AXES, F.lit("exterior").alias("geometry"))).union(inside.select("d", *AXES, F.lit("interior").alias("geometry"))))
    whole = level
    for _ in range(depth):
        level = pull_up_geometry(level)
        whole = whole.union(level)
    return written(whole)


def eroded(cells: DataFrame, near: DataFrame, reach: int = 1) -> DataFrame:
    """``cells`` with exterior ones within ``reach`` of a cell of ``near`` made boundary, so a field isn't pinned close to data."""
    close = neighbours(near.select("d", *AXES), -reach, reach).select("d", *(F.col(f"n_{a}").alias(a) for a in AXES)).distinct().withColumn("close", F.lit(True))
    g = F.when(F.col("close") & (F.col("geometry") == "exterior"), "boundary").otherwise(F.col("geometry"))
    return cells.join(close, ["d", *AXES], "left").withColumn("geometry", g).drop("close")


def locked_corners(cells: DataFrame, depth: int) -> DataFrame:
    """Corners at ``depth`` all of whose cells are exterior: there a field is held at 0."""
    from .cells import offsets

    level = cells.filter(F.col("d") == depth)
    c = level.select("geometry", *AXES, F.explode(offsets(0, 1)).alias("o")).select(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in AXES), "geometry")
    return c.groupBy(*AXES).agg(F.bool_and(F.col("geometry") == "exterior").alias("locked")).filter("locked").drop("locked")


def has_data(cells: DataFrame, flag: str) -> DataFrame:
    return pull_up(cells, flag)
