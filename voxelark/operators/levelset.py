"""Level sets of corner grids: curves in the plane, surfaces in space.

Vertices lie on grid edges and are keyed by twice the edge's midpoint, so cells that share an edge
share the vertex without any bookkeeping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import linear_root
from ..storage import written
from .points import row_numbers

#: Corners of a square in turn; its edges run from each to the next.
_SQUARE = ((0, 0), (1, 0), (1, 1), (0, 1))


def square_segments(signs: tuple[bool, ...]) -> list[tuple[int, int]]:
    """Edges joined by a square's level set, the higher side on the left; corners that alternate are kept apart."""
    out = [e for e in range(4) if signs[e] and not signs[(e + 1) % 4]]  # leaves the high side
    into = [e for e in range(4) if not signs[e] and signs[(e + 1) % 4]]
    if not out:
        return []
    pairs = []
    for e in out:  # the entry before it, going round
        back = next(x % 4 for x in range(e + 3, e - 1, -1) if x % 4 in into)
        pairs.append((e, back))
    return pairs


def crossing_edges(grid: DataFrame, iso: float, axes=("i", "j", "k")) -> DataFrame:
    """Rows (key struct, a, b values, t, axis) of the grid edges whose ends lie on different sides of ``iso``."""
    out = None
    for n, axis in enumerate(axes):
        other = grid.select(*((F.col(a) - (1 if a == axis else 0)).alias(a) for a in axes), F.col("val").alias("to"))
        e = grid.join(other, list(axes)).filter((F.col("val") > iso) != (F.col("to") > iso))
        e = e.select(F.struct(*((F.col(a) * 2 + (1 if a == axis else 0)).alias(a) for a in axes)).alias("key"), F.lit(n).alias("axis"), linear_root(F.col("val"), F.col("to"), F.lit(iso)).alias("t"), *axes)
        out = e if out is None else out.union(e)
    return out


def vertices(edges: DataFrame, axes=("i", "j", "k"), step: Column | float = 1.0) -> DataFrame:
    """Rows (vid, key, x, y[, z]) numbered by key."""
    rows = edges.select(*(F.col(f"key.{a}").alias(f"_{a}") for a in axes), "axis", "t", *axes)
    rows = row_numbers(rows, [f"_{a}" for a in axes], "vid")
    place = [((F.col(a) + F.when(F.col("axis") == n, F.col("t")).otherwise(0.0)) * step).alias(x) for n, (a, x) in enumerate(zip(axes, "xyz", strict=False))]
    return rows.select("vid", F.struct(*(F.col(f"_{a}").alias(a) for a in axes)).alias("key"), *place)


def cells_with_corners(grid: DataFrame, axes) -> DataFrame:
    """Rows (axes, c): the values of each cell's corners, first axis fastest, of cells that have all."""
    o = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(b).alias(a) for a, b in zip(axes, bits[::-1], strict=True))) for n, bits in enumerate(product((0, 1), repeat=len(axes)))))
    rows = grid.withColumn("_o", F.explode(o)).select(*((F.col(a) - F.col(f"_o.{a}")).alias(a) for a in axes), F.col("_o.n").alias("n"), "val")
    rows = rows.groupBy(*axes).agg(F.array_sort(F.collect_list(F.struct("n", "val"))).alias("c")).filter(F.size("c") == 1 << len(axes))
    return rows.select(*axes, F.transform("c", lambda x: x["val"]).alias("c"))


def square_index(c: Column, iso: float) -> Column:
    """Bits of the corners over ``iso``."""
    return F.aggregate(F.transform(c, lambda x, n: F.when(x > iso, F.pow(F.lit(2.0), n).cast("int")).otherwise(0)), F.lit(0), lambda s, x: s + x)


def curve(grid: DataFrame, iso: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and segments (a, b) of a level curve over a grid (i, j, val); 16 cases as a constant table."""
    spark = grid.sparkSession
    cases = []
    for index in range(16):
        by_corner = {(x, y): bool(index >> (x + 2 * y) & 1) for x in (0, 1) for y in (0, 1)}
        for e, f in square_segments(tuple(by_corner[p] for p in _SQUARE)):
            mid = [tuple(_SQUARE[k][d] + _SQUARE[(k + 1) % 4][d] for d in (0, 1)) for k in (e, f)]
            cases.append((index, *mid[0], *mid[1]))
    table = spark.createDataFrame(cases, "case int, ai int, aj int, bi int, bj int")
    v = written(vertices(crossing_edges(grid, iso, ("i", "j")), ("i", "j")))
    s = cells_with_corners(grid, ("i", "j")).withColumn("case", square_index(F.col("c"), iso)).join(F.broadcast(table), "case")
    key = lambda p: F.struct((F.col("i") * 2 + F.col(f"{p}i")).alias("i"), (F.col("j") * 2 + F.col(f"{p}j")).alias("j"))
    s = s.select(key("a").alias("ka"), key("b").alias("kb"))
    return v, s.join(v.select(F.col("key").alias("ka"), F.col("vid").alias("a")), "ka").join(v.select(F.col("key").alias("kb"), F.col("vid").alias("b")), "kb").select("a", "b")


#: Faces of a cube as its corners in turn, seen from outside.
_FACES = [
    ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)),
    ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)),
    ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)),
]


def cube_polygons(over: tuple[bool, ...]) -> list[list[tuple[int, int, int]]]:
    """Loops of edge keys (twice the midpoints) of a cube whose corners, first axis fastest, are over or not."""
    high = lambda p: over[p[0] + 2 * p[1] + 4 * p[2]]
    after = {}
    for face in _FACES:
        mid = [tuple(a + b for a, b in zip(face[e], face[(e + 1) % 4], strict=True)) for e in range(4)]
        for e, f in square_segments(tuple(high(p) for p in face)):
            after[mid[f]] = mid[e]
    loops = []
    while after:
        start, at = next(iter(after.items()))
        loop = [start]
        del after[start]
        while at != start:
            loop.append(at)
            at = after.pop(at)
        loops.append(loop)
    return loops


def surface(grid: DataFrame, iso: float, step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, key, x, y, z) and faces (fid, ids) of a level surface over a grid (i, j, k, val)."""
    axes = ("i", "j", "k")
    v = written(vertices(crossing_edges(grid, iso), axes, step))
    c = cells_with_corners(grid, axes).withColumn("case", square_index(F.col("c"), iso)).filter((F.col("case") > 0) & (F.col("case") < 255)).select(*axes, "case")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        for t in batches:
            rows = []
            for i, j, k, case in zip(t["i"], t["j"], t["k"], t["case"], strict=True):
                if case not in known:
                    known[case] = cube_polygons(tuple(bool(case >> n & 1) for n in range(8)))
                for n, loop in enumerate(known[case]):
                    rows += [(i, j, k, n, pos, 2 * i + a, 2 * j + b, 2 * k + c) for pos, (a, b, c) in enumerate(loop)]
            yield pd.DataFrame(rows, columns=["ci", "cj", "ck", "n", "pos", "i", "j", "k"])

    loops = c.mapInPandas(run, "ci int, cj int, ck int, n int, pos int, i int, j int, k int")
    ids = loops.select("ci", "cj", "ck", "n", "pos", F.struct("i", "j", "k").alias("key")).join(v.select("key", "vid"), "key")
    faces = ids.groupBy("ci", "cj", "ck", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda x: x["vid"]).alias("ids"))
    return v, row_numbers(written(faces), ["ck", "cj", "ci", "n"], "fid").select("fid", "ids")
