"""Meshes as two tables: vertices (vid, x, y, z, value...) and faces (fid, ids)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import triangle_area
from ..storage import written
from .points import row_numbers

XYZ = ("x", "y", "z")


def corners(faces: DataFrame) -> DataFrame:
    """Rows (fid, pos, vid)."""
    return faces.select("fid", F.posexplode("ids").alias("pos", "vid"))


def half_edges(faces: DataFrame, *keep: str) -> DataFrame:
    """Rows (fid, a, b) from each corner to the next, the last to the first."""
    turned = F.concat(F.slice("ids", 2, F.size("ids")), F.slice("ids", 1, 1))
    return faces.select("fid", *keep, F.explode(F.arrays_zip(F.col("ids").alias("a"), turned.alias("b"))).alias("e")).select("fid", *keep, "e.a", "e.b")


def edges(faces: DataFrame) -> DataFrame:
    """Distinct undirected edges (a, b, n) with the number of faces at each."""
    e = half_edges(faces).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def polygon_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows (fid, area): a triangle's area, else the fan about the mean corner; fewer corners have none."""
    v = vertices.select("vid", *XYZ)
    c = corners(faces).join(v, "vid")
    mid = c.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"m{a}") for a in XYZ))
    far = v.select(F.col("vid").alias("b"), *(F.col(a).alias(f"q{a}") for a in XYZ))
    e = half_edges(faces).join(v.withColumnRenamed("vid", "a"), "a").join(far, "b").join(mid, "fid").filter("n > 2")
    area = triangle_area([F.col(f"m{a}") for a in XYZ], [F.col(a) for a in XYZ], [F.col(f"q{a}") for a in XYZ])
    found = e.groupBy("fid").agg(F.sum(area).alias("area"))
    return faces.select("fid").join(found, "fid", "left").select("fid", F.coalesce("area", F.lit(0.0)).alias("area"))


def centroids(faces: DataFrame, vertices: DataFrame, values: Sequence[str] = XYZ) -> DataFrame:
    return corners(faces).join(vertices, "vid").groupBy("fid").agg(*(F.avg(a).alias(a) for a in values))


def faces_inside(faces: DataFrame, vertices: DataFrame, keep: Callable[[list[Column]], Column]) -> DataFrame:
    """Faces whose mean corner passes ``keep``, a box or half-spaces; faces without corners don't."""
    mid = centroids(faces, vertices)
    return faces.join(mid.filter(keep([F.col(a) for a in XYZ])).select("fid"), "fid", "left_semi")


def value_range(vertices: DataFrame, value: str = "value") -> DataFrame:
    """One row (low, high); null without vertices."""
    return vertices.agg(F.min(value).alias("low"), F.max(value).alias("high"))


def used_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that faces use, renumbered densely in order, and the faces with the new numbers."""
    kept = row_numbers(vertices.join(corners(faces).select("vid").distinct(), "vid", "left_semi"), ["vid"], "new")
    c = corners(faces).join(kept.select("vid", "new"), "vid")
    ids = c.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("ids"))
    extra = [x for x in faces.columns if x not in ("fid", "ids")]
    return kept.drop("vid").withColumnRenamed("new", "vid").select(vertices.columns), ids.join(faces.select("fid", *extra), "fid") if extra else ids


def components(faces: DataFrame) -> DataFrame:
    """Rows (fid, comp): faces joined by shared edges; comp is the least fid. Contraction in rounds, each written."""
    e = half_edges(faces).select("fid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hub = e.groupBy("a", "b").agg(F.min("fid").alias("hub"))
    links = written(e.join(hub, ["a", "b"]).filter("fid <> hub").select(F.col("fid").alias("p"), F.col("hub").alias("q")).distinct())
    comp = faces.select("fid", F.col("fid").alias("comp"))
    while not links.isEmpty():
        both = links.union(links.select("q", "p"))
        step = both.groupBy("p").agg(F.min("q").alias("q")).select("p", F.least("p", "q").alias("to"))
        for _ in range(2):  # follow the map twice, so chains shrink faster
            step = written(step)
            step = step.join(step.select(F.col("p").alias("to"), F.col("to").alias("far")), "to").select("p", F.col("far").alias("to"))
        step = written(step)
        comp = written(comp.join(step.withColumnRenamed("p", "comp"), "comp", "left").select("fid", F.coalesce("to", "comp").alias("comp")))
        a, b = step.select("p", F.col("to").alias("tp")), step.select(F.col("p").alias("q"), F.col("to").alias("tq"))
        links = written(links.join(a, "p").join(b, "q").filter("tp <> tq").select(F.least("tp", "tq").alias("p"), F.greatest("tp", "tq").alias("q")).distinct())
    least = comp.groupBy("comp").agg(F.min("fid").alias("least"))
    return comp.join(least, "comp").select("fid", F.col("least").alias("comp"))


def component_areas(comp: DataFrame, areas: DataFrame) -> DataFrame:
    return comp.join(areas, "fid").groupBy("comp").agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("n"))


def boundary_half_edges(faces: DataFrame, comp: DataFrame) -> DataFrame:
    """Half-edges (comp, a, b) without their opposite in the same component."""
    h = half_edges(faces.join(comp, "fid"), "comp").select("comp", "a", "b")
    return h.join(h.select("comp", F.col("b").alias("a"), F.col("a").alias("b")), ["comp", "a", "b"], "left_anti")


def component_links(boundary: DataFrame) -> DataFrame:
    """Pairs of components with opposite boundary half-edges."""
    o = boundary.select(F.col("comp").alias("other"), F.col("b").alias("a"), F.col("a").alias("b"))
    return boundary.join(o, ["a", "b"]).filter("comp < other").select("comp", "other").distinct()


def merge_small(areas: dict[int, float], links: list[tuple[int, int]], ratio: float) -> dict[int, int]:
    """New component of each: while the smallest component with neighbours is under ``ratio`` of the whole, it and all
    its neighbours become one. On the driver, over one row for each component."""
    near: dict[int, set[int]] = {c: set() for c in areas}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    size, into, whole = dict(areas), {c: c for c in areas}, sum(areas.values())
    while True:
        free = [c for c in size if near[c]]
        small = min(free, key=lambda c: (size[c], c), default=None)
        if small is None or size[small] >= whole * ratio:
            break
        group = sorted(near[small])
        head = group[0]
        for c in [small, *group[1:]]:
            size[head] += size.pop(c)
            near[head] |= near.pop(c)
            for o in near.values():
                if c in o:
                    o.discard(c)
                    o.add(head)
            into = {k: head if v == c else v for k, v in into.items()}
        near[head] -= {small, head, *group}
    return into


def split_polygon(ids: list[int], values: list[float], trim: float) -> list[tuple[bool, list[tuple[int, int]]]]:
    """Parts of a polygon over and not over ``trim``; a corner is (a, a), a cut of an edge (a, b), a < b."""
    over = [v > trim for v in values]
    n = len(ids)
    if all(over) or not any(over):
        return [(all(over), [(i, i) for i in ids])]
    cut = lambda s: (min(ids[s - 1], ids[s]), max(ids[s - 1], ids[s]))
    turns = [s for s in range(n) if over[s] != over[s - 1]]
    parts = []
    for t, s in enumerate(turns):
        end = turns[(t + 1) % len(turns)]
        run = [(ids[(s + x) % n],) * 2 for x in range((end - s) % n or n)]
        parts.append((over[s], [cut(s), *run, cut(end)]))
    return parts


def trim(vertices: DataFrame, faces: DataFrame, level: float, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Faces split at ``value`` = ``level``: vertices with the cuts added (ids after the old), faces (fid, ids, over, split).

    A vertex is over the level if strictly greater. Cuts are interpolated in all columns, where both
    ends are equal in the middle.
    """
    c = corners(faces).join(vertices.select("vid", F.col(value).alias("v")), "vid")
    whole = c.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pos", "vid", "v"))).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for fid, cs in zip(t["fid"], t["c"], strict=True):
                parts = split_polygon([x["vid"] for x in cs], [x["v"] for x in cs], level)
                rows += [(fid, n, over, len(parts) > 1, [{"a": a, "b": b} for a, b in p]) for n, (over, p) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["fid", "part", "over", "split", "refs"])

    parts = written(whole.mapInPandas(run, "fid long, part int, over boolean, split boolean, refs array<struct<a:long,b:long>>"))
    cuts = parts.select(F.explode("refs").alias("r")).select("r.*").filter("a <> b").distinct()
    last = vertices.agg(F.max("vid")).first()[0]
    cuts = written(row_numbers(cuts, ["a", "b"], "vid", start=0 if last is None else last + 1))
    columns = [x for x in vertices.columns if x != "vid"]
    p, r = (vertices.select(F.col("vid").alias(k), *(F.col(x).alias(f"{k}_{x}") for x in columns)) for k in "ab")
    t = F.when(F.col(f"a_{value}") == F.col(f"b_{value}"), 0.5).otherwise((F.col(f"a_{value}") - level) / (F.col(f"a_{value}") - F.col(f"b_{value}")))
    new = cuts.join(p, "a").join(r, "b").withColumn("t", t).select("vid", *((F.col(f"a_{x}") * (1 - F.col("t")) + F.col(f"b_{x}") * F.col("t")).alias(x) for x in columns))
    refs = parts.select("fid", "part", "over", "split", F.posexplode("refs").alias("pos", "r")).select("fid", "part", "over", "split", "pos", "r.*").join(cuts, ["a", "b"], "left")
    ids = refs.groupBy("fid", "part", "over", "split").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("vid", "a").alias("v")))), lambda x: x["v"]).alias("ids"))
    out = row_numbers(ids, ["fid", "part"], "new").select(F.col("new").alias("fid"), "ids", "over", "split")
    return vertices.union(new.select(vertices.columns)), out


def best_triangles(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a polygon. Of four corners the diagonal 0-2, unless 2, 3, 0 is larger than 3, 1, 2;
    of more, those of least total area."""
    n = len(p)

    def square(i: int, j: int, k: int) -> float:
        u, v = p[j] - p[i], p[k] - p[i]
        return float(np.dot(u, u) * np.dot(v, v) - np.dot(u, v) ** 2)

    if n < 3:
        return []
    if n == 3:
        return [(0, 1, 2)]
    if n == 4:
        return [(0, 1, 3), (3, 1, 2)] if square(2, 3, 0) > square(3, 1, 2) else [(0, 1, 2), (2, 3, 0)]
    cost, mid = np.zeros((n, n)), np.zeros((n, n), dtype=int)
    for width in range(2, n):
        for i in range(n - width):
            k = i + width
            options = [cost[i, j] + cost[j, k] + np.sqrt(max(square(i, j, k), 0.0)) / 2 for j in range(i + 1, k)]
            mid[i, k] = i + 1 + int(np.argmin(options))
            cost[i, k] = min(options)
    out, todo = [], [(0, n - 1)]
    while todo:
        i, k = todo.pop()
        if k - i > 1:
            j = int(mid[i, k])
            out.append((i, j, k))
            todo += [(i, j), (j, k)]
    return out


def triangulate(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces (fid, ids) of three corners each."""
    c = corners(faces).join(vertices.select("vid", *XYZ), "vid").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pos", "vid", *XYZ))).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for fid, cs in zip(t["fid"], t["c"], strict=True):
                found = best_triangles(np.array([[x[a] for a in XYZ] for x in cs], dtype=float))
                rows += [(fid, n, [int(cs[i]["vid"]) for i in tri]) for n, tri in enumerate(found)]
            yield pd.DataFrame(rows, columns=["face", "part", "ids"])

    return row_numbers(written(c.mapInPandas(run, "face long, part int, ids array<long>")), ["face", "part"], "fid").select("fid", "ids")


def flip(faces: DataFrame) -> DataFrame:
    return faces.withColumn("ids", F.reverse("ids"))


def concatenate(parts: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Meshes one after the other, ids moved past those before."""
    after = lambda t, c: 0 if (most := t.agg(F.max(c)).first()[0]) is None else most + 1
    vertices, faces, at, f_at = [], [], 0, 0
    for v, f in parts:
        vertices.append(v.withColumn("vid", F.col("vid") + at))
        faces.append(f.withColumn("ids", F.expr(f"transform(ids, x -> x + {at}L)")).withColumn("fid", F.col("fid") + f_at))
        at += after(v, "vid")
        f_at += after(f, "fid")
    v, f = vertices[0], faces[0]
    for x, y in zip(vertices[1:], faces[1:], strict=True):
        v, f = v.unionByName(x), f.unionByName(y)
    return v, f


def merge_shared(vertices: DataFrame, faces: DataFrame, shared: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Parts (columns part, vid from 0) joined in order: the last ``shared[i]`` vertices of part i are the first of part i + 1
    and are averaged; faces' ids become those of the whole."""
    n = {r["part"]: r["n"] for r in vertices.groupBy("part").agg((F.max("vid") + 1).alias("n")).collect()}
    base, at = {}, 0
    for p in sorted(n):
        base[p] = at
        at += n[p] - (shared[p] if p < len(shared) else 0)
    start = F.create_map(*(F.lit(x) for kv in base.items() for x in kv))
    moved = vertices.withColumn("vid", F.col("vid") + start[F.col("part")])
    columns = [c for c in vertices.columns if c not in ("part", "vid")]
    v = moved.groupBy("vid").agg(*(F.avg(c).alias(c) for c in columns))
    return v, faces.withColumn("ids", F.transform("ids", lambda x: x + start[F.col("part")]))


def chunks(points: DataFrame, width: float, radius: float = 0.0, axes: Sequence[str] = XYZ) -> DataFrame:
    """Each row for every cube of ``width`` that its box of ``radius`` cubes about it meets: cx, cy, cz."""
    out = points
    for a in axes:
        low = F.floor((F.col(a) - radius * width) / width).cast("int")
        high = F.ceil((F.col(a) + radius * width) / width).cast("int")
        out = out.withColumn(f"c{a}", F.explode(F.sequence(low, F.greatest(high - 1, low))))
    return out
