"""Whole applications: surface reconstruction, scattered-data fits, distances, stitching, trimming."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import finite_normal, in_unit_cube, norm, vector
from ..operators import density as den
from ..operators import fem, levelset, mesh
from ..operators.cells import AXES, mean, with_cell
from ..operators.points import Alignment, hash_sample, row_numbers, unit_cube
from ..storage import written

UNIT = ("u", "v", "w")


@dataclass
class Implicit:
    """A solved field with the alignment of its unit cube; a directory of Parquet tables when saved."""

    field: DataFrame
    base: int
    depth: int
    alignment: Alignment
    level: float = 0.0
    dim: int = 3
    density: DataFrame | None = None
    aux: DataFrame | None = None
    aux_names: tuple[str, ...] = ()

    def evaluate(self, points: DataFrame, key: str, gradient: bool = False) -> DataFrame:
        """Rows (key, value[, gradient]) in the data's own coordinates; null outside the domain."""
        names = "xyz"[: self.dim]
        unit = self.alignment.apply([F.col(c) for c in names])
        out = fem.evaluate(points.select(key, *(c.alias(u) for c, u in zip(unit, UNIT, strict=False))), self.field, key, self.base, self.depth, self.dim, gradient)
        for n, a in enumerate(fem.axes_of(self.dim) if gradient else ()):
            out = out.withColumn(f"g{a}", F.col(f"g{a}") / F.lit(self.alignment.scale[n])).withColumnRenamed(f"g{a}", f"g{names[n]}")
        return out

    def aux_at(self, points: DataFrame, key: str) -> DataFrame:
        unit = self.alignment.apply([F.col(c) for c in "xyz"])
        at = points.select(key, *(c.alias(u) for c, u in zip(unit, UNIT, strict=True))).filter(in_unit_cube(vector(*UNIT)))
        return den.read_extrapolation(at, self.aux, key, list(self.aux_names), self.depth)

    def save(self, spark: SparkSession, path: str) -> None:
        for name in ("field", "density", "aux"):
            if (t := getattr(self, name)) is not None:
                t.write.mode("overwrite").parquet(f"{path}/{name}")
        head = [(self.base, self.depth, self.dim, self.level, list(self.alignment.origin), list(self.alignment.scale), list(self.aux_names), self.density is not None)]
        spark.createDataFrame(head, "base int, depth int, dim int, level double, origin array<double>, scale array<double>, aux array<string>, dense boolean").write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Implicit:
        h = spark.read.parquet(f"{path}/head").first()
        read = lambda name, there: spark.read.parquet(f"{path}/{name}") if there else None
        return Implicit(read("field", True), h["base"], h["depth"], Alignment(tuple(h["origin"]), tuple(h["scale"])), h["level"], h["dim"], read("density", h["dense"]), read("aux", h["aux"]), tuple(h["aux"]))

    def surface(self, out_depth: int | None = None, triangles: bool = True) -> tuple[DataFrame, DataFrame]:
        """Vertices (vid, x, y, z, nx, ny, nz) and faces of the level set, in the data's coordinates."""
        d = out_depth or self.depth
        spark = self.field.sparkSession
        grid = written(fem.grid_values(spark, self.field, self.base, self.depth, d))
        v, f = levelset.surface(grid, self.level, 1.0 / (1 << d))
        back = self.alignment.invert([F.col(c) for c in "xyz"])
        v = v.select("vid", *(c.alias(n) for c, n in zip(back, "xyz", strict=True)))
        g = self.evaluate(v, "vid", gradient=True)
        v = written(v.join(g.select("vid", "gx", "gy", "gz"), "vid"))
        return v, mesh.triangulate(v, f) if triangles else f

    def grid(self, out_depth: int, dual: bool = False) -> DataFrame:
        return fem.grid_values(self.field.sparkSession, self.field, self.base, self.depth, out_depth, self.dim, dual)


def poisson(points: DataFrame, depth: int = 8, base: int = 5, scale: float = 1.1, samples_per_node: float = 1.5, point_weight: float = 2.0, confidence: float = 0.0, aux: tuple[str, ...] = (), per_level: float = 32.0, smooth: bool = False, alignment: Alignment | None = None, cut_off: float = 0.0, gradient_weight: float = 1.0) -> Implicit:
    """A field whose gradient follows the points' normals, level at the points.

    points: x, y, z, nx, ny, nz and the ``aux`` columns; rows without a usable normal, or outside the
    unit cube, are left out, and samples whose estimated depth is under ``cut_off``. Samples are
    summed per finest cell first; each normal is splatted at the depth that the density about it
    suggests, from 2 to ``depth``. ``smooth``: no vector field; values 0 and gradients against the normals
    are fitted at samples, under a curvature and a weak gradient term.
    """
    spark = points.sparkSession
    base = min(base, depth)
    al = alignment or unit_cube(points, factor=scale)
    n = vector("nx", "ny", "nz")
    rows = points.filter(finite_normal(n))
    rows = rows.select(*(c.alias(u) for c, u in zip(al.apply(vector("x", "y", "z")), UNIT, strict=True)), "nx", "ny", "nz", *aux).filter(in_unit_cube(vector(*UNIT)))
    size = norm(n)
    weight = F.pow(size, F.lit(confidence)) if confidence else F.lit(1.0)
    rows = rows.withColumns({"_w": weight, "_l": size})
    unit_n = {c: F.col(c) / F.col("_l") for c in ("nx", "ny", "nz")}
    s = written(den.samples(rows, depth, F.col("_w"), unit_n | {a: F.col(a) for a in aux}))
    kernel = max(1, depth - 2)
    dens = written(den.density(s, kernel))
    at = s.withColumn("key", F.struct(*AXES))
    dw = den.depth_and_weight(den.samples_per_node(at.select("key", *UNIT), dens, "key", kernel), "key", samples_per_node, kernel)
    dw = written(den.deep_enough(dw, cut_off) if cut_off > 0 else dw)
    share = F.col("weight") * F.col("share")
    at = written(at.join(dw.select("key", F.col("weight").alias("share")), "key").withColumn("share", share))
    total = at.agg(F.sum("share")).first()[0] or 1.0
    unit_weight = F.col("share") / total
    if smooth:
        slopes = {f"g{a}": -F.col(c) / F.col("weight") for a, c in zip(AXES, ("nx", "ny", "nz"), strict=True)}
        given = at.select(*UNIT, (unit_weight * 8 * point_weight).alias("weight"), F.lit(0.0).alias("target"), (unit_weight * gradient_weight).alias("gweight"), *(c.alias(n) for n, c in slopes.items()))
        samples = written(given)
        field = fem.solve(spark, base, depth, 3, 0.0, 1e-2, None, samples, curvature=1e-4)  # weaker terms leave sheets far from samples
    else:
        samples = written(at.select(*UNIT, (unit_weight * 8 * point_weight).alias("weight"), F.lit(0.5).alias("target")))
        # the area that each sample stands for, times its normal: the surface's gradient field
        vectors = written(den.vector_field(at.select("key", *UNIT, *((-F.col(c)).alias(c) for c in ("nx", "ny", "nz"))), dw, "key", ("nx", "ny", "nz"), min(2, base), depth))
        field = fem.solve(spark, base, depth, 3, 0.0, 1.0, None, samples, fields=vectors, names=("vx", "vy", "vz"))
    out = Implicit(field, base, depth, al, density=dens, aux_names=aux)
    keyed = samples.withColumn("key", F.struct(*UNIT))
    out.level = fem.average_at(keyed, field, base, depth)
    if aux:
        out.aux = written(den.extrapolation(s, list(aux), per_level))
    return out


def fit(points: DataFrame, dim: int = 2, depth: int = 6, base: int = 6, value_weight: float = 1000.0, lap: float = 0.0, curvature: float = 1.0, scale: float = 1.1, gradient_weight: float = 0.0) -> Implicit:
    """A smooth field through scattered values: columns x, y[, z], value; with a ``gradient_weight`` also gx, gy[, gz], the slopes wanted there."""
    names = "xyz"[:dim]
    base = min(depth, base)
    al = unit_cube(points, names, scale)
    n = points.count() or 1
    slopes = [F.lit(gradient_weight / n).alias("gweight"), *((F.col(f"g{c}") * F.lit(size)).alias(f"g{a}") for c, a, size in zip(names, AXES, al.scale, strict=False))] if gradient_weight > 0 else []
    s = points.select(*(c.alias(u) for c, u in zip(al.apply([F.col(a) for a in names]), UNIT, strict=False)), F.lit(value_weight / n).alias("weight"), F.col("value").alias("target"), *slopes)
    field = fem.solve(points.sparkSession, base, depth, dim, 0.0, lap, None, written(s), curvature=curvature * 1e-5)
    return Implicit(field, base, depth, al, dim=dim)


def area_samples(vertices: DataFrame, faces: DataFrame, step: float) -> DataFrame:
    """Points spread over triangles, each with its share of the area: clipping by splitting until no side is over ``step``."""
    tri = faces.select("fid", *(F.col("ids")[n].alias(f"v{n}") for n in range(3)))
    for n in range(3):
        tri = tri.join(vertices.select(F.col("vid").alias(f"v{n}"), *(F.col(a).alias(f"{a}{n}") for a in "xyz")), f"v{n}")
    p = [[F.col(f"{a}{n}") for a in "xyz"] for n in range(3)]
    side = F.greatest(*(norm([x - y for x, y in zip(p[a], p[b], strict=True)]) for a, b in ((0, 1), (1, 2), (2, 0))))
    k = F.greatest(F.ceil(side / step).cast("int"), F.lit(1))
    from ..functions.geometry import triangle_area

    tri = tri.withColumns({"k": k, "area": triangle_area(*p)}).filter("area > 0")
    tri = tri.withColumn("a", F.explode(F.expr("sequence(0, k - 1)"))).withColumn("b", F.explode(F.expr("sequence(0, k - 1 - a)")))
    # k^2 small triangles: upright ones, and upside-down ones but in the last of each row
    tri = tri.withColumn("up", F.explode(F.when(F.col("a") + F.col("b") < F.col("k") - 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    s, t = (F.col("a") + F.col("up") / 3) / F.col("k"), (F.col("b") + F.col("up") / 3) / F.col("k")
    place = [F.col(f"{a}0") * (1 - s - t) + F.col(f"{a}1") * s + F.col(f"{a}2") * t for a in "xyz"]
    return tri.select("fid", *(c.alias(a) for c, a in zip(place, "xyz", strict=True)), (F.col("area") / F.col("k") / F.col("k")).alias("weight"))


def distance_transform(vertices: DataFrame, faces: DataFrame, depth: int = 5, scale: float = 2.0, diffusion: float = 5e-4) -> Implicit:
    """Distance to a triangle mesh: diffuse its area, follow the unit gradient away from it, solve, and shift so its mean over the mesh is 0.

    Heat that spreads less than a cell's width makes hats swing, so a square cell is the least ``diffusion``.
    """
    spark = vertices.sparkSession
    diffusion = max(diffusion, 0.25 ** depth)
    al = unit_cube(vertices, factor=scale)
    step = min(al.scale) / (1 << depth)
    s = area_samples(vertices, faces, step)
    s = written(s.select(*(c.alias(u) for c, u in zip(al.apply(vector("x", "y", "z")), UNIT, strict=True)), "weight"))
    from ..operators.cells import splat

    load = splat(with_cell(s, depth), {"load": F.col("weight")}, 1).select(*AXES, F.col("load").alias("v"))
    base = min(depth, 5)
    heat = fem.solve(spark, base, depth, 3, 1.0, diffusion, load)
    n = 1 << depth
    cells = spark.range(n**3).select("id", *(F.floor(F.col("id") / n**k % n).cast("int").alias(a) for k, a in enumerate(AXES)))
    at = cells.withColumns({u: (F.col(a) + 0.5) / n for u, a in zip(UNIT, AXES, strict=True)})
    g = fem.evaluate(at.select("id", *UNIT), heat, "id", base, depth, 3, gradient=True)
    size = norm(vector("gi", "gj", "gk"))
    v = cells.join(g, "id").select(*AXES, *(F.when(size > 0, -F.col(f"g{a}") / size).otherwise(0.0).alias(f"v{a}") for a in AXES))
    field = fem.solve(spark, base, depth, 3, 0.0, 1.0, fem.divergence(v, depth, ("vi", "vj", "vk"), AXES))
    level = fem.average_at(s.withColumn("key", F.struct(*UNIT)), field, base, depth)
    field = field.withColumn("v", F.when(F.col("d") == base, F.col("v") - level).otherwise(F.col("v")))
    return Implicit(written(field.withColumn("v", F.col("v") * F.lit(al.scale[0]))), base, depth, al)


def label_seams(pixels: DataFrame) -> DataFrame:
    """Rows (row, col, dir, change) where the right or lower neighbour bears another label, both labelled."""
    out = None
    for n, (dr, dc) in enumerate(((0, 1), (1, 0))):
        other = pixels.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("label").alias("l2"), F.col("val").alias("v2"))
        e = pixels.join(other, ["row", "col"]).filter("label <> l2 AND label >= 0 AND l2 >= 0").select("row", "col", F.lit(n).alias("dir"), (F.col("v2") - F.col("val")).alias("change"))
        out = e if out is None else out.union(e)
    return out


def stitch(pixels: DataFrame, iterations: int = 10_000) -> DataFrame:
    """Pixels (row, col, label, val) with an offset field added that takes the steps at seams out and keeps all other differences.

    The offset solves a Poisson problem on the pixel grid whose differences are minus the seams'
    steps and 0 elsewhere, with mean 0; conjugate gradients over a pixel table.
    """
    from ..operators import linear

    p = row_numbers(pixels, ["row", "col"], "r")
    ids = p.select("row", "col", "r")
    pairs = None
    for n, (dr, dc) in enumerate(((0, 1), (1, 0))):
        other = ids.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("r").alias("c"))
        e = ids.join(other, ["row", "col"]).withColumn("dir", F.lit(n))
        pairs = e if pairs is None else pairs.union(e)
    pairs = written(pairs)
    m = pairs.select("r", "c", F.lit(-1.0).alias("v"))
    m = m.union(linear.transpose(m))
    m = written(m.union(m.groupBy("r").agg((-F.sum("v")).alias("v")).select("r", F.col("r").alias("c"), "v")))
    steps = pairs.join(label_seams(pixels), ["row", "col", "dir"])
    b = steps.select("r", F.col("change").alias("v")).union(steps.select(F.col("c").alias("r"), (-F.col("change")).alias("v"))).groupBy("r").agg(F.sum("v").alias("v"))
    zero = ids.select("r", F.lit(0.0).alias("v"))
    x = linear.conjugate_gradients(m, written(linear.add(b, zero)), iterations=iterations, tolerance=1e-7, null_space=True)
    average = x.agg(F.avg("v")).first()[0] or 0.0
    return p.join(x.withColumnRenamed("v", "offset"), "r", "left").select("row", "col", "label", (F.col("val") + F.coalesce(F.col("offset") - average, F.lit(0.0))).alias("val"))


def inside_mesh(points: DataFrame, vertices: DataFrame, faces: DataFrame, key: str, bins: int = 64) -> DataFrame:
    """Rows (key, inside) by counting crossings of a ray along z, by the sign of the nearest.

    Triangles meet points through the cells of a grid over x and y that their boxes cover, an
    equi-join; the nearest hit above decides.
    """
    box = vertices.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cell = {a: lambda c, a=a: F.floor((c - box[f"lo{a}"]) / ((box[f"hi{a}"] - box[f"lo{a}"]) or 1.0) * bins).cast("int") for a in "xy"}
    tri = faces.select("fid", *(F.col("ids")[n].alias(f"v{n}") for n in range(3)))
    for n in range(3):
        tri = tri.join(vertices.select(F.col("vid").alias(f"v{n}"), *(F.col(a).alias(f"{a}{n}") for a in "xyz")), f"v{n}")
    for a in "xy":
        low, high = F.least(*(F.col(f"{a}{n}") for n in range(3))), F.greatest(*(F.col(f"{a}{n}") for n in range(3)))
        tri = tri.withColumn(f"b{a}", F.explode(F.sequence(cell[a](low), cell[a](high))))
    p = points.select(key, "x", "y", "z", *(cell[a](F.col(a)).alias(f"b{a}") for a in "xy"))
    j = p.join(tri, ["bx", "by"])
    e = lambda a, b: (F.col(f"x{b}") - F.col(f"x{a}")) * (F.col("y") - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (F.col("x") - F.col(f"x{a}"))
    w0, w1, w2 = e(1, 2), e(2, 0), e(0, 1)
    total = w0 + w1 + w2
    z = (w0 * F.col("z0") + w1 * F.col("z1") + w2 * F.col("z2")) / total
    hit = (total != 0) & (((w0 >= 0) & (w1 >= 0) & (w2 >= 0)) | ((w0 <= 0) & (w1 <= 0) & (w2 <= 0)))
    near = j.filter(hit).withColumns({"t": z - F.col("z"), "up": total > 0}).filter("t >= 0")
    near = near.groupBy(key).agg(F.min_by("up", "t").alias("inside"))
    return points.select(key).join(near, key, "left").select(key, F.coalesce("inside", F.lit(False)).alias("inside"))


def sphere(spark: SparkSession, n: int, color: bool = False) -> DataFrame:
    """Oriented points of the unit sphere; ``color``: three bands along x."""
    from ..functions.geometry import sphere_point

    p = spark.range(n).select(F.col("id").alias("pid"), *(c.alias(a) for c, a in zip(sphere_point(F.col("id")), "xyz", strict=True)))
    p = p.withColumns({f"n{a}": F.col(a) for a in "xyz"})
    if color:
        band = F.when(F.col("x") < -1 / 3, 0).when(F.col("x") < 1 / 3, 1).otherwise(2)
        p = p.withColumns({c: F.when(band == k, 255.0).otherwise(0.0) for k, c in enumerate(("red", "green", "blue"))})
    return p


def trim_surface(vertices: DataFrame, faces: DataFrame, level: float, value: str = "value", area_ratio: float = 0.001, remove_islands: bool = False) -> tuple[DataFrame, DataFrame]:
    """The part of a mesh over ``level``, small parts given to their neighbours, islands kept unless asked otherwise."""
    v, f = mesh.trim(vertices, faces, level, value)
    f, v = written(f), written(v)
    comp = written(mesh.components(f.filter("over")).withColumn("over", F.lit(True)).union(mesh.components(f.filter("NOT over")).withColumn("over", F.lit(False))))
    areas = written(mesh.component_areas(comp.select("fid", "comp"), mesh.polygon_areas(f, v)).join(comp.select("comp", "over").distinct(), "comp"))
    links = mesh.component_links(mesh.boundary_half_edges(f.select("fid", "ids"), comp.select("fid", "comp"))).collect()  # pairs of components
    rows = areas.collect()
    size = {r["comp"]: r["area"] for r in rows}
    over = {r["comp"]: r["over"] for r in rows}
    into = mesh.merge_small(size, [(r[0], r[1]) for r in links], area_ratio)
    linked = {c for r in links for c in r}
    islands = {c for c in size if c not in linked and size[c] < area_ratio * sum(size.values())} if remove_islands else set()
    keep = [c for c in size if over[into[c]] and c not in islands]
    kept = f.join(comp.select("fid", "comp").join(v.sparkSession.createDataFrame([(c,) for c in keep], "comp long"), "comp", "left_semi"), "fid", "left_semi")
    return mesh.used_vertices(v, kept.select("fid", "ids"))


def output_points(points: DataFrame, alignment: Alignment, gradient: bool = True, density: str | None = None, aux: tuple[str, ...] = (), grid_depth: int | None = None) -> DataFrame:
    """Points of a level set (vid, u, v, w, gradient gu, gv, gw) as they are put out: x, y, z, and what is asked for.

    ``gradient``: nx, ny, nz in the data's own space; ``density``: that column as value; ``aux``: columns that pass;
    ``grid_depth``: coordinates in cells of that depth in place of the data's own.
    """
    scale = [float(1 << grid_depth)] * 3 if grid_depth is not None else list(alignment.scale)
    origin = [0.0] * 3 if grid_depth is not None else list(alignment.origin)
    out = [(F.col(u) * s + o).alias(a) for u, s, o, a in zip(UNIT, scale, origin, "xyz", strict=True)]
    if gradient:
        out += [(F.col(f"g{u}") / s).alias(f"n{a}") for u, s, a in zip(UNIT, scale, "xyz", strict=True)]
    return points.select("vid", *out, *([F.col(density).alias("value")] if density else []), *aux)


def scale_normals(points: DataFrame, columns: tuple[str, ...], exponents: tuple[float, ...]) -> DataFrame:
    from ..functions.geometry import confidence

    s = confidence([F.col(c) for c in columns], exponents)
    return points.withColumns({n: F.col(n) * s for n in ("nx", "ny", "nz")})


def transform_points(points: DataFrame, m: np.ndarray) -> DataFrame:
    """Positions and normals by a homogeneous matrix; all other columns pass."""
    from ..functions.geometry import apply_affine, apply_normal

    out = dict(zip("xyz", apply_affine(vector("x", "y", "z"), m), strict=True))
    if "nx" in points.columns:
        out |= dict(zip(("nx", "ny", "nz"), apply_normal(vector("nx", "ny", "nz"), m), strict=True))
    return points.withColumns(out)


__all__ = ["Implicit", "area_samples", "distance_transform", "fit", "hash_sample", "inside_mesh", "label_seams", "mean", "poisson", "scale_normals", "sphere", "stitch", "transform_points", "trim_surface"]
