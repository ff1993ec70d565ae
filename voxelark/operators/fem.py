"""Fields on a hierarchy of corner grids: assembly, solution and evaluation.

A field is a table (d, axes, v): values of hats at the corners of the base level's grid and
corrections at finer levels, present only near samples; its value at a point is the sum over
levels. The base level is solved on the driver as a dense array of bounded size; finer levels
are solved as tables, from coarse to fine, against what the levels before leave over.

The field u minimises  lap |grad u|^2 + mass u^2 - 2 V . grad u - 2 f u + sum w (u(p) - t)^2 + sum g |grad u(p) - s|^2.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splines import hat_mass, hat_stiffness
from ..storage import written
from .cells import deepest_cell, leaves, mean, neighbours, offsets, spline_weights, with_cell

UNIT = ("u", "v", "w")
AXES = ("i", "j", "k")


def axes_of(dim: int) -> tuple[str, ...]:
    return AXES[:dim]


def apply_system(x: DataFrame, d: int, mass: float, lap: float, axes: Sequence[str], value: str = "v") -> DataFrame:
    """The system's product with a vector (axes, v) of corners at depth ``d``: constant stencils, halved at the border."""
    n, h = 1 << d, 1.0 / (1 << d)
    y = x.select(*axes, value, F.explode(offsets(-1, 1, axes)).alias("o"))
    m, k = [], []
    for a in axes:
        edge = (F.col(a) == 0) | (F.col(a) == n)
        o = F.col(f"o.{a}")
        m.append(F.when(o == 0, hat_mass(0, edge, h)).otherwise(hat_mass(1, False, h)))
        k.append(F.when(o == 0, hat_stiffness(0, edge, h)).otherwise(hat_stiffness(1, False, h)))
    weight = F.lit(mass) * reduce(mul, m)
    for e in range(len(axes)):
        weight = weight + F.lit(lap) * reduce(mul, [k[e] if e == f else m[f] for f in range(len(axes))])
    y = y.select(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes), (weight * F.col(value)).alias("v"))
    y = y.filter(reduce(lambda p, q: p & q, (F.col(a).between(0, n) for a in axes)))
    return y.groupBy(*axes).agg(F.sum("v").alias("v"))


def divergence(cells: DataFrame, d: int, vector: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Right side of a field constant in each cell: its inner product with the gradients of the cell's corners."""
    dim, h = len(axes), 1.0 / (1 << d)
    y = cells.select(*axes, *vector, F.explode(offsets(0, 1, axes)).alias("o"))
    share = h ** (dim - 1) / 2 ** (dim - 1)
    v = reduce(lambda p, q: p + q, (F.col(c) * (F.col(f"o.{a}") * 2 - 1) for c, a in zip(vector, axes, strict=True))) * share
    y = y.select(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes), v.alias("v"))
    return y.groupBy(*axes).agg(F.sum("v").alias("v"))


def restrict(b: DataFrame, axes: Sequence[str]) -> DataFrame:
    """A right side on the next coarser corners: the transpose of linear interpolation."""
    y = b
    for a in axes:
        odd = F.col(a) % 2 == 1
        half = F.shiftright(a, 1)
        to = F.when(odd, F.array(F.struct(half.alias("c"), F.lit(0.5).alias("s")), F.struct((half + 1).alias("c"), F.lit(0.5).alias("s")))).otherwise(F.array(F.struct(half.alias("c"), F.lit(1.0).alias("s"))))
        y = y.withColumn("_t", F.explode(to)).withColumn(a, F.col("_t.c")).withColumn("v", F.col("v") * F.col("_t.s")).drop("_t")
    return y.groupBy(*axes).agg(F.sum("v").alias("v"))


def point_terms(samples: DataFrame, d: int, axes: Sequence[str]) -> DataFrame:
    """Samples summed per cell at depth ``d``: weight, mean place and mean target; with a column gweight also that and the mean slopes g<axis>."""
    unit, slopes = UNIT[: len(axes)], [f"g{a}" for a in axes] if "gweight" in samples.columns else []
    rows = with_cell(samples, d, unit, axes).withColumn("_w", F.col("weight") + F.col("gweight") if slopes else F.col("weight"))
    by = dict.fromkeys(unit, "_w") | {"target": "weight"} | dict.fromkeys(slopes, "gweight")
    weights = ["weight", "_w", *(["gweight"] if slopes else [])]
    cells = rows.groupBy("d", *axes).agg(*(F.sum(w).alias(w) for w in weights), *(F.sum(F.col(w) * F.col(c)).alias(c) for c, w in by.items()))
    means = {c: F.col(c) / F.col(w) if w == "_w" else F.coalesce(F.try_divide(c, w), F.lit(0.0)) for c, w in by.items()}
    return cells.filter("_w > 0").withColumns(means).drop("_w")


def _hats_and_slopes(terms: DataFrame, d: int, axes: Sequence[str]) -> DataFrame:
    """Rows (key, term, axes, basis, weight, target) of ``point_terms``: what each corner adds to the value (term -1) and the slopes (term 0 up) at a sample."""
    unit = UNIT[: len(axes)]
    rows = terms.withColumn("key", F.struct(*axes)).withColumns({f"_c{a}": F.col(a) for a in axes})
    rows = spline_weights(rows, 1, unit, axes)
    parts = [F.struct(F.lit(-1).alias("term"), F.col("basis").alias("basis"), F.col("weight").alias("weight"), F.col("target").alias("target"))]
    if "gweight" in terms.columns:
        size = float(1 << d)
        w = {a: 1 - F.abs(F.col(u) * size - F.col(a)) for a, u in zip(axes, unit, strict=True)}
        for n, a in enumerate(axes):
            slope = reduce(mul, [w[b] for b in axes if b != a], F.when(F.col(a) > F.col(f"_c{a}"), size).otherwise(-size))
            parts.append(F.struct(F.lit(n).alias("term"), slope.alias("basis"), F.col("gweight").alias("weight"), F.col(f"g{a}").alias("target")))
    return rows.select("key", *axes, F.explode(F.array(*parts)).alias("_p")).select("key", *axes, "_p.*")


def coarser_loads(cells: DataFrame, d: int, fields: DataFrame, names: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Right side at depth ``d`` of cell fields (d, axes, names) of all coarser depths, as far as ``cells`` (axes) reach: each cell looks its ancestors up."""
    rows = cells.select(*axes, F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("_d")).withColumns({f"_{a}": F.expr(f"shiftright({a}, {d} - _d)") for a in axes})
    above = fields.filter(F.col("d") < d).select(F.col("d").alias("_d"), *(F.col(a).alias(f"_{a}") for a in axes), *names)
    found = rows.join(above, ["_d", *(f"_{a}" for a in axes)]).groupBy(*axes).agg(*(F.sum(c).alias(c) for c in names))
    return divergence(found, d, names, axes)


def evaluate(points: DataFrame, field: DataFrame, key: str, base: int, depth: int, dim: int = 3, gradient: bool = False) -> DataFrame:
    """Rows (key, value) of points (key, unit coordinates): each level's hats about the point, one equi-join, one sum.

    Points outside the closed unit cube get null. ``gradient``: also the derivatives g<axis>, in unit coordinates.
    """
    axes, unit = axes_of(dim), UNIT[:dim]
    points, name, key = points.select(F.col(key).alias("_key"), *unit), key, "_key"
    inside = reduce(lambda p, q: p & q, (F.col(c).between(0.0, 1.0) for c in unit))
    rows = points.filter(inside).select(key, *unit, F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"))
    rows = with_cell(rows, F.col("d"), unit, axes).withColumns({f"_c{a}": F.col(a) for a in axes})
    rows = spline_weights(rows, 1, unit, axes).join(field.withColumnRenamed("v", "_v"), ["d", *axes])
    out = [F.sum(F.col("basis") * F.col("_v")).alias("value")]
    if gradient:
        size = F.pow(F.lit(2.0), F.col("d"))
        w = {a: 1 - F.abs(F.col(u) * size - F.col(a)) for a, u in zip(axes, unit, strict=True)}
        for a in axes:
            slope = F.when(F.col(a) > F.col(f"_c{a}"), size).otherwise(-size)
            out.append(F.sum(reduce(mul, [w[b] for b in axes if b != a], slope) * F.col("_v")).alias(f"g{a}"))
    return points.select(key).join(rows.groupBy(key).agg(*out), key, "left").withColumnRenamed(key, name)


class Dense:
    """The base level as an array of (2^d + 1)^dim corners."""

    def __init__(self, d: int, dim: int, mass: float, lap: float, curvature: float = 0.0):
        self.d, self.dim, self.n, self.mass, self.lap, self.curvature = d, dim, (1 << d) + 1, mass, lap, curvature
        h = 1.0 / (1 << d)
        eye = np.ones(self.n)
        eye[[0, -1]] = 0.5
        self.m = (eye * 2 * h / 3, h / 6)
        self.k = (eye * 2 / h, -1 / h)
        self.rows: list[tuple] = []

    def _along(self, x: np.ndarray, axis: int, stencil: tuple[np.ndarray, float]) -> np.ndarray:
        x = np.moveaxis(x, axis, -1)
        y = x * stencil[0]
        y[..., 1:] += stencil[1] * x[..., :-1]
        y[..., :-1] += stencil[1] * x[..., 1:]
        return np.moveaxis(y, -1, axis)

    def add_points(self, p: np.ndarray, w: np.ndarray, target: np.ndarray, slope_weight: np.ndarray | None = None, slopes: np.ndarray | None = None) -> np.ndarray:
        """Keep the point terms, of values and if given of slopes along each axis, and return their right side."""
        size = 1 << self.d
        cell = np.maximum(np.ceil(p * size).astype(int) - 1, 0)
        t = p * size - cell
        corners = list(product((0, 1), repeat=self.dim))
        index = np.array([np.ravel_multi_index(tuple((cell + o).T), (self.n,) * self.dim) for o in corners])

        def hats(along: int | None) -> np.ndarray:
            return np.array([reduce(mul, ((size if o[a] else -size) if a == along else t[:, a] if o[a] else 1 - t[:, a] for a in range(self.dim))) for o in corners])

        terms = [(None, w, target)]
        if slopes is not None:
            terms += [(a, slope_weight, slopes[:, a]) for a in range(self.dim)]
        b = np.zeros(self.n**self.dim)
        for along, weight, wanted in terms:
            self.rows.append((index, hats(along), weight))
            np.add.at(b, index, self.rows[-1][1] * weight * wanted)
        return b.reshape((self.n,) * self.dim)

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for e in range(self.dim):
            t = x
            for a in range(self.dim):
                t = self._along(t, a, self.k if a == e else self.m)
            y += t
        return y

    def product(self, x: np.ndarray) -> np.ndarray:
        m = x
        for a in range(self.dim):
            m = self._along(m, a, self.m)
        k = self.laplacian(x)
        y = self.mass * m + self.lap * k
        if self.curvature:
            inner = k * float(1 << self.d) ** self.dim  # lumped mass; the border's Laplacian is free
            for a in range(self.dim):
                np.moveaxis(inner, a, 0)[[0, -1]] = 0
            y = y + self.curvature * self.laplacian(inner)
        for index, weight, w in self.rows:
            values = (weight * x.ravel()[index]).sum(axis=0) * w
            flat = np.zeros(x.size)
            np.add.at(flat, index, weight * values)
            y = y + flat.reshape(x.shape)
        return y

    def solve(self, b: np.ndarray, x: np.ndarray | None = None, tolerance: float = 1e-10, most: int = 3000) -> np.ndarray:
        singular = self.mass == 0 and not self.rows
        b = b - b.mean() if singular else b
        x = np.zeros_like(b) if x is None else x
        r = b - self.product(x)
        p, rr, first = r.copy(), float((r * r).sum()), float((b * b).sum())
        for _ in range(most):
            if rr <= tolerance**2 * max(first, 1e-300):
                break
            q = self.product(p)
            a = rr / float((p * q).sum())
            x, r = x + a * p, r - a * q
            rr, old = float((r * r).sum()), rr
            p = r + rr / old * p
        return x - x.mean() if singular else x


def finer(x: np.ndarray) -> np.ndarray:
    """Linear interpolation of corners onto the next level."""
    for a in range(x.ndim):
        x = np.moveaxis(x, a, 0)
        y = np.empty((2 * len(x) - 1, *x.shape[1:]))
        y[::2], y[1::2] = x, (x[1:] + x[:-1]) / 2
        x = np.moveaxis(y, 0, a)
    return x


def coarser(b: np.ndarray) -> np.ndarray:
    """Its transpose, for right sides."""
    for a in range(b.ndim):
        b = np.moveaxis(b, a, 0)
        y = b[::2].copy()
        y[:-1] += b[1::2] / 2
        y[1:] += b[1::2] / 2
        b = np.moveaxis(y, 0, a)
    return b


def solve(spark, base: int, depth: int, dim: int = 3, mass: float = 0.0, lap: float = 1.0, right: DataFrame | None = None, samples: DataFrame | None = None, iterations: int = 8, curvature: float = 0.0, fields: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """The field (d, axes, v) of a problem. ``curvature``: weight of the squared Laplacian, at the base level.

    ``right``: (axes, v) of corners at ``depth``, from ``divergence`` or a load. ``samples``: (unit, weight,
    target[, gweight, g<axis>]): values and slopes wanted at points. ``fields``: (d, axes, ``names``), vectors constant
    in cells of any depths to ``depth`` whose gradient field is sought; it takes the place of ``right``.
    Levels over ``base`` hold corners about the cells with samples, a right side or vectors of that depth or deeper.
    """
    if base > (5 if dim == 3 else 8):
        raise ValueError("the base level is solved on the driver; 5 in space and 8 in the plane are its bounds")
    axes, unit = axes_of(dim), UNIT[:dim]
    rights = {}
    if right is not None:
        rights[depth] = written(right)
        for d in range(depth - 1, base - 1, -1):
            rights[d] = written(restrict(rights[d + 1], axes))
    if fields is not None:
        for d in range(depth, base - 1, -1):
            own = divergence(fields.filter(F.col("d") == d), d, names, axes)
            if d < depth:
                own = own.union(restrict(rights[d + 1], axes)).groupBy(*axes).agg(F.sum("v").alias("v"))
            rights[d] = written(own)
    b = np.zeros(((1 << base) + 1,) * dim)
    if rights:
        t = rights[base]  # a row a corner of the base level at most, and as many again
        if fields is not None and base:
            t = t.union(coarser_loads(full_level(spark, base, axes).select(*axes), base, fields, names, axes))
        t = t.toPandas()
        np.add.at(b, tuple(t[a].to_numpy() for a in axes), t["v"].to_numpy())
    t = point_terms(samples, base, axes).toPandas() if samples is not None else []  # one row a cell of the base level at most
    slopes = (t["gweight"].to_numpy(dtype=float), t[[f"g{a}" for a in axes]].to_numpy(dtype=float)) if len(t) and "gweight" in t else ()
    loads = [b]
    for _ in range(base - min(2, base)):
        loads.append(coarser(loads[-1]))
    x = None
    for d in range(min(2, base), base + 1):  # coarse to fine, each from the one before
        grid, b = Dense(d, dim, mass, lap, curvature), loads[base - d]
        if len(t):
            b = b + grid.add_points(t[list(unit)].to_numpy(dtype=float), t["weight"].to_numpy(dtype=float), t["target"].to_numpy(dtype=float), *slopes)
        x = grid.solve(b, None if x is None else finer(x))
    index = np.indices(x.shape).reshape(dim, -1)
    field = written(spark.createDataFrame(pd.DataFrame({"d": base} | {a: index[n] for n, a in enumerate(axes)} | {"v": x.ravel()}), ", ".join(["d int", *(f"{a} int" for a in axes), "v double"])))
    for d in range(base + 1, depth + 1):
        field = written(field.union(_correction(field, base, d, dim, mass, lap, rights.get(d), samples, iterations, fields, names)))
    return field


def _correction(field: DataFrame, base: int, d: int, dim: int, mass: float, lap: float, right: DataFrame | None, samples: DataFrame | None, iterations: int, fields: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Corners' values at depth ``d`` that take up what the levels before leave over, by conjugate gradients."""
    axes, unit = axes_of(dim), UNIT[:dim]
    terms = written(point_terms(samples, d, axes)) if samples is not None else None
    seeds = []
    if terms is not None:
        seeds.append(terms.select("d", *axes))
    if right is not None:
        n = (1 << d) - 1
        seeds.append(right.select(F.lit(d).alias("d"), *(F.least(F.col(a), F.lit(n)).alias(a) for a in axes)))
    near = neighbours(reduce(DataFrame.union, seeds).distinct(), -1, 1, axes).select(*(F.col(f"n_{a}").alias(a) for a in axes)).distinct()
    corners_of = lambda t: t.select(*axes, F.explode(offsets(0, 1, axes)).alias("o")).select(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes)).distinct()
    active = written(corners_of(near))
    ring = active.select(*axes, F.explode(offsets(-1, 1, axes)).alias("o")).select(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes)).distinct()
    ring = ring.filter(reduce(lambda p, q: p & q, (F.col(a).between(0, 1 << d) for a in axes)))
    places = ring.withColumn("key", F.struct(*axes)).withColumns({u: F.col(a) / F.lit(float(1 << d)) for u, a in zip(unit, axes, strict=True)})
    before = written(evaluate(places.select("key", *unit), field, "key", base, d - 1, dim).select("key.*", F.coalesce("value", F.lit(0.0)).alias("v")))

    pulls = _hats_and_slopes(terms, d, axes) if terms is not None else None

    def at_points(x: DataFrame, scale: str, sign: float) -> DataFrame:
        """Point terms of a vector: values and slopes at the samples, times their weight, on their corners."""
        if scale == "target":
            return pulls.groupBy(*axes).agg(F.sum(F.col("basis") * F.col("weight") * F.col("target")).alias("v"))
        values = pulls.join(x.withColumnRenamed("v", "_x"), list(axes)).groupBy("key", "term").agg(F.sum(F.col("basis") * F.col("_x")).alias("value"))
        return pulls.join(values, ["key", "term"]).groupBy(*axes).agg(F.sum(F.col("basis") * F.col("weight") * F.col("value") * sign).alias("v"))

    def product_(x: DataFrame) -> DataFrame:
        y = apply_system(x, d, mass, lap, axes)
        y = y.union(at_points(x, "value", 1.0)) if terms is not None else y
        return y.join(active, list(axes), "left_semi").groupBy(*axes).agg(F.sum("v").alias("v"))

    parts = [apply_system(before, d, mass, lap, axes).withColumn("v", -F.col("v"))]
    if right is not None:
        parts.append(right.select(*axes, "v"))
    if fields is not None:
        about = active.select(*axes, F.explode(offsets(-1, 0, axes)).alias("o")).select(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes)).distinct()
        about = about.filter(reduce(lambda p, q: p & q, (F.col(a).between(0, (1 << d) - 1) for a in axes)))
        parts.append(coarser_loads(about, d, fields, names, axes))
    if terms is not None:
        parts += [at_points(before, "value", -1.0), at_points(before, "target", 1.0)]
    r = written(reduce(DataFrame.union, parts).join(active, list(axes), "left_semi").groupBy(*axes).agg(F.sum("v").alias("v")))
    both = lambda a, b: a.join(b.select(*axes, F.col("v").alias("y")), list(axes)).agg(F.sum(F.col("v") * F.col("y"))).first()[0] or 0.0
    plus = lambda a, b, s: a.union(b.withColumn("v", F.col("v") * s)).groupBy(*axes).agg(F.sum("v").alias("v"))
    x, p, rr = active.select(*axes, F.lit(0.0).alias("v")), r, both(r, r)
    for _ in range(iterations):
        if rr <= 1e-24:
            break
        q = written(product_(p))
        a = rr / both(p, q)
        x, r = written(plus(x, p, a)), written(plus(r, q, -a))
        rr, old = both(r, r), rr
        p = written(plus(r, p, rr / old))
    return x.select(F.lit(d).alias("d"), *axes, "v")


def average_at(samples: DataFrame, field: DataFrame, base: int, depth: int, dim: int = 3) -> float:
    """Weighted mean of the field at samples (key, unit, weight): the level that a surface is taken at."""
    v = evaluate(samples.select("key", *UNIT[:dim]), field, "key", base, depth, dim)
    r = v.join(samples.select("key", "weight"), "key").filter("value IS NOT NULL").agg(F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).first()
    return r[0]


def grid_values(spark, field: DataFrame, base: int, depth: int, out_depth: int, dim: int = 3, dual: bool = False) -> DataFrame:
    """Rows (axes, val): the field at all corners (or cell centres) of a regular grid."""
    n = (1 << out_depth) + (0 if dual else 1)
    axes, unit = axes_of(dim), UNIT[:dim]
    rows = spark.range(n**dim).select("id", *(F.floor(F.col("id") / n**k % n).cast("int").alias(a) for k, a in enumerate(axes)))
    at = rows.withColumns({u: (F.col(a) + (0.5 if dual else 0.0)) / F.lit(float(1 << out_depth)) for u, a in zip(unit, axes, strict=True)})
    return rows.join(evaluate(at.select("id", *unit), field, "id", base, depth, dim), "id").select(*axes, F.col("value").alias("val"))


def slice_values(field: DataFrame, axis_value: float, dim: int = 3) -> DataFrame:
    """The field on a plane across the last axis, as a field of one dimension less."""
    last = AXES[dim - 1]
    w = F.greatest(1 - F.abs(F.lit(axis_value) * F.pow(F.lit(2.0), F.col("d")) - F.col(last)), F.lit(0.0))
    return field.withColumn("v", F.col("v") * w).filter(w > 0).groupBy("d", *AXES[: dim - 1]).agg(F.sum("v").alias("v"))


def integral(field: DataFrame, axes: Sequence[str]) -> float:
    """Integral over the unit cube: each hat's volume, halved at the border along each axis."""
    h = F.pow(F.lit(2.0), -F.col("d"))
    w = reduce(mul, (F.when((F.col(a) == 0) | (F.col(a) == F.expr("shiftleft(1, d)")), h / 2).otherwise(h) for a in axes))
    return field.agg(F.sum(F.col("v") * w)).first()[0] or 0.0


def box_average(field: DataFrame, axes: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """One row (mean): the field's mean over a box, from each hat's exact integral along each axis."""
    def upto(a: str, x: float) -> Column:
        """Integral of an axis' hat from minus infinity to ``x``."""
        t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(x) * F.pow(F.lit(2.0), F.col("d")) - F.col(a)))
        return F.when(t < 0, (1 + t) * (1 + t) / 2).otherwise(1 - (1 - t) * (1 - t) / 2)

    h = F.pow(F.lit(2.0), -F.col("d"))
    w = reduce(mul, ((upto(a, hi) - upto(a, lo)) * h for a, lo, hi in zip(axes, low, high, strict=True)))
    volume = float(np.prod(np.subtract(high, low)))
    return field.agg((F.sum(F.col("v") * w) / volume).alias("mean"))


def finer_level(x: DataFrame, d: int, axes: Sequence[str]) -> DataFrame:
    """A level's coefficients (axes, v) at depth ``d`` as those of depth ``d + 1``: linear interpolation."""
    last = 1 << (d + 1)
    y = x.select(*((F.col(a) * 2).alias(a) for a in axes), "v")
    for a in axes:
        spread = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(s).alias("s")) for o, s in ((-1, 0.5), (0, 1.0), (1, 0.5))))
        y = y.withColumn("_t", F.explode(spread)).withColumn(a, F.col(a) + F.col("_t.o")).withColumn("v", F.col("v") * F.col("_t.s")).drop("_t").filter(F.col(a).between(0, last))
    return y.groupBy(*axes).agg(F.sum("v").alias("v"))


def cumulative(field: DataFrame, base: int, depth: int, axes: Sequence[str]) -> DataFrame:
    """The whole field as coefficients (axes, v) of depth ``depth`` alone: levels carried on and added, coarse to fine."""
    level = field.filter(F.col("d") == base).select(*axes, "v")
    for d in range(base, depth):
        level = finer_level(level, d, axes).unionByName(field.filter(F.col("d") == d + 1).select(*axes, "v")).groupBy(*axes).agg(F.sum("v").alias("v"))
    return level


def inner_product(a: DataFrame, b: DataFrame, base: int, depth: int, axes: Sequence[str], mass: float = 1.0, lap: float = 0.0) -> DataFrame:
    """One row (product) of two fields: mass times the integral of their product plus lap times that of their gradients'. Across levels, by way of the finest."""
    x, y = (cumulative(f, base, depth, axes) for f in (a, b))
    return apply_system(x, depth, mass, lap, axes).join(y.withColumnRenamed("v", "_y"), list(axes)).agg(F.sum(F.col("v") * F.col("_y")).alias("product"))


def point_product(samples: DataFrame, a: DataFrame, b: DataFrame, key: str, base: int, depth: int, dim: int) -> DataFrame:
    """One row (product): the sum over samples (key, unit, weight) of weight times both fields' values."""
    x, y = (evaluate(samples, f, key, base, depth, dim).withColumnRenamed("value", n) for f, n in ((a, "_a"), (b, "_b")))
    return samples.select(key, "weight").join(x, key).join(y, key).agg(F.sum(F.col("weight") * F.col("_a") * F.col("_b")).alias("product"))


def leaf_values(field: DataFrame, tree: DataFrame, base: int, depth: int, axes: Sequence[str]) -> DataFrame:
    """Rows (d, axes, value): the field at the centres of a tree's leaves."""
    leaf = leaves(tree, axes).select("d", *axes).withColumn("_key", F.struct("d", *axes))
    at = leaf.select("_key", *(((F.col(a) + 0.5) / F.pow(F.lit(2.0), F.col("d"))).alias(u) for a, u in zip(axes, UNIT, strict=False)))
    return evaluate(at, field, "_key", base, depth, len(axes)).select("_key.*", "value")


def support_weights(tree: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Rows (d, axes, weight): the share of each corner's hat that lies over cells of the tree at its own depth."""
    c = tree.select("d", *axes, F.explode(offsets(0, 1, axes)).alias("o")).select("d", *((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes))
    edge = reduce(mul, (F.when((F.col(a) == 0) | (F.col(a) == F.expr("shiftleft(1, d)")), 1.0).otherwise(2.0) for a in axes))
    return c.groupBy("d", *axes).agg(F.count(F.lit(1)).alias("n")).select("d", *axes, (F.col("n") / edge).alias("weight"))


def sample_grid(points: DataFrame, grid: DataFrame, key: str, value: str = "val", axes: Sequence[str] = ("i", "j"), at: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows (key, value, weight): multilinear values of a grid at points in its own units.

    Corners outside the grid are left out of the value and of the weight; a value read at the border is
    their quotient, as callers want it. Points without any corner have no row.
    """
    rows = points.select(key, *(F.floor(c).cast("int").alias(a) for c, a in zip(at, axes, strict=True)), *((F.col(c) - F.floor(c)).alias(f"_{a}") for c, a in zip(at, axes, strict=True)))
    rows = rows.withColumn("o", F.explode(offsets(0, 1, axes)))
    w = reduce(mul, (F.when(F.col(f"o.{a}") == 1, F.col(f"_{a}")).otherwise(1 - F.col(f"_{a}")) for a in axes))
    rows = rows.select(key, *((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes), w.alias("_w"))
    return rows.join(grid, list(axes)).groupBy(key).agg(F.sum(F.col(value) * F.col("_w")).alias(value), F.sum("_w").alias("weight"))


def grid_statistics(grid: DataFrame, value: str = "val") -> DataFrame:
    """One row (mean, deviation), of the whole population."""
    return grid.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def grey(grid: DataFrame, value: str = "val") -> DataFrame:
    """``grid`` with ``grey``, 0 to 255: values cut off at two deviations from the mean; all the middle if there is no deviation."""
    s = grid_statistics(grid, value)  # one row
    c = F.coalesce(F.try_divide(F.col(value) - F.col("mean"), 2 * F.col("deviation")), F.lit(0.0))
    return grid.crossJoin(F.broadcast(s)).withColumn("grey", (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) + 1) / 2 * 255).drop("mean", "deviation")


def cell_borders(tree: DataFrame, depth: int, axes: Sequence[str] = ("i", "j")) -> DataFrame:
    """Rows (axes, border) of the grid of depth ``depth``: whether the next place along some axis lies in another leaf."""
    rows = full_level(tree.sparkSession, depth, axes).withColumn("_key", F.struct(*axes))
    at = rows.select("_key", *(((F.col(a) + 0.5) / float(1 << depth)).alias(u) for a, u in zip(axes, UNIT, strict=False)))
    found = deepest_cell(at, tree, "_key", depth, UNIT[: len(axes)], axes).select("_key", F.struct("d", *axes).alias("_c"))
    leaf = rows.join(found, "_key").select(*axes, "_c")
    border = F.lit(False)
    out = leaf
    for a in axes:
        near = leaf.select(*((F.col(b) - 1 if b == a else F.col(b)).alias(b) for b in axes), F.col("_c").alias(f"_{a}"))
        out = out.join(near, list(axes), "left")
        border = border | F.coalesce(F.col("_c") != F.col(f"_{a}"), F.lit(False))
    return out.select(*axes, border.alias("border"))


def full_level(spark, depth: int, axes: Sequence[str]) -> DataFrame:
    """All cells of one depth."""
    n = 1 << depth
    return spark.range(n ** len(axes)).select(F.lit(depth).alias("d"), *(F.floor(F.col("id") / n**k % n).cast("int").alias(a) for k, a in enumerate(axes)))


def trim_to(field: DataFrame, depth: int) -> DataFrame:
    return field.filter(F.col("d") <= depth)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two fields over the union of their corners."""
    key = [c for c in a.columns if c != "v"]
    return a.unionByName(b).groupBy(*key).agg(F.sum("v").alias("v"))


