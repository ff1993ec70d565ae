"""Point tables: extent, alignment, filters, sampling, slabs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot, norm, normal_color, vector
from ..storage import written

#: The axes and the six face diagonals.
DIRECTIONS = [
    (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, -1, 0), (1, 0, -1), (0, 1, -1),
]


def directions() -> list[tuple[float, ...]]:
    return [tuple(x / math.sqrt(sum(y * y for y in d)) for x in d) for d in DIRECTIONS]


def extent(df: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Rows (direction, low, high) over the nine directions, in one aggregation."""
    p = [F.col(c) for c in axes]
    row = df.agg(*(f(dot(p, d)).alias(f"{n}{i}") for i, d in enumerate(directions()) for n, f in (("low", F.min), ("high", F.max))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("direction"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")) for i in range(len(DIRECTIONS))))).alias("r")).select("r.*")


@dataclass(frozen=True)
class Alignment:
    """x -> (x - origin) / scale, for each axis."""

    origin: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, columns: Sequence[Column]) -> list[Column]:
        return [(c - F.lit(o)) / F.lit(s) for c, o, s in zip(columns, self.origin, self.scale, strict=True)]

    def invert(self, columns: Sequence[Column]) -> list[Column]:
        return [c * F.lit(s) + F.lit(o) for c, o, s in zip(columns, self.origin, self.scale, strict=True)]

    def matrix(self) -> np.ndarray:
        m = np.diag([*(1 / s for s in self.scale), 1.0])
        m[:-1, -1] = [-o / s for o, s in zip(self.origin, self.scale, strict=True)]
        return m


def unit_cube(df: DataFrame, axes: Sequence[str] = ("x", "y", "z"), factor: float = 1.1, each_axis: bool = False) -> Alignment:
    """The alignment of a table's bounding box with the unit cube; one pass, one row to the driver.

    All axes get the scale of the longest, times ``factor``, and the box is centred; with
    ``each_axis`` each gets its own range. An empty or flat range gets scale 1.
    """
    r = df.agg(*(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    lo, hi = [float(r[f"lo_{c}"] or 0.0) for c in axes], [float(r[f"hi_{c}"] or 0.0) for c in axes]
    if each_axis:
        return Alignment(tuple(lo), tuple((h - a) or 1.0 for a, h in zip(lo, hi, strict=True)))
    s = factor * max(h - a for a, h in zip(lo, hi, strict=True)) or 1.0
    return Alignment(tuple((a + h) / 2 - s / 2 for a, h in zip(lo, hi, strict=True)), (s,) * len(axes))


def rotation_to_last(frame: int) -> np.ndarray:
    """The rotation that takes direction ``frame`` to the last axis and two directions normal to it to the others."""
    d = np.array(directions()[frame])
    other = [np.array(x) for x in directions() if abs(np.dot(x, d)) < 1e-9]
    u = other[0]
    return np.stack([u, np.cross(d, u), d])


def systematic_sample(df: DataFrame, keep: int, order: Sequence[str]) -> DataFrame:
    """``keep`` rows at even distances: those at places floor(i * N / keep).

    Places are dense row numbers over range partitions, so no task sees all rows.
    """
    numbered = row_numbers(df, order, "_place")
    n = df.count()
    wanted = df.sparkSession.range(keep).select(F.floor(F.col("id") * n / keep).cast("long").alias("_place"))
    return numbered.join(wanted, "_place").drop("_place")


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "place", start: int = 0) -> DataFrame:
    """Dense numbers in order (nulls last), without a window over the whole table: ranges are sorted each on its own and offset by the sizes of those before.

    The sorted ranges are written first: dealt out twice, for their rows and for their sizes, they have different bounds.
    """
    if df.isStreaming:
        raise ValueError("row numbers need a finite table")
    by = [F.col(c).asc_nulls_last() for c in order]
    # the number of the range above 33 bits, that of the row in it below
    local = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id()))
    local = local.withColumn("_part", F.shiftright("_n", 33)).withColumn("_n", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_n") + start).drop("_part", "_n", "_before")


def hash_sample(df: DataFrame, fraction: float, key: Sequence[str]) -> DataFrame:
    """A Bernoulli sample that is the same in every run: by a hash of ``key``."""
    return df.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < int(fraction * (1 << 20)))


def disks(df: DataFrame, res: int = 12, scale: float = 0.005, exponent: float = 0.66, axes=("x", "y", "z"), normal=("nx", "ny", "nz"), key: str = "pid") -> DataFrame:
    """Each oriented point as a regular polygon: rows (key, corner, x, y, z, nx, ny, nz, red, green, blue).

    The radius is the bounding box's diagonal times ``scale`` times the normal's length to the ``exponent``;
    points without a normal are left out.
    """
    box = df.agg(*(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    radius = scale * math.sqrt(sum(((box[f"hi_{c}"] or 0.0) - (box[f"lo_{c}"] or 0.0)) ** 2 for c in axes))
    length = norm(vector(*normal))
    rows = df.filter(length > 0).withColumn("_l", length).withColumns({f"_n{i}": F.col(c) / F.col("_l") for i, c in enumerate(normal)})
    n = vector("_n0", "_n1", "_n2")
    flat = n[0] * n[0] + n[2] * n[2] < 1e-7  # along y: any vector across will do
    v1 = [F.when(flat, 1.0).otherwise(-n[2]), F.lit(0.0), F.when(flat, 0.0).otherwise(n[0])]
    rows = rows.withColumns({f"_u{i}": c for i, c in enumerate(v1)})
    u = vector("_u0", "_u1", "_u2")
    w = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
    lu, lw = norm(u), norm(w)
    rows = rows.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(res - 1))))
    t, r = F.col("corner") * (2 * math.pi / res), radius * F.pow("_l", F.lit(exponent))
    place = [F.col(c) + (u[i] / lu * F.cos(t) + w[i] / lw * F.sin(t)) * r for i, c in enumerate(axes)]
    red, green, blue = normal_color(n)
    return rows.select(key, "corner", *(c.alias(x) for c, x in zip(place, "xyz", strict=True)), *(c.alias(x) for c, x in zip(n, ("nx", "ny", "nz"), strict=True)), red.alias("red"), green.alias("green"), blue.alias("blue"))


def slab(u: Column, slabs: int) -> Column:
    """Number of the slab along an axis: floor, unlike cells, whose ties go low."""
    return F.floor(u * slabs).cast("int")


def in_slabs(df: DataFrame, u: str, slabs: int, first: int, last: int) -> DataFrame:
    """Rows with ``slab``, and ``inside`` whether it is one of ``first`` to before ``last``; rows out of range are told, not moved."""
    rows = df.withColumn("slab", slab(F.col(u), slabs))
    return rows.withColumn("inside", (F.col("slab") >= first) & (F.col("slab") < last))


def partition_energy(counts: Sequence[int], ends: Sequence[int]) -> int:
    """Sum of the squared sizes of contiguous ranges."""
    return sum(int(sum(counts[a:b])) ** 2 for a, b in zip([0, *ends], ends))  # noqa: B905


def one_after_another(parts: Sequence[DataFrame], numbers: Sequence[int | None] | None = None) -> DataFrame:
    """Streams as one table, with ``stream`` and dense numbers: those of a stream (in order of ``idx``) after those before.

    ``numbers``: the streams' numbers, instead of their places among ``parts``; streams come by number, that without one last.
    """
    rows = reduce(DataFrame.unionByName, (p.withColumn("stream", F.lit(n).cast("int")) for n, p in zip(range(len(parts)) if numbers is None else numbers, parts, strict=True)))
    return row_numbers(rows, ["stream", "idx"], "place")


def interleaved(parts: Sequence[DataFrame]) -> DataFrame:
    """Indexed streams merged by ``idx``: ranges of the index, each sorted on its own."""
    return reduce(DataFrame.unionByName, parts).repartitionByRange("idx").sortWithinPartitions("idx")


def merged_slabs(clients: Sequence[DataFrame]) -> DataFrame:
    """Slab fragments of all clients, a slab's rows together."""
    return reduce(DataFrame.unionByName, clients).repartition("slab").sortWithinPartitions("slab")


def grid_index(axes: Sequence[str], resolution: Sequence[int]) -> Column:
    """Linear index of a grid place, first axis fastest."""
    index = F.lit(0).cast("long")
    for a, n in zip(reversed(list(axes)), reversed(list(resolution)), strict=True):
        index = index * n + F.col(a)
    return index


def grid_coordinates(index: Column, axes: Sequence[str], resolution: Sequence[int]) -> list[Column]:
    out = []
    for a, n in zip(axes, resolution, strict=True):
        out.append((index % n).cast("int").alias(a))
        index = F.floor(index / n)
    return out


def depth_of_width(scale: Column | float, width: Column | float) -> Column:
    """The least depth at which a cell of a cube of side ``scale`` is no wider than ``width``."""
    return F.ceil(F.greatest(F.lit(0.0), F.log2(F.lit(scale) / width))).cast("int")


def balanced_ranges(counts: Sequence[int], parts: int, by_max: bool = False) -> list[int]:
    """Ends of ``parts`` contiguous ranges of slabs with the least sum of squared counts (or the least maximum).

    Runs on the driver over one number for each slab.
    """
    n = len(counts)
    cum = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best, cut = np.full((parts + 1, n + 1), np.inf), np.zeros((parts + 1, n + 1), dtype=int)
    best[0, 0] = 0
    for p in range(1, parts + 1):
        for end in range(p, n + 1):
            size = cum[end] - cum[:end]
            e = np.maximum(best[p - 1, :end], size) if by_max else best[p - 1, :end] + size**2
            cut[p, end] = int(np.argmin(e))
            best[p, end] = e[cut[p, end]]
    ends, end = [], n
    for p in range(min(parts, n), 0, -1):
        ends.append(int(end))
        end = cut[p, end]
    return ends[::-1]


def padded_depth(w: Column, begin: float, end: float, pad: int, least: int, most: int) -> Column:
    """How deep a point counts for the slab [begin, end]: fully inside, less with distance outside."""
    gap = F.when(w < begin, begin - w).when(w > end, w - end)
    d = F.greatest(F.least(F.floor(F.log2(F.lit(float(pad)) / gap)).cast("int"), F.lit(most)), F.lit(least))
    return F.when(gap.isNull(), F.lit(most)).otherwise(d)


def ghosted(df: DataFrame, u: str, slabs: int, pad: int) -> DataFrame:
    """Every row for its slab and for ``pad`` slabs to either side; ``own`` tells which is its own."""
    own = F.least(slab(F.col(u), slabs), F.lit(slabs - 1))
    rows = df.withColumn("_own", own).withColumn("slab", F.explode(F.sequence(F.greatest(own - pad, F.lit(0)), F.least(own + pad, F.lit(slabs - 1)))))
    return rows.withColumn("own", F.col("slab") == F.col("_own")).drop("_own")
