"""Vector, affine and root-finding algebra as column expressions; vectors are sequences of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def vector(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def dot(a: Vector, b: Sequence) -> Column:
    return reduce(add, (x * y for x, y in zip(a, b, strict=True)))


def square_norm(a: Vector) -> Column:
    return dot(a, a)


def norm(a: Vector) -> Column:
    return F.sqrt(square_norm(a))


def distance(a: Vector, b: Vector) -> Column:
    return norm([x - y for x, y in zip(a, b, strict=True)])


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    """Half the root of the Gram determinant, in any dimension; 0 where rounding makes that negative."""
    u, v = [x - y for x, y in zip(b, a, strict=True)], [x - y for x, y in zip(c, a, strict=True)]
    return F.sqrt(F.greatest(dot(u, u) * dot(v, v) - dot(u, v) * dot(u, v), F.lit(0.0))) / 2


def array_dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two array columns of any length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_norm(a: Column | str) -> Column:
    return F.sqrt(array_dot(a, a))


def apply_affine(p: Vector, m: np.ndarray) -> list[Column]:
    """Homogeneous transform of a point by a (D+1) x (D+1) matrix."""
    d = len(p)
    return [reduce(add, (p[c] * F.lit(float(m[r, c])) for c in range(d))) + F.lit(float(m[r, d])) for r in range(d)]


def apply_normal(n: Vector, m: np.ndarray) -> list[Column]:
    """Transform of a normal: by the inverse transpose of the linear part."""
    d = len(n)
    t = np.linalg.inv(m[:d, :d]).T
    return [reduce(add, (n[c] * F.lit(float(t[r, c])) for c in range(d))) for r in range(d)]


def finite_normal(n: Vector) -> Column:
    """A usable normal: squared length above 0 and finite."""
    s = square_norm(n)
    return (s > 0) & ~F.isnan(s) & (s < float("inf"))


def in_unit_cube(p: Vector) -> Column:
    """Closed at both ends."""
    return reduce(lambda a, b: a & b, (x.between(0.0, 1.0) for x in p))


def in_box(p: Vector, low: Sequence[float], high: Sequence[float]) -> Column:
    """Half open: low <= p < high."""
    return reduce(lambda a, b: a & b, ((x >= lo) & (x < hi) for x, lo, hi in zip(p, low, high, strict=True)))


def in_half_spaces(p: Vector, planes: Sequence[Sequence[float]]) -> Column:
    """All of <(p, 1), h> <= 0."""
    return reduce(lambda a, b: a & b, (dot(p, h[:-1]) + h[-1] <= 0 for h in planes))


def confidence(columns: Vector, exponents: Sequence[float]) -> Column:
    return reduce(lambda a, b: a * b, (F.pow(c, F.lit(float(e))) for c, e in zip(columns, exponents, strict=True)), F.lit(1.0))


def normal_color(n: Vector) -> list[Column]:
    """Red for +x, green for +y, blue for +z, their complements for the other way; at most 255."""
    out = []
    for c in range(3):
        own = F.when(n[c] > 0, n[c]).otherwise(0.0)
        others = [F.when(n[d] < 0, -n[d]).otherwise(0.0) for d in range(3) if d != c]
        out.append(F.least(F.lit(255.0), (own + others[0] + others[1]) * 255))
    return out


def linear_root(x0: Column, x1: Column, iso: Column | float) -> Column:
    """Where a line from x0 at 0 to x1 at 1 meets ``iso``; the middle if it is level."""
    return F.when(x0 == x1, 0.5).otherwise((iso - x0) / (x1 - x0))


def hermite_root(x0: Column, x1: Column, d0: Column, d1: Column, iso: Column | float) -> Column:
    """Root of the quadratic through both values whose slope is the mean of the least-squares fit to both slopes.

    The quadratic a t^2 + b t + c has c = x0 - iso and passes x1 - iso at 1; the free number is
    set so that the slopes at both ends, b and 2a + b, are off from d0 and d1 by the same amount.
    Of two roots in [0, 1] their mean is taken, of none the linear root; the result is clamped.
    """
    c, s = x0 - iso, x1 - x0
    a = (d1 - d0) / 2
    b = s - a
    disc = b * b - 4 * a * c
    r = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t0, t1 = (-b - r) / (2 * a), (-b + r) / (2 * a)
    ok0, ok1 = t0.between(0.0, 1.0), t1.between(0.0, 1.0)
    line = linear_root(x0, x1, iso)
    t = F.when((F.abs(a) < 1e-12) | (disc < 0), line).when(ok0 & ok1, (t0 + t1) / 2).when(ok0, t0).when(ok1, t1).otherwise(line)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def real_roots(c: Sequence[float]) -> list[float]:
    """Real roots of a polynomial of degree up to 4, lowest coefficient first, in order."""
    c = list(c)
    while len(c) > 1 and c[-1] == 0:
        c.pop()
    return sorted(float(r.real) for r in np.roots(c[::-1]) if abs(r.imag) < 1e-9)


def polynomial(coefficients: Sequence[float], t: Column) -> Column:
    """Horner's rule, lowest coefficient first."""
    return reduce(lambda s, c: s * t + F.lit(float(c)), list(coefficients)[::-1][1:], F.lit(float(list(coefficients)[-1])))


def poly_integral(coefficients: Sequence[float], low: float, high: float) -> float:
    p = np.polynomial.Polynomial(coefficients).integ()
    return float(p(high) - p(low))


def sphere_point(key: Column, n_bits: int = 53) -> list[Column]:
    """A point of the unit sphere for each key, the same in every run."""
    unit = lambda salt: (F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 64 - n_bits)) / F.lit(float(1 << n_bits))
    z, phi = unit(1) * 2 - 1, unit(2) * (2 * math.pi)
    r = F.sqrt(F.greatest(1 - z * z, F.lit(0.0)))
    return [r * F.cos(phi), r * F.sin(phi), z]


def scale_translate(scale: float, center: Sequence[float]) -> np.ndarray:
    """x -> scale * (x - center)."""
    d = len(center)
    m = np.eye(d + 1)
    m[:d, :d] *= scale
    m[:d, d] = -scale * np.asarray(center)
    return m
