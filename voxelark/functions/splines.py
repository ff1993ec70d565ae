"""B-splines of low degree: values as column expressions, integrals and stencils as small tables."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def component_values(x: Column, degree: int) -> list[Column]:
    """Values at ``x`` in [0, 1) of a cell of the degree + 1 splines that it supports, leftmost first."""
    if degree == 0:
        return [F.lit(1.0)]
    if degree == 1:
        return [1 - x, x]
    if degree == 2:
        return [(1 - x) * (1 - x) / 2, (1 + 2 * x - 2 * x * x) / 2, x * x / 2]
    raise ValueError("degree 0, 1 or 2")


def pieces(degree: int) -> list[np.polynomial.Polynomial]:
    """The polynomial pieces of the uniform spline on [0, degree + 1], each over [0, 1], by repeated convolution with a box."""
    out = [np.polynomial.Polynomial([1.0])]
    for _ in range(degree):
        n, new = len(out), []
        for i in range(n + 1):
            grown = np.polynomial.Polynomial([0.0])
            if i < n:
                grown = grown + out[i].integ(lbnd=0)
            if i > 0:
                grown = grown + out[i - 1].integ()(1) - out[i - 1].integ(lbnd=0)
            new.append(grown)
        out = new
    return out


def spline(degree: int, t: float, derivative: int = 0) -> float:
    """Value or derivative of the spline on [0, degree + 1]; 0 outside."""
    k = int(np.floor(t))
    if not 0 <= k <= degree:
        return 0.0
    p = pieces(degree)[k]
    return float((p.deriv(derivative) if derivative else p)(t - k))


def integral(degree: int, low: float, high: float) -> float:
    """Integral of the spline over an interval."""
    total = 0.0
    for k, p in enumerate(pieces(degree)):
        a, b = max(low, k), min(high, k + 1)
        if a < b:
            q = p.integ()
            total += float(q(b - k) - q(a - k))
    return total


def inner_products(degree: int, d1: int = 0, d2: int = 0) -> list[float]:
    """Integrals of the product of two unit-width splines' derivatives at offsets -degree .. degree, away from any boundary."""
    p = pieces(degree)
    out = []
    for o in range(-degree, degree + 1):
        total = 0.0
        for k in range(degree + 1):
            j = k - o
            if 0 <= j <= degree:
                a = p[k].deriv(d1) if d1 else p[k]
                b = p[j].deriv(d2) if d2 else p[j]
                q = (a * b).integ()
                total += float(q(1) - q(0))
        out.append(total)
    return out


def two_scale(degree: int) -> list[float]:
    """Weights of the finer splines that a spline is the sum of."""
    c = [Fraction(1)]
    for _ in range(degree + 1):
        c = [a + b for a, b in zip([*c, Fraction(0)], [Fraction(0), *c], strict=True)]
    return [float(x / 2**degree) for x in c]


def reflect(i: int, n: int, boundary: str) -> tuple[int, int]:
    """(place, sign) that an offset outside 0 .. n stands for: even for ``neumann``, odd for ``dirichlet``, none for ``free``."""
    if 0 <= i <= n or boundary == "free":
        return i, 1
    j, sign = i, 1
    while not 0 <= j <= n:
        j = -j if j < 0 else 2 * n - j
        sign = -sign if boundary == "dirichlet" else sign
    return j, sign


def hat_mass(o: int, at_edge: Column | bool, h: float) -> Column | float:
    """Integral of two hats' product: of a node with itself (half at the edge) or with its neighbour."""
    if o:
        return h / 6
    return F.when(at_edge, h / 3).otherwise(2 * h / 3) if isinstance(at_edge, Column) else (h / 3 if at_edge else 2 * h / 3)


def hat_stiffness(o: int, at_edge: Column | bool, h: float) -> Column | float:
    """Integral of two hats' derivatives' product."""
    if o:
        return -1 / h
    return F.when(at_edge, 1 / h).otherwise(2 / h) if isinstance(at_edge, Column) else (1 / h if at_edge else 2 / h)


def density_scale(dim: int = 3, co_dim: int = 1, degree: int = 2, res: int = 10) -> float:
    """1 / the average response of a point to points like it on a plane of the given co-dimension.

    A point at p inside a cell splats its spline values on (degree + 1)^dim cells; so do its
    likes at p in all cells of the plane. The response is averaged over ``res``^dim positions.
    As the plane's axes sum to 1 each, only the other ``co_dim`` axes and the own values along
    the plane enter.
    """
    p = pieces(degree)[::-1]
    x = (np.arange(res) + 0.5) / res
    v = np.array([[float(q(t)) for q in p] for t in x])  # values of the cells' splines at each position
    across = (v * v).sum(axis=1)  # sum of squares on one axis off the plane
    total = []
    for index in np.ndindex(*([res] * dim)):
        total.append(np.prod([across[i] for i in index[:co_dim]]))
    return float(np.mean(1 / np.array(total)))
