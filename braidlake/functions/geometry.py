"""Distances between images and box geometry, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def mean_absolute(a: Column, b: Column) -> Column:
    """Mean of |a - b|: the random walk's distance."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(a)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def rms(a: Column, b: Column) -> Column:
    return euclidean(a, b) / F.sqrt(F.size(a).cast("double"))


def wrapped(d: Column, length: Column | float) -> Column:
    """Minimum image of a displacement in a periodic box."""
    length = F.lit(length) if isinstance(length, float) else length
    return d - length * F.round(d / length)


def reciprocal_gap(a: Column, b: Column) -> Column:
    """|1/a - 1/b| of two distances to a reference."""
    return F.abs(1 / a - 1 / b)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def box_lengths_angles(box: Column) -> Column:
    """struct(a, b, c, ab, bc, ca): lengths of three box vectors, and angles in degrees between 1-2, 2-3 and 3-1."""
    v = [box[i] for i in range(3)]
    length = [F.sqrt(_dot(x, x)) for x in v]
    angle = lambda i, j: F.degrees(F.acos(_dot(v[i], v[j]) / (length[i] * length[j])))
    return F.struct(length[0].alias("a"), length[1].alias("b"), length[2].alias("c"), angle(0, 1).alias("ab"), angle(1, 2).alias("bc"), angle(2, 0).alias("ca"))


def box_vectors(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Three vectors from lengths and angles in degrees (alpha: between b and c, beta: a and c, gamma: a and b); near-zero entries are 0."""
    al, be, ga = (F.radians(x) for x in (alpha, beta, gamma))
    clean = lambda x: F.when(F.abs(x) < 1e-6, 0.0).otherwise(x)
    zero = F.lit(0.0)
    cx = c * F.cos(be)
    cy = c * (F.cos(al) - F.cos(be) * F.cos(ga)) / F.sin(ga)
    cz = F.sqrt(c * c - cx * cx - cy * cy)
    rows = ((a.cast("double"), zero, zero), (b * F.cos(ga), b * F.sin(ga), zero), (cx, cy, cz))
    return F.array(*(F.array(*(clean(x) for x in r)) for r in rows))


def walk_probability(x: Column, p: float) -> Column:
    """Stationary probability of site x of a walk that steps out with probability p and reflects at 0."""
    r = p / (1 - p)
    return F.lit(1 - r) * F.pow(F.lit(r), x)
