"""Column expressions that the engine shares; all run inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector(*names: str) -> Column:
    """Feature columns as one array of doubles, in the order given."""
    return F.array(*[F.col(n).cast("double") for n in names])


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def finite(c: str | Column) -> Column:
    """Neither null nor NaN nor infinite."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(array: str | Column) -> Column:
    return F.forall(col(array), finite)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def rbf(a: str | Column, b: str | Column, sigma: float) -> Column:
    """exp(-|a - b|^2 / (2 sigma^2)); sigma must be positive."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return F.exp(-squared_distance(a, b) / F.lit(2.0 * sigma * sigma))


def sigmoid(c: str | Column) -> Column:
    """Logistic function that doesn't overflow on either side."""
    c = col(c)
    return F.when(c >= 0, 1.0 / (1.0 + F.exp(-c))).otherwise(F.exp(c) / (1.0 + F.exp(c)))


def log_loss(eta: str | Column, y: str | Column) -> Column:
    """log(1 + exp(eta)) - y eta."""
    eta, y = col(eta), col(y).cast("double")
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta


def logit(p: str | Column, floor: float = 1e-10) -> Column:
    p = F.greatest(F.least(col(p), F.lit(1.0 - floor)), F.lit(floor))
    return F.log(p / (1.0 - p))


def hash_key(seed: int, *parts: str | Column) -> Column:
    """md5 of seed and parts, joined by colons: a random order that any engine can reproduce."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def hash_uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) from the first 52 bits of hash_key."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def random_fourier(x: str | Column, weights: Sequence[Sequence[float]]) -> Column:
    """sqrt(1/m) [cos(xW), sin(xW)] for the m columns of W, given as m lists; for few frequencies (use Arrow for many)."""
    scale = math.sqrt(1.0 / len(weights))
    table = F.array(*[literal_vector(w) for w in weights])
    return F.concat(F.transform(table, lambda w: F.cos(dot(x, w)) * scale), F.transform(table, lambda w: F.sin(dot(x, w)) * scale))


def to_cell(x: str | Column, y: str | Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Row and column of a point in a north-up grid whose top left corner is (x0, y0)."""
    return F.floor((F.lit(y0) - col(y)) / F.lit(dy)).cast("int"), F.floor((col(x) - F.lit(x0)) / F.lit(dx)).cast("int")


def to_centre(row: str | Column, column: str | Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Coordinates of a cell's centre."""
    return F.lit(x0) + (col(column) + 0.5) * F.lit(dx), F.lit(y0) - (col(row) + 0.5) * F.lit(dy)


def clip(c: str | Column, low: Column | float, high: Column | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lift(low), F.least(lift(high), col(c)))


def reflect(i: str | Column, n: Column | int) -> Column:
    """Index mirrored at the edges without repeating them."""
    i = col(i)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def digitize(value: str | Column, edges: Column, right: bool = False) -> Column:
    """Number of edges below the value (right), or below or equal to it less one."""
    v = col(value)
    return F.size(F.filter(edges, lambda e: e < v)) if right else F.size(F.filter(edges, lambda e: e <= v)) - 1


def midpoint_quantiles(sorted_values: str | Column, q: int) -> Column:
    """Quantile function of a sorted array, placed at (i + 1/2) / n, read linearly at (j + 1/2) / q."""
    v = col(sorted_values)
    n = F.size(v)

    def at(j: Column) -> Column:
        p = (j.cast("double") + 0.5) / F.lit(float(q)) * n - 0.5
        p = F.greatest(F.lit(0.0), F.least(p, (n - 1).cast("double")))
        low = F.floor(p).cast("int")
        high = F.least(low + 1, n - 1)
        part = p - low
        return F.element_at(v, low + 1) * (1.0 - part) + F.element_at(v, high + 1) * part

    return F.transform(F.sequence(F.lit(0), F.lit(q - 1)), at)


def endpoint_quantiles(sorted_values: str | Column, q: Column | int) -> Column:
    """Sorted array read linearly at q equally spaced places from its first to its last element."""
    v = col(sorted_values)
    n = F.size(v)
    q = q if isinstance(q, Column) else F.lit(q)

    def at(j: Column) -> Column:
        p = F.when(q > 1, j.cast("double") / (q - 1) * (n - 1)).otherwise(F.lit(0.0))
        low = F.floor(p).cast("int")
        high = F.least(low + 1, n - 1)
        part = p - low
        return F.element_at(v, low + 1) * (1.0 - part) + F.element_at(v, high + 1) * part

    return F.transform(F.sequence(F.lit(0), q - 1), at)


def in_ring(x: str | Column, y: str | Column, ring: str | Column) -> Column:
    """Whether a point lies in a closed ring of struct<x, y> vertices (even-odd rule)."""
    px, py, ring = col(x), col(y), col(ring)
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    crosses = lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(edges, crosses)) % 2 == 1
