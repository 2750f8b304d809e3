"""Boxes, intervals and missing values as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_bounds(bounds: Sequence, ndim: int = 1) -> list[tuple[float, float]]:
    """Bounds of a progress-coordinate box as (low, high) for each dimension; a flat pair is one dimension."""
    rows = [tuple(bounds)] if not hasattr(bounds[0], "__len__") else [tuple(b) for b in bounds]
    if len(rows) != ndim or any(len(b) != 2 for b in rows):
        raise AssertionError(f"bounds must be {ndim} pairs")
    if any(not b[0] < b[1] for b in rows):
        raise AssertionError("a lower bound is not below its upper bound")
    return [(float(a), float(b)) for a, b in rows]


def box_centre(bounds: Sequence, ndim: int = 1) -> list[float]:
    """The mean of each dimension's bounds, or the finite one."""
    return [b if math.isinf(a) else a if math.isinf(b) else (a + b) / 2 for a, b in check_bounds(bounds, ndim)]


def in_box(coords: Sequence[Column], bounds: Sequence) -> Column:
    """Strictly inside the box in its dimensions; further coordinates don't matter."""
    pairs = check_bounds(bounds, len(bounds) if hasattr(bounds[0], "__len__") else 1)
    return reduce(lambda x, y: x & y, [(c > lo) & (c < hi) for c, (lo, hi) in zip(coords, pairs, strict=False)])


def _depth(x) -> int:
    return 1 + _depth(x[0]) if hasattr(x, "__len__") else 0


def in_interval(coords: Sequence[Column] | Column, interval: Sequence) -> Column:
    """Half-open: [a, b), a union of such, a product over dimensions, or a union of products.

    With one coordinate, a list of pairs is a union; with several, it is a product.
    """
    cols = [coords] if isinstance(coords, Column) else list(coords)
    depth = _depth(interval)
    one = lambda c, p: (c >= float(p[0])) & (c < float(p[1]))
    if depth == 1:
        parts = [[interval]]
    elif depth == 2:
        parts = [[p] for p in interval] if len(cols) == 1 else [interval]
    else:
        parts = list(interval)
    for p in parts:
        if len(p) != len(cols):
            raise ValueError("the interval and the point differ in dimensions")
    return reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [one(c, b) for c, b in zip(cols, p, strict=True)]) for p in parts])


def has_nan(array: Column) -> Column:
    """Whether an array of doubles is null or holds NaN."""
    return F.coalesce(F.exists(array, F.isnan), F.lit(True))


def first_dims(array: Column, ndim: int) -> Column:
    return F.slice(array, 1, ndim)


def merged_label(state: Column, group: Sequence) -> Column:
    """All labels of a macrostate as its first one."""
    return F.when(state.isin(list(group)), F.lit(group[0])).otherwise(state)


def uniform_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Number of the bin of n equal ones from low to high, -1 below and n from high on."""
    width = (high - low) / n
    return F.when(x < low, F.lit(-1)).when(x >= high, F.lit(n)).otherwise(F.floor((x - low) / width)).cast("long")


def rectilinear_bin(coords: Sequence[Column], edges: Sequence[Sequence[float]]) -> Column:
    """Row-major number of the cell of a grid given by ascending edges for each dimension; null outside of it."""
    out = F.lit(0).cast("long")
    inside = F.lit(True)
    for c, e in zip(coords, edges, strict=True):
        place = reduce(lambda x, y: x + y, [(c >= float(b)).cast("long") for b in e]) - 1
        inside = inside & (c >= float(e[0])) & (c < float(e[-1]))
        out = out * (len(e) - 1) + place
    return F.when(inside, out)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, v: s + v)


def rmsd(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b) / F.size(a))


def voronoi_bin(x: Column, centres: Sequence[Sequence[float]], distance=squared_distance) -> Column:
    """Number of the nearest centre of an array column, the lower of equals; centres are a few literals."""
    at = [F.struct(distance(x, F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*at))["i"].cast("long")
