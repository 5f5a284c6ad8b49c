"""Columns over vectors (arrays of doubles) and bags (arrays of vectors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many dimensions a distance is written out; beyond, it is folded over the arrays.
WRITTEN_OUT = 24


def euclidean(a: Column, b: Column, dims: int | None = None) -> Column:
    """Euclidean distance of two vectors of equal length."""
    if dims and dims <= WRITTEN_OUT:
        total = None
        for k in range(dims):
            d = F.get(a, k) - F.get(b, k)
            total = d * d if total is None else total + d * d
        return F.sqrt(total)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def _directed(a: Column, b: Column, dims: int | None) -> Column:
    return F.array_max(F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: euclidean(p, q, dims)))))


def has_nan(bag: Column) -> Column:
    return F.exists(bag, lambda p: F.exists(p, lambda v: F.isnan(v)))


def guarded(a: Column, b: Column, distance: Column) -> Column:
    """Infinite if either bag is empty, NaN if either holds NaN; Spark's minima would skip NaN and give null for none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(float("inf"))).when(has_nan(a) | has_nan(b), F.lit(float("nan"))).otherwise(distance)


def directed_hausdorff(a: Column, b: Column, dims: int | None = None) -> Column:
    """The greatest distance from an instance of a to its nearest of b."""
    return guarded(a, b, _directed(a, b, dims))


def hausdorff(a: Column, b: Column, dims: int | None = None) -> Column:
    """The greater of both directed distances."""
    return guarded(a, b, F.greatest(_directed(a, b, dims), _directed(b, a, dims)))


#: Distances of bags by name. Others can be added: functions of two bag columns and the number of dimensions.
METRICS = {"hausdorff": hausdorff}


def metric(name: str):
    if name.lower() not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[name.lower()]


def values(bag: Column, k: int) -> Column:
    """The k-th values of all instances."""
    return F.transform(bag, lambda p: F.get(p, k))


def centroid(bag: Column, dims: int) -> Column:
    """The mean of each dimension; null for an empty bag."""
    sums = F.aggregate(bag, F.array(*[F.lit(0.0)] * dims), lambda s, p: F.zip_with(s, p, lambda x, y: x + y))
    return F.when(F.size(bag) > 0, F.transform(sums, lambda s: s / F.size(bag)))


def put(vector: Column, k: int, value: Column) -> Column:
    """The vector with another k-th value (0-based); an index outside raises."""
    checked = F.when((F.lit(k) < 0) | (F.lit(k) >= F.size(vector)), F.raise_error(F.lit(f"index {k} out of range")).cast("array<double>")).otherwise(vector)
    return F.transform(checked, lambda x, i: F.when(i == k, value.cast("double")).otherwise(x))


def mapped(bag: Column, f) -> Column:
    """Each value v of dimension i as f(v, i)."""
    return F.transform(bag, lambda p: F.transform(p, f))
