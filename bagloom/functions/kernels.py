"""Hausdorff distances of many pairs of bags at once, over Arrow arrays.

Higher-order SQL functions are interpreted value by value; over pairs that a join gives in batches, flat arrays are
some hundred times faster. Work goes in blocks of bounded size, also within one pair of very large bags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

#: Instance pairs that are held at once.
BLOCK = 1 << 20


def flat(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and instances of a column of bags."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.asarray(column.flatten().flatten(), float).reshape(-1, dims)


def _directed(a_at, a_n, a, b_at, b_n, b) -> np.ndarray:
    """Squared directed distances of pairs whose bags begin at given instances; none is empty."""
    out = np.zeros(len(a_n))
    rows = np.repeat(np.arange(len(a_n)), a_n)  # a row for each instance of a left bag
    instance = np.repeat(a_at - np.concatenate([[0], np.cumsum(a_n)[:-1]]), a_n) + np.arange(len(rows))
    size = b_n[rows]
    least = np.empty(len(rows))
    done = np.cumsum(size)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + BLOCK, side="right")))
        if stop == start + 1 and size[start] > BLOCK:
            other = b[b_at[rows[start]] :][: size[start]]
            parts = [((a[instance[start]] - other[i : i + BLOCK]) ** 2).sum(axis=1).min() for i in range(0, len(other), BLOCK)]
            least[start] = np.min(parts)
        else:
            n = size[start:stop]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            left = np.repeat(np.arange(start, stop), n)
            right = np.repeat(b_at[rows[start:stop]] - first, n) + np.arange(len(left))
            least[start:stop] = np.minimum.reduceat(((a[instance[left]] - b[right]) ** 2).sum(axis=1), first)
        start = stop
    if len(rows):
        out = np.maximum.reduceat(least, np.concatenate([[0], np.cumsum(a_n)[:-1]]))
    return out


def hausdorff(a: pa.Array, b: pa.Array, dims: int, both: bool = True) -> np.ndarray:
    """Distances row by row: infinite if a bag is empty, NaN if one holds NaN. both: the greater of both directions."""
    (a_off, a_values), (b_off, b_values) = flat(a, dims), flat(b, dims)
    a_n, b_n = np.diff(a_off), np.diff(b_off)
    out = np.full(len(a_n), np.inf)
    some = np.flatnonzero((a_n > 0) & (b_n > 0))
    if len(some):
        sides = (a_off[some], a_n[some], a_values), (b_off[some], b_n[some], b_values)
        square = _directed(*sides[0], *sides[1])
        if both:
            square = np.maximum(square, _directed(*sides[1], *sides[0]))
        else:  # NaN of b that is no nearest instance counts too
            bad = np.concatenate([[0], np.cumsum(np.isnan(b_values).any(axis=1))])
            square = np.where(bad[b_off[some] + b_n[some]] > bad[b_off[some]], np.nan, square)
        out[some] = np.sqrt(square)
    return out


def with_distance(pairs, dims: int, both: bool = True):
    """Rows (x, y, bag of x, bag of y) give (x, y, dist)."""
    names = pairs.columns[:2]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hausdorff(batch.column(2), batch.column(3), dims, both))], names=[*names, "dist"])

    return pairs.mapInArrow(run, f"{names[0]} long, {names[1]} long, dist double")
