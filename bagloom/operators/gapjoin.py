"""Pairs of small bags within a distance, where values leave gaps.

If no value of an axis lies in a gap wider than eps, instances on both sides of it are never near each other. Gaps of all axes
part space into regions, and each instance of a bag has a near one in the other bag in its own region. So two bags within eps
occupy the same regions, and in each of them the least values along an axis differ by at most eps, and so do the greatest.

1. Gaps. The least and greatest value of each cell of eps along each axis give all gaps wider than eps.
2. Groups. Bags are dealt over tasks by the regions that they occupy, very large groups in parts. A bag moves once, or once for each part.
3. Boxes. A task halves a group along the bound that is spread most, keeping for each half the bags that its bounds reach,
   until few pairs are left; these are compared by all bounds, and measured at once, as their bags are at hand.

Integers, prices, rates and coded nominal values have such gaps; values without them are left to `epsjoin`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

#: Values of a bag, on average, up to which bags move; cells along axes whose gaps are sought; bags of a part, and parts of a group, at most.
SMALL, CELLS, CROWDED, PARTS = 128, 100_000, 100_000, 12
#: Pairs that are compared without halving, and pairs that are measured together.
LEAF, PAIRS = 1 << 14, 1 << 17


def mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit words."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def held_values(held: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Instances of bags that are held as bytes, and where each bag begins and the last one ends."""
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    values = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(float).reshape(-1, dims)
    return values, (ends - ends[0]).astype(np.int64) // (8 * dims)


def _sound(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of bags that hold finite values only and are not empty, their sizes, their values one after another."""
    offsets, values = kernels.flat(column, dims)
    sizes = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values).all(axis=1))])
    fit = (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return np.flatnonzero(fit), sizes[fit], values[np.repeat(fit, sizes)]


def gaps(bags: DataFrame, dims: int, eps: float) -> tuple[list[np.ndarray], float] | None:
    """Where each axis is cut, a place in each gap, and eps with some slack; None where no gap was found or bags are large."""

    def run(batches):
        for batch in batches:
            _, sizes, values = _sound(batch.column(0), dims)
            for k in range(dims):
                v = np.sort(values[:, k])
                if len(v):
                    cell = np.floor(v / eps)
                    first = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k)), pa.array(cell[first]), pa.array(v[first]), pa.array(np.maximum.reduceat(v, first)), pa.array(np.diff(np.append(first, len(v)))), pa.array(np.eye(1, len(first), dtype=np.int64)[0] * len(sizes))], names=["axis", "cell", "low", "high", "rows", "bags"])

    rows = bags.select("instances").mapInArrow(run, "axis long, cell double, low double, high double, rows long, bags long")
    found = rows.groupBy("axis", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"), F.sum("bags").alias("bags")).limit(CELLS + 1).toArrow()
    n = sum(found.column("bags").to_pylist())
    if not n or found.num_rows > CELLS or sum(found.column("rows").to_pylist()) * dims > SMALL * n:
        return None
    axis, low, high = (found.column(c).to_numpy() for c in ("axis", "low", "high"))
    wide = eps * (1 + 1e-9) + 1e-9 * max(np.abs(low).max(), np.abs(high).max())
    cuts = []
    for k in range(dims):
        at = np.flatnonzero(axis == k)
        at = at[np.argsort(low[at])]
        ends, begins = high[at][:-1], low[at][1:]
        cuts.append(((ends + begins) / 2)[begins - ends > wide * (1 + 1e-6)])
    return (cuts, wide) if any(len(c) for c in cuts) else None


def _regions(values: np.ndarray, bag: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of instances by bag and region, where each bag's instances of a region begin in it, and the regions there."""
    region = np.zeros(len(values), np.uint64)
    for k, cut in enumerate(cuts):
        if len(cut):
            region = mixed(region ^ np.searchsorted(cut, values[:, k]).astype(np.uint64))
    order = np.lexsort((region, bag))
    region, bag = region[order], bag[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(bag) != 0) | (region[1:] != region[:-1])]))
    return order, first, region[first]


def keyed(bags: DataFrame, dims: int, cuts: list[np.ndarray]) -> DataFrame:
    """pos, n, sign and regions, which stand for the regions that a bag occupies, and its values as bytes."""

    def run(batches):
        for batch in batches:
            taken, sizes, values = _sound(batch.column(2), dims)
            if not len(taken):
                continue
            _, first, region = _regions(values, bag := np.repeat(np.arange(len(sizes)), sizes), cuts)
            of = bag[first]
            count = np.bincount(of, minlength=len(sizes))
            sign = np.add.reduceat(mixed(region), np.cumsum(count) - count)
            ends = np.concatenate([[0], np.cumsum(sizes) * 8 * dims]).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at := pa.array(taken)), batch.column(1).take(at), pa.array(sign.view(np.int64)), pa.array(count), held], names=["pos", "n", "sign", "regions", "bag"])

    n = F.col("n") if "n" in bags.columns else F.lit(1)
    return bags.select("pos", n.cast("long").alias("n"), "instances").mapInArrow(run, "pos long, n long, sign long, regions long, bag binary")


def joined(a: DataFrame, b: DataFrame | None, dims: int, eps: float, found: tuple[list[np.ndarray], float]) -> DataFrame | None:
    """(pos_a, pos_b, dist, n_a, n_b, part) of keyed bags within eps; without b: of bags of a, with pos_a < pos_b. None where a group is too large to be dealt out."""
    cuts, wide = found
    group = ["sign", "regions"]
    every = a if b is None else a.union(b)
    crowds = every.groupBy(group).count().where(F.col("count") > CROWDED).select(*group, F.ceil(F.col("count") / CROWDED).cast("int").alias("parts")).toArrow()
    if crowds.num_rows and max(crowds.column("parts").to_pylist()) > PARTS:
        return None
    rows = ["pos", "n", "bag"]
    if b is None:
        whole = a.select(*group, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), *rows)
    else:
        whole = a.select(*group, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), *rows).union(b.select(*group, F.lit(0), F.lit(0), F.lit(0), *rows))
    if crowds.num_rows:
        parts = F.broadcast(a.sparkSession.createDataFrame(crowds.to_pandas(), "sign long, regions long, parts int"))
        own, others = F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        dealt = [t.join(parts, group).withColumn("own", own).select("*", others) for t in (a, a if b is None else b)]
        left = dealt[0].select(*group, F.col("own").alias("i"), F.col("other").alias("j"), F.lit(1).alias("side"), *rows)
        right = dealt[1].select(*group, F.col("other").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side"), *rows)
        whole = whole.join(parts.drop("parts"), group, "left_anti").union(left).union(right)
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*group, "i", "j"]
    sorted_rows = whole.repartition(tasks, *key).sortWithinPartitions(*key)
    return sorted_rows.mapInArrow(_worker(dims, eps, cuts, wide, b is None), "pos_a long, pos_b long, dist double, n_a long, n_b long, part long")


def reached(bounds: np.ndarray, left: np.ndarray, right: np.ndarray, wide: float, once: bool):
    """Blocks of pairs (of left, of right) whose bounds (a row for each) differ by at most wide everywhere. once: only those in order."""
    stack = [(left, right)]
    while stack:
        left, right = stack.pop()
        if once and len(left):
            right = right[right > left.min()]
        if not len(left) or not len(right):
            continue
        x = bounds[:, left]
        low = x.min(axis=1)
        spread = x.max(axis=1) - low
        if len(left) * len(right) > LEAF and len(left) > 1:
            k = int(spread.argmax())
            if spread[k] > 0:
                v = x[k]
                cut = np.partition(v, len(v) // 2)[len(v) // 2]
                lower = v < cut if cut > low[k] else v <= cut
                r = bounds[k, right]
                for part in (lower, ~lower):
                    own = v[part]
                    stack.append((left[part], right[(r >= own.min() - wide) & (r <= own.max() + wide)]))
                continue
        order = np.argsort(-spread)
        step = max(1, PAIRS // len(right))
        for begin in range(0, len(left), step):
            some = slice(begin, begin + step)
            fits = left[some, None] < right if once else np.ones((len(left[some]), len(right)), bool)
            for k in order[:3]:
                fits &= np.abs(x[k, some, None] - bounds[k, right]) <= wide
            i, j = np.nonzero(fits)
            if len(i):
                i, j = left[some][i], right[j]
                near = (np.abs(bounds[:, i] - bounds[:, j]) <= wide).all(axis=0)
                yield i[near], j[near]


def _worker(dims: int, eps: float, cuts: list[np.ndarray], wide: float, once: bool):
    names = ["pos_a", "pos_b", "dist", "n_a", "n_b", "part"]

    def group(rows: pa.Table):
        sign = rows.column(0)[0].as_py()
        side, pos, n = (rows.column(k).to_numpy() for k in (4, 5, 6))
        held = rows.column(7).combine_chunks()
        values, ends = held_values(held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks), dims)
        sizes, starts = np.diff(ends), ends[:-1]
        order, first, _ = _regions(values, np.repeat(np.arange(len(sizes)), sizes), cuts)
        inside = values[order]
        bounds = [f.reduceat(inside, first, axis=0).reshape(len(sizes), -1) for f in (np.minimum, np.maximum)]
        bounds = np.concatenate(bounds if len(first) < len(values) else bounds[:1], axis=1).T
        spread = bounds.max(axis=1) - bounds.min(axis=1)
        bounds = np.ascontiguousarray(bounds[spread > 0] if (spread > 0).any() else bounds[:1])
        whole = once and side[0] == 2  # both sides are the same bags: pairs in the order of the bound that is spread most
        if whole:
            left = right = by = np.argsort(bounds[spread[spread > 0].argmax() if (spread > 0).any() else 0], kind="stable")
            bounds, left, right = np.ascontiguousarray(bounds[:, by]), np.arange(len(by)), np.arange(len(by))
        else:
            left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)

        def measured(found):
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            if whole:
                i, j = by[i], by[j]
                i, j = np.where(pos[i] < pos[j], i, j), np.where(pos[i] < pos[j], j, i)
            elif once:
                fits = pos[i] < pos[j]
                i, j = i[fits], j[fits]
            for begin in range(0, len(i), PAIRS):
                x, y = i[begin : begin + PAIRS], j[begin : begin + PAIRS]
                one, two = (starts[x], sizes[x], values), (starts[y], sizes[y], values)
                dist = np.sqrt(np.maximum(kernels._directed(*one, *two), kernels._directed(*two, *one)))
                near = dist <= eps
                x, y = x[near], y[near]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (pos[x], pos[y], dist[near], n[x], n[y], np.full(len(x), sign))], names=names)

        waiting, size = [], 0
        for found in reached(bounds, left, right, wide, whole):
            waiting.append(found)
            size += len(found[0])
            if size >= PAIRS:
                yield from measured(waiting)
                waiting, size = [], 0
        if waiting:
            yield from measured(waiting)

    def run(batches):
        waiting, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(k).to_numpy() for k in range(4)])
            begins = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1), len(key)]
            for begin, end in zip(begins, begins[1:], strict=False):
                if waiting and tuple(key[begin]) != last:
                    yield from group(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(batch.slice(begin, end - begin))
                last = tuple(key[begin])
        if waiting:
            yield from group(pa.Table.from_batches(waiting))

    return run
