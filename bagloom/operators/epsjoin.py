"""Pairs of bags within a distance, without comparing all pairs.

Let f be the coordinate along any unit vector. If the Hausdorff distance of two bags is at most eps, each value of f in
one bag has a value of the other within eps. So the minima of f differ by at most eps, and so do the maxima; and if
the line is cut into short cells, the cells that one bag occupies lie among those that the other's values reach. Both
are kept for the axes (up to COMPARED) and some random directions: bounds as numbers, occupied and reached cells as
64-bit words (cells that are 64 apart share a bit, which only adds candidates).

1. Cells. Bounds are cut into cells of one and a half eps, each time the one that leaves the fewest pairs in common
   cells, by counting, until cells are small or enough bounds are cut. A left bag stands in its own cell, a right bag in each cell within eps of it,
   so a pair meets once. Cells with very many right bags are dealt into parts, with their left bags in each part.
2. Sweep. Cells are dealt over tasks, sorted there by a further bound, and bags within eps of each other's bound are
   compared by their words, in blocks of bounded size. No bag is moved so far, only numbers.
3. Distance. The pairs that are left fetch their bags, and one kernel measures batches of pairs.

Bounds are widened by a relative 1e-9 against rounding. Bags that are empty or hold a value that is no finite number
have no neighbours and leave early. Where values leave gaps, `gapjoin` takes over. The bounds hold for the Hausdorff distance; other metrics compare all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import vectors as V
from ..storage import keep
from . import gapjoin

#: Axes and random directions that are compared, the width of a cell in eps, coordinates that are cut at most.
COMPARED, DIRECTIONS, CELL, COORDINATES = 16, 5, 1.5, 3
#: Bags that a bag meets in its cell, on average, above which one more coordinate is cut; right bags of a cell's part.
BUSY, CROWDED = 500, 50_000
#: Boxes up to which one task chooses the coordinates to cut.
FEW = 500_000
#: Rows that a task sweeps together, and pairs that it holds at once.
ROWS, PAIRS = 200_000, 1 << 17


def dimensions(bags: DataFrame) -> int:
    """The number of dimensions; all instances must have the same."""
    found = bags.select(F.explode("instances").alias("p")).agg(F.min(F.size("p")).alias("least"), F.max(F.size("p")).alias("most")).first()
    if found.most is None:
        return 0
    if found.least != found.most:
        raise ValueError(f"instances have {found.least} to {found.most} dimensions")
    return found.most


def directions(dims: int) -> np.ndarray:
    """Unit vectors, a row each: from two dimensions on random ones, which tell more apart, and the axes."""
    axes = np.eye(dims)[:COMPARED]
    if dims < 2:
        return axes
    drawn = np.random.default_rng(1).normal(size=(DIRECTIONS, dims))
    return np.vstack([drawn / np.linalg.norm(drawn, axis=1, keepdims=True), axes])


def _words(along: np.ndarray, reach: np.ndarray, starts: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Occupied and reached cells of each bag, whose values of one direction begin at starts."""
    one = np.uint64(1)
    bit = lambda cell: one << np.mod(cell, 64).astype(np.uint64)
    first, last = np.floor((along - reach) / width), np.floor((along + reach) / width)
    reached = np.where(last - first >= 63, ~np.uint64(0), np.uint64(0))
    for step in range(int(min(63, (last - first).max(initial=0))) + 1):
        reached |= np.where(first + step <= last, bit(first + step), np.uint64(0))
    return np.bitwise_or.reduceat(bit(np.floor(along / width)), starts), np.bitwise_or.reduceat(reached, starts)


def _boxed(bags: DataFrame, dims: int, eps: float, gaps: list[np.ndarray] | None = None) -> DataFrame:
    """pos, bag; c0, c1, ...: least and greatest value of each direction; w and r: occupied and reached cells; written, so that they are computed once. gaps: keys by the regions between these instead."""
    if gaps is not None:
        return keep(gapjoin.keyed(bags, dims, gaps), "keyed")
    along_of = directions(dims)
    n = len(along_of)
    names = ["pos", "bag", *(f"c{k}" for k in range(2 * n)), *(f"w{k}" for k in range(n)), *(f"r{k}" for k in range(n))]

    def boxes(batches):
        for batch in batches:
            offsets, values = kernels.flat(batch.column(1), dims)
            sizes = np.diff(offsets)
            finite = np.concatenate([[0], np.cumsum(~np.isfinite(values).all(axis=1))])
            sound = np.flatnonzero((sizes > 0) & (finite[offsets[1:]] == finite[offsets[:-1]]))
            if not len(sound):
                continue
            inside = np.repeat(np.isin(np.arange(len(sizes)), sound), sizes)
            values, sizes = values[inside], sizes[sound]
            starts = np.cumsum(sizes) - sizes
            along = values @ along_of.T
            reach = eps * (1 + 1e-9) + 1e-9 * np.abs(values).max(axis=1)
            bounds = [f.reduceat(along[:, k], starts) for k in range(n) for f in (np.minimum, np.maximum)]
            words = [_words(along[:, k], reach, starts, eps / 2) for k in range(n)]
            taken = pa.array(sound)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *(pa.array(b) for b in bounds), *(pa.array(w[i].view(np.int64)) for i in (0, 1) for w in words)], names=names)

    kinds = ["long", "array<array<double>>", *["double"] * (2 * n), *["long"] * (2 * n)]
    rows = bags.select("pos", "instances").repartition(_tasks(bags), "pos")  # little data, much work
    return keep(rows.mapInArrow(boxes, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True))), "boxes")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cell(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width)


def _cut(boxes: DataFrame, wide: float) -> tuple[list[str], str]:
    """The coordinates to cut, and the one to sweep along."""
    names = [c for c in boxes.columns if c[0] == "c"]
    width, chosen = CELL * wide, []
    while True:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _cell(c, width).alias("cell")) for c in names if c not in chosen])).alias("x")
        own = [_cell(c, width).alias(f"own_{c}") for c in chosen]
        counted = boxes.select(*own, cells).groupBy(*[f"own_{c}" for c in chosen], "x.c", "x.cell").count()
        best = counted.groupBy("c").agg(F.sum(F.col("count") * F.col("count").cast("double")).alias("pairs"), F.sum("count").alias("n")).orderBy("pairs", "c").first()
        if chosen and (len(chosen) == min(COORDINATES, len(names) - 1) or busy):
            return chosen, best.c
        chosen.append(best.c)
        busy = best.pairs <= BUSY * best.n
        if len(chosen) == len(names):
            return chosen, best.c


def _cut_few(boxes: DataFrame, wide: float) -> tuple[list[str], str]:
    """As `_cut`, in one task instead of a job for each coordinate."""
    names = [c for c in boxes.columns if c[0] == "c"]
    width = CELL * wide

    def run(batches):
        rows = [np.column_stack([column.to_numpy() for column in batch.columns]) for batch in batches if batch.num_rows]
        cells = np.floor(np.concatenate(rows) / width).astype(np.int64)
        own, chosen, busy = np.zeros(len(cells), np.int64), [], True
        while True:
            counted = []
            for k, c in enumerate(names):
                if c not in chosen:
                    _, place = np.unique(cells[:, k], return_inverse=True)
                    kinds, n = np.unique(own * (place.max() + 1) + place, return_counts=True)
                    counted.append((float((n.astype(float) ** 2).sum()), c))
            pairs, best = min(counted)
            if chosen and (len(chosen) == min(COORDINATES, len(names) - 1) or not busy):
                break
            chosen.append(best)
            busy = pairs > BUSY * len(cells)
            if len(chosen) == len(names):
                break
            _, place = np.unique(cells[:, names.index(best)], return_inverse=True)
            _, own = np.unique(own * (place.max() + 1) + place, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array([chosen]), pa.array([best])], names=["chosen", "sweep"])

    found = boxes.select(names).coalesce(1).mapInArrow(run, "chosen array<string>, sweep string").first()
    return found.chosen, found.sweep


def near(left: DataFrame, right: DataFrame, eps: float, dims: int, metric: str = "hausdorff") -> DataFrame:
    """(pos_a, pos_b, dist) of all pairs of a left and a right bag with dist <= eps."""
    if metric.lower() != "hausdorff":
        return _measured(blocked(left, right), dims, metric).where(F.col("dist") <= eps)
    if gaps := gapjoin.gaps(left.select("instances").union(right.select("instances")), dims, eps):
        found = gapjoin.joined(_boxed(left, dims, eps, gaps[0]), _boxed(right, dims, eps, gaps[0]), dims, eps, gaps)
        if found is not None:
            return found.select("pos_a", "pos_b", "dist")
    return _near(_boxed(left, dims, eps), _boxed(right, dims, eps), eps, dims)


def candidates(a: DataFrame, b: DataFrame, eps: float, once: bool = False) -> DataFrame:
    """(pos_a, pos_b) of boxes that may be within eps. once: of two sides that are the same bags, only pairs in order of position."""
    names = [c for c in a.columns if c[0] == "c"]
    found = a.agg(F.max(F.greatest(*[F.abs(c) for c in names], F.lit(0.0))).alias("greatest"), F.count("*").alias("n")).first()
    if found.n == 0 or not math.isfinite(found.greatest):
        return a.sparkSession.createDataFrame([], "pos_a long, pos_b long")
    wide = eps * (1 + 1e-9) + 1e-9 * found.greatest
    cut, sweep = ([], names[0]) if found.n <= BUSY else (_cut_few if found.n <= FEW else _cut)(a, wide)
    width = CELL * wide
    words = [c for c in a.columns if c[0] in "wr"]
    x, y = a, b
    for c in cut:
        x = x.withColumn(f"cell_{c}", _cell(c, width))
        y = y.withColumn(f"cell_{c}", F.explode(F.sequence(F.floor((F.col(c) - wide * (1 + 1e-6)) / width), F.floor((F.col(c) + wide * (1 + 1e-6)) / width))))
    # a hash stands for a cell; two cells of one bag with one hash, which would give a pair twice, are out of reach
    x, y = (t.select(F.xxhash64(F.lit(0), *[f"cell_{c}" for c in cut]).alias("cell"), "pos", F.col(sweep).alias("s"), *words) for t in (x, y))
    crowds = keep(y.groupBy("cell").count().where(F.col("count") > CROWDED).select("cell", F.ceil(F.col("count") / CROWDED).cast("int").alias("parts")), "crowds") if cut or not once else None
    if crowds is None or crowds.isEmpty():
        x, y = x.withColumn("part", F.lit(0)), y.withColumn("part", F.lit(0))
    else:
        x = x.join(crowds, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
        y = y.join(crowds, "cell", "left").withColumn("part", F.pmod(F.xxhash64("pos"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    columns = ["cell", "part", "side", "s", "pos", *words]
    both = y.withColumn("side", F.lit(0)).select(columns).union(x.withColumn("side", F.lit(1)).select(columns))
    dealt = both.repartition(_tasks(a), "cell", "part").sortWithinPartitions("cell", "part", "side", "s")
    return dealt.mapInArrow(_sweeper(wide, once), "pos_a long, pos_b long")


def _sweeper(wide: float, once: bool):
    """Rows sorted by cell, part, side and sweep give candidate pairs."""

    def swept(right: list[np.ndarray], left: list[np.ndarray]):
        """Columns: group, sweep, pos, words. Both sides are sorted by group and sweep."""
        if not len(right[0]) or not len(left[0]):
            return
        low = min(right[1].min(), left[1].min())
        span = max(right[1].max(), left[1].max()) - low + wide
        place = lambda t, by: 2.0 * t[0] + (t[1] - low + by) / span
        slack = wide + 1e-9 * span
        ordered = place(right, 0)
        first = np.maximum(np.searchsorted(ordered, place(left, -slack)), np.searchsorted(right[0], left[0]))
        last = np.minimum(np.searchsorted(ordered, place(left, slack), side="right"), np.searchsorted(right[0], left[0], side="right"))
        n = np.maximum(0, last - first)
        done = np.concatenate([[0], np.cumsum(n)])
        half = (len(right) - 3) // 2
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(done, done[start] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(start, stop), n[start:stop])
            j = np.arange(len(i)) + np.repeat(first[start:stop] - (done[start:stop] - done[start]), n[start:stop])
            if once:
                fits = left[2][i] < right[2][j]
                i, j = i[fits], j[fits]
            for k in range(3, 3 + half):
                fits = ((left[k][i] & ~right[k + half][j]) | (right[k][j] & ~left[k + half][i])) == 0
                i, j = i[fits], j[fits]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(left[2][i]), pa.array(right[2][j])], names=["pos_a", "pos_b"])
            start = stop

    def columns_of(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        c = [rows.column(k).to_numpy() for k in range(rows.num_columns)]
        group = np.cumsum(np.concatenate([[0], (np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)]))
        return c[2] == 1, [group, *c[3:]]

    def work(rows: pa.Table):
        is_left, c = columns_of(rows)
        yield from swept([v[~is_left] for v in c], [v[is_left] for v in c])

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks()
            is_left, c = columns_of(rows)
            begins = int(np.searchsorted(c[0], c[0][-1]))  # the last cell may go on: its right side waits, its left side is done with
            rest = rows.slice(begins)
            yield from work(rows.slice(0, begins))
            if is_left[-1]:
                yield from work(rest)
                rest = rest.slice(0, int((~is_left[begins:]).sum()))
            waiting, size = rest.to_batches(), 0
        if waiting:
            rows = pa.Table.from_batches(waiting)
            if rows.num_rows:
                yield from work(rows.combine_chunks())

    return run


def _near(a: DataFrame, b: DataFrame, eps: float, dims: int, once: bool = False) -> DataFrame:
    pairs = candidates(a, b, eps, once)
    bags = [t.select(F.col("pos").alias(f"pos_{side}"), F.col("bag").alias(f"bag_{side}")) for t, side in ((a, "a"), (b, "b"))]
    fetched = pairs.join(bags[0], "pos_a").join(bags[1], "pos_b").select("pos_a", "pos_b", "bag_a", "bag_b")
    return _measured(fetched, dims, "hausdorff").where(F.col("dist") <= eps)


def _measured(pairs: DataFrame, dims: int, metric: str) -> DataFrame:
    """Pairs with their bags (x, y, bag of x, bag of y) as (x, y, dist)."""
    x, y, a, b = pairs.columns
    if metric.lower() == "hausdorff":
        return kernels.with_distance(pairs, dims)
    return pairs.select(x, y, V.metric(metric)(F.col(a), F.col(b), dims).alias("dist"))


def links(bags: DataFrame, eps: float, dims: int | None = None, metric: str = "hausdorff") -> DataFrame:
    """(a, b, dist) with a < b of all pairs of one set within eps; of classes perhaps also their sizes n_a, n_b and part; those of different parts share no class."""
    dims = dims or dimensions(bags)
    if dims == 0:
        return bags.sparkSession.createDataFrame([], "a long, b long, dist double")
    if metric.lower() != "hausdorff":
        return all_pairs(bags, dims, metric).where(F.col("dist") <= eps)
    if gaps := gapjoin.gaps(bags, dims, eps):
        found = gapjoin.joined(_boxed(bags, dims, eps, gaps[0]), None, dims, eps, gaps)
        if found is not None:
            return found.toDF("a", "b", "dist", "n_a", "n_b", "part") if "n" in bags.columns else found.select(F.col("pos_a").alias("a"), F.col("pos_b").alias("b"), "dist")
    boxes = _boxed(bags, dims, eps)
    found = _near(boxes, boxes, eps, dims, once=True)
    return found.select(F.col("pos_a").alias("a"), F.col("pos_b").alias("b"), "dist")


def blocked(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pos_a, pos_b, bag_a, bag_b) of all pairs of a left and a right bag.

    Both sides are dealt into blocks by a hash, and a task gets a pair of blocks, so the pairs of a join of equals are spread
    evenly; a bag moves once for each block of the other side."""
    blocks = max(1, math.isqrt(2 * _tasks(left)))
    own, every = F.pmod(F.xxhash64("pos"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    x = left.select(F.col("pos").alias("pos_a"), F.col("instances").alias("bag_a"), own.alias("own"), every).select("pos_a", "bag_a", F.col("own").cast("int").alias("i"), F.col("other").alias("j"))
    y = right.select(F.col("pos").alias("pos_b"), F.col("instances").alias("bag_b"), own.alias("own"), every).select("pos_b", "bag_b", F.col("other").alias("i"), F.col("own").cast("int").alias("j"))
    return x.join(y, ["i", "j"]).select("pos_a", "pos_b", "bag_a", "bag_b")


def all_pairs(bags: DataFrame, dims: int | None = None, metric: str = "hausdorff") -> DataFrame:
    """(a, b, dist) with a < b of all pairs, as a distance matrix in long form; quadratic, for few bags."""
    dims = dims or dimensions(bags)
    pairs = blocked(bags, bags).where("pos_a < pos_b").select(F.col("pos_a").alias("a"), F.col("pos_b").alias("b"), "bag_a", "bag_b")
    return _measured(pairs, dims, metric)
