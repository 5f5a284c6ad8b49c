"""Distances between bags that are too large for one row: bags in parts.

A bag is given as rows (pos, features), one for each instance. It is cut into parts of about PART instances; pairs of
parts are dealt evenly over tasks; what they give is put together by minima and maxima. Nothing holds a whole bag, so
one bag may have most of all instances. All pairs of bags are compared, so this is for few bags of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..storage import keep
from .epsjoin import blocked

#: Instances in a part, and values that a task holds at once when it compares two parts.
PART, CELLS = 512, 1 << 20


def in_parts(rows: DataFrame) -> DataFrame:
    """(pos, bag, instances): parts with numbers of their own, the bag that each is of, and its instances in order."""
    sizes = rows.groupBy("pos").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = rows.join(sizes, "pos").select("pos", F.pmod(F.xxhash64("features"), "parts").alias("part"), "features")
    made = dealt.groupBy("pos", "part").agg(F.sort_array(F.collect_list("features")).alias("instances"))
    return keep(made.select(F.xxhash64("pos", "part").alias("pos"), F.col("pos").alias("bag"), "instances"), "parts")


def _pairs(parts: DataFrame) -> DataFrame:
    """Pairs of parts (a, b, part_a, part_b, x, y) of bags a < b."""
    of = [parts.select(F.col("pos").alias(f"pos_{s}"), F.col("bag").alias(s)) for s in "ab"]
    both = blocked(parts, parts).join(of[0], "pos_a").join(of[1], "pos_b").where("a < b")
    return both.select("a", "b", F.col("pos_a").alias("part_a"), F.col("pos_b").alias("part_b"), F.col("bag_a").alias("x"), F.col("bag_b").alias("y"))


def _squares(x: np.ndarray, y: np.ndarray):
    """Squared distances of some rows of x and all of y, in order."""
    step = max(1, CELLS // max(1, y.size))
    for a in range(0, len(x), step):
        yield ((x[a : a + step, None, :] - y[None, :, :]) ** 2).sum(axis=2)


def _compared(pairs: DataFrame, dims: int, schema: str, f) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            (x_at, x), (y_at, y) = kernels.flat(batch.column(4), dims), kernels.flat(batch.column(5), dims)
            rows = [r for i, head in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)) for r in f(head, x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return pairs.mapInArrow(run, schema)


def directed(rows: DataFrame, dims: int) -> DataFrame:
    """(a, b, dist) of all ordered pairs of bags: the greatest distance from an instance of a to its nearest of b; NaN if either holds NaN."""

    def nearest(head, x, y):
        a, b, part_a, part_b = head
        parts = [(s.min(axis=1), s.min(axis=0)) for s in _squares(x, y)]
        bad = bool(np.isnan(x).any() or np.isnan(y).any())
        yield a, b, part_a, np.concatenate([p for p, _ in parts]), bad
        yield b, a, part_b, np.min([q for _, q in parts], axis=0), bad

    found = _compared(_pairs(in_parts(rows)), dims, "a long, b long, part long, squares array<double>, bad boolean", nearest)
    least = found.select("a", "b", "part", "bad", F.posexplode("squares").alias("i", "s")).groupBy("a", "b", "part", "i").agg(F.min("s").alias("s"), F.max("bad").alias("bad"))
    return least.groupBy("a", "b").agg(F.when(F.max("bad"), F.lit(float("nan"))).otherwise(F.sqrt(F.max("s"))).alias("dist"))


def hausdorff(rows: DataFrame, dims: int) -> DataFrame:
    """(a, b, dist) with a < b: the greater of both directed distances."""
    return directed(rows, dims).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("dist").alias("dist"))


def extremes(rows: DataFrame, dims: int) -> DataFrame:
    """(a, b, least, most) with a < b: distances of the nearest and of the farthest pair of instances."""

    def both(head, x, y):
        found = [(s.min(), s.max()) for s in _squares(x, y)]
        yield head[0], head[1], min(f[0] for f in found), max(f[1] for f in found)

    found = _compared(_pairs(in_parts(rows)), dims, "a long, b long, least double, most double", both)
    return found.groupBy("a", "b").agg(F.sqrt(F.min("least")).alias("least"), F.sqrt(F.max("most")).alias("most"))
