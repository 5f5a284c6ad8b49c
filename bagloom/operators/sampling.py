"""Splits of bags into training and test sets of exact size."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import with_rank

#: Bags up to which the seeded permutation of the driver is offered.
MOST_SHUFFLED = 2_000_000


def cut_of(n: int, percent: float) -> int:
    return int(n * (percent / 100.0))


def exact_split(bags: DataFrame, percent: float, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """The split of Python's seeded shuffle over positions 0..n-1; positions are numbered anew in shuffled order."""
    n = bags.count()
    if n > MOST_SHUFFLED:
        raise ValueError(f"more than {MOST_SHUFFLED} bags: use hash_split")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    moved = bags.sparkSession.createDataFrame([(old, new) for new, old in enumerate(order)], "pos long, shuffled long")
    placed, cut = bags.join(moved, "pos"), cut_of(n, percent)
    rest = [c for c in bags.columns if c != "pos"]
    return (
        placed.where(F.col("shuffled") < cut).select(F.col("shuffled").alias("pos"), *rest),
        placed.where(F.col("shuffled") >= cut).select((F.col("shuffled") - cut).alias("pos"), *rest),
    )


def _hashed(seed: int):
    return F.struct(F.md5(F.concat("bag_id", F.lit(f":{seed}"))), "bag_id")


def hash_ranked(bags: DataFrame, seed: int = 1234) -> DataFrame:
    """bag_id with its place in the order of md5(bag_id:seed)."""
    return with_rank(bags.select("pos", "bag_id"), _hashed(seed), "place")


def hash_split(bags: DataFrame, percent: float, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """A split at any scale: by the order of a hash of the id. Positions stay."""
    ranked = with_rank(bags, _hashed(seed), "place")
    cut = cut_of(ranked.count(), percent)
    return tuple(ranked.where(part).select(*bags.columns) for part in (F.col("place") < cut, F.col("place") >= cut))
