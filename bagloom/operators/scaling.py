"""Scaling of instance values: fitted on one set of bags, applied to any of the same schema.

Bags are given as a table or as a dataset with attributes. A dataset's attributes say which dimensions are numbers, and
only those are scaled; another dataset must have as many attributes of the same types, in order, whatever their names.
Of tables, each instance must have the fitted number of dimensions: others raise when they are read.

The statistics are one row of arrays. Values of a constant dimension map to the lower bound (min-max) or to 0
(z-score). The deviation is that of the population. NaN values (missing, or no numbers) are left out of the statistics
and stay."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import vectors as V


class NotFitted(RuntimeError):
    pass


def _values(bags: DataFrame) -> DataFrame:
    return bags.select(F.explode("instances").alias("p")).select(F.posexplode("p").alias("dim", "v"))


def dimension_stats(bags: DataFrame) -> DataFrame:
    """Per dimension: minimum, maximum, range (1 if none), mean, population deviation (1 if none)."""
    found = _values(bags).where(~F.isnan("v")).groupBy("dim").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    whole = F.col("high") - F.col("low")
    return found.select("dim", "low", "high", F.when(whole == 0, 1.0).otherwise(whole).alias("range"), "mean", F.when(F.col("low") == F.col("high"), 1.0).otherwise(F.col("std")).alias("std"))


@dataclass
class Scaler:
    """Base: `fit` gathers the dimensions' statistics, `transform` and `inverse` are projections."""

    numeric: list[int] | None = None
    stats: list | None = None
    types: list[str] | None = None

    def fit(self, data):
        bags = getattr(data, "bags", data)
        if attributes := getattr(data, "attributes", None):
            self.types = [a.attr_type for a in attributes]
            if self.numeric is None:
                self.numeric = data.numeric_dimensions
        by_dim = {r.dim: r for r in dimension_stats(bags).collect()}
        width = bags.agg(F.max(F.array_max(F.transform("instances", lambda p: F.size(p)))).alias("w")).first().w
        if not width:
            raise ValueError("no instances to fit a scaler on")
        nothing = Row(dim=0, low=0.0, high=0.0, range=1.0, mean=0.0, std=1.0)  # a dimension without any number
        self.stats = [by_dim.get(k, nothing) for k in range(width)]
        return self

    def fit_transform(self, data):
        return self.fit(data).transform(data)

    @property
    def numeric_dimensions(self) -> list[int]:
        self._fitted()
        return self.numeric if self.numeric is not None else list(range(len(self.stats)))

    def _fitted(self) -> None:
        if self.stats is None:
            raise NotFitted("fit the scaler first")

    def _mapped(self, data, f, mark: str):
        """f gets the value and a function that gives a statistic of the value's dimension."""
        self._fitted()
        if attributes := getattr(data, "attributes", None):
            types = [a.attr_type for a in attributes]
            if len(types) != len(self.stats) or self.types and types != self.types:
                raise ValueError(f"fitted on attributes {self.types or len(self.stats)}, not on {types}")
            return replace(data, name=data.name + mark, bags=self._mapped(data.bags, f, mark))
        chosen, width = set(self.numeric_dimensions), len(self.stats)

        def one(v, i):
            stat = lambda name: F.get(F.array(*[F.lit(float(getattr(r, name))) for r in self.stats]), i)
            whole = f(v, stat)
            return whole if len(chosen) == width else F.when(F.get(F.array(*[F.lit(k in chosen) for k in range(width)]), i), whole).otherwise(v)

        other = F.raise_error(F.lit(f"the scaler was fitted on {width} dimensions, but an instance has another number")).cast("array<array<double>>")
        checked = F.when(F.exists("instances", lambda p: F.size(p) != width), other).otherwise(F.col("instances"))
        return data.withColumn("instances", V.mapped(checked, one))


@dataclass
class MinMax(Scaler):
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self) -> None:
        if not self.low < self.high:
            raise ValueError("the lower bound must be below the upper bound")

    def transform(self, data):
        return self._mapped(data, lambda v, s: (v - s("low")) / s("range") * (self.high - self.low) + self.low, "_transformed")

    def inverse(self, data):
        return self._mapped(data, lambda v, s: (v - self.low) / (self.high - self.low) * s("range") + s("low"), "_restored")


@dataclass
class ZScore(Scaler):
    def transform(self, data):
        return self._mapped(data, lambda v, s: (v - s("mean")) / s("std"), "_transformed")

    def inverse(self, data):
        return self._mapped(data, lambda v, s: v * s("std") + s("mean"), "_restored")
