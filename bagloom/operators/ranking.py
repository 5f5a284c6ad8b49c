"""Positions in a global order without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep


def with_rank(df: DataFrame, by: Column | str, name: str = "rank") -> DataFrame:
    """Adds each row's 0-based place in ascending order of `by` (unique values).

    Rows are dealt into ranges and sorted there; only the number of rows of each range goes to the driver."""
    ranged = df.withColumn("_by", by if isinstance(by, Column) else F.col(by)).repartitionByRange("_by").sortWithinPartitions("_by")
    placed = keep(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        before[r.p] = total
        total += r["count"]
    if not before:
        return placed.drop("_by", "_id").withColumn(name, F.lit(0).cast("long"))
    starts = F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before) + 1)])
    return placed.withColumn(name, F.get(starts, part.cast("int")) + row).drop("_by", "_id")
