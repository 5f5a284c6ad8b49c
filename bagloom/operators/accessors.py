"""Access to bags and instances: items, sizes, labels, membership, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that count as positive and as negative.
POSITIVE, NEGATIVE = ("1", "positive", "pos", "true"), ("0", "negative", "neg", "false")


def positive(bags: DataFrame) -> DataFrame:
    return bags.where(F.col("label").isin(*POSITIVE))


def negative(bags: DataFrame) -> DataFrame:
    return bags.where(F.col("label").isin(*NEGATIVE))


def bag_at(bags: DataFrame, pos: int) -> DataFrame:
    if pos < 0:
        raise IndexError(pos)
    return bags.where(F.col("pos") == pos)


def instance_at(instances: Column, i: int) -> Column:
    """The i-th instance; outside raises, negatives too."""
    return F.when((F.lit(i) >= 0) & (F.lit(i) < F.size(instances)), F.get(instances, i)).otherwise(F.raise_error(F.lit(f"index {i} out of range")).cast("array<double>"))


def value_at(vector: Column, k: int) -> Column:
    """The k-th value; negatives count from the end."""
    return F.element_at(vector, k + 1 if k >= 0 else k)


def unnested(bags: DataFrame) -> DataFrame:
    return bags.select("pos", "bag_id", "label", F.posexplode("instances").alias("inst_idx", "features"))


def appended(instances: Column, vector: Column) -> Column:
    return F.array_append(instances, vector)


def contains(instances: Column, vector: Column) -> Column:
    return F.array_contains(instances, vector)


def relabelled(bags: DataFrame, label: Column) -> DataFrame:
    return bags.withColumn("label", label.cast("string"))


def with_weight(instances: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    return instances.withColumn("weight", weight if isinstance(weight, Column) else F.lit(float(weight)))


def fits_type(value: Column, attr_type: str, domain: list[str] | None = None) -> Column:
    """Whether the text of a value is valid for a type: integer, real, nominal of a domain; others take all."""
    kind = attr_type.strip().lower()
    if kind in ("integer", "int"):
        return F.coalesce(value.try_cast("long").isNotNull() & ~value.contains("."), F.lit(False))
    if kind in ("real", "numeric", "float", "double"):
        return F.coalesce(value.try_cast("double").isNotNull() & ~value.rlike(r"[0-9.][fFdD]\s*$"), F.lit(False))  # Java reads 1F as a number
    if kind == "nominal":
        return F.coalesce(value.isin(*(domain or [])), F.lit(False))
    return value.isNotNull()


def totals(bags: DataFrame) -> DataFrame:
    """One row: bags, instances, positive and negative bags."""
    return bags.agg(F.count("*").alias("bags"), F.coalesce(F.sum(F.size("instances")), F.lit(0)).cast("long").alias("instances"), F.count_if(F.col("label").isin(*POSITIVE)).alias("positive"), F.count_if(F.col("label").isin(*NEGATIVE)).alias("negative"))
