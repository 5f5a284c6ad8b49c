"""Bags from ordinary tables: rows are grouped by a key into instances.

The position of a bag is its key, which orders bags without sorting them anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table


def bags_of(rows: DataFrame, key: str, vector: list[Column], label: Column | None = None) -> DataFrame:
    """Canonical bags (pos, bag_id, label, instances). Instances are sorted by their values, so a bag is a function of its rows alone; groups are aggregated before the shuffle only in part, so a bag must fit a task."""
    made = rows.select(F.col(key).cast("long").alias("pos"), F.array(*[v.cast("double") for v in vector]).alias("p"), (F.lit(None).cast("string") if label is None else label.cast("string")).alias("label"))
    return made.groupBy("pos").agg(F.max("label").alias("label"), F.sort_array(F.collect_list("p")).alias("instances")).select("pos", F.col("pos").cast("string").alias("bag_id"), "label", "instances")


def _line() -> list[Column]:
    return [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5]


def _finished() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "1").otherwise("0")


def order_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as (pos, v0, v1, v2) and orders as (pos, label): what `order_bags` makes bags of."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.select(F.col("l_orderkey").cast("long").alias("pos"), *[v.cast("double").alias(f"v{k}") for k, v in enumerate(_line())])
    return rows, orders.select(F.col("o_orderkey").cast("long").alias("pos"), _finished().alias("label"))


def order_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bags of line items (quantity, discount and tax, scaled to 0-1); finished orders are positive."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    bags = bags_of(lines, "l_orderkey", _line()).drop("label")
    status = orders.select(F.col("o_orderkey").alias("pos"), _finished().alias("label"))
    return bags.join(status, "pos").select("pos", "bag_id", "label", "instances")


def customer_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bags of order totals; one market segment is positive."""
    bags = bags_of(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_totalprice") / 100000]).drop("label")
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.when(F.col("c_mktsegment") == "BUILDING", "1").otherwise("0").alias("label"))
    return bags.join(segment, "pos").select("pos", "bag_id", "label", "instances")


def nation_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as bags of their suppliers' balances; odd regions are positive."""
    bags = bags_of(table(spark, sf_dir, "supplier"), "s_nationkey", [F.col("s_acctbal") / 1000]).drop("label")
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), (F.col("n_regionkey") % 2).cast("string").alias("label"))
    return bags.join(region, "pos").select("pos", "bag_id", "label", "instances")


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, features): labels as bags of embeddings, a row for each instance, since a label may have any number."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("pos"), F.col("embedding").cast("array<double>").alias("features"))


def nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, features): nations as bags of their suppliers' balances, a row for each instance."""
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("pos"), F.array((F.col("s_acctbal") / 1000).cast("double")).alias("features")).join(known, "pos")
