"""A seeded synthetic dataset: two clouds of bags and some scattered ones."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .arff import Attribute, Dataset


def two_clouds(spark: SparkSession, seed: int = 42, per_cloud: int = 15, noise: int = 5, name: str = "two_clouds") -> Dataset:
    """Positive bags about (10, 10) and negative ones about (-10, -10) with 2 to 4 instances of deviation 1; scattered bags of 1 to 3 instances within 50 of the origin, labelled at random. Values have two decimals."""
    n = 2 * per_cloud + noise
    pos = F.col("id")
    drawn_from = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else F.lit(p) for p in parts])), 1, 12), 16, 10).cast("long")
    uniform = lambda salt: drawn_from(seed, salt, "id", "k") / F.lit(float(1 << 48))
    normal = lambda salt: F.sqrt(-2 * F.log(1 - uniform(salt))) * F.cos(2 * F.pi() * uniform(salt + 1))
    centre = F.when(pos < per_cloud, 10.0).otherwise(-10.0)
    scattered = pos >= 2 * per_cloud
    drawn = drawn_from(seed, 99, "id") % 3 + F.when(scattered, 1).otherwise(2)
    rows = spark.range(n).withColumn("size", drawn).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size").cast("int"))))
    value = lambda salt: F.round(F.when(scattered, uniform(salt) * 100 - 50).otherwise(centre + normal(salt)), 2)
    bags = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.array(value(1), value(5)).alias("p")))), lambda s: s["p"]).alias("instances"))
    chance = drawn_from(seed, 77, "id") % 2
    label = F.when(pos < per_cloud, "1").when(~scattered, "0").otherwise(chance.cast("string"))
    return Dataset(name, bags.select(pos.alias("pos"), F.concat(F.lit("bag_"), pos.cast("string")).alias("bag_id"), label.alias("label"), "instances"), [Attribute("x", "real"), Attribute("y", "real")])
