"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of our own if all tasks run on this machine (tests); on a cluster that raises."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="bagloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back: lineage ends here, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bagloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
