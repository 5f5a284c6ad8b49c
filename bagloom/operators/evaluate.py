"""Clusters mapped to classes by majority vote, and binary metrics of the mapped classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_class(label: Column) -> Column:
    """Labels as whole numbers: '1', '1.0' and 1.9 are 1; what is no number raises."""
    return label.cast("double").cast("int")


def labelled(assignments: DataFrame, bags: DataFrame) -> DataFrame:
    """(pos, cluster_id, truth) of assigned bags that have a label."""
    return assignments.select("pos", "cluster_id").join(bags.select("pos", as_class(F.col("label")).alias("truth")).where("truth is not null"), "pos")


def class_map(found: DataFrame) -> DataFrame:
    """cluster_id and its most frequent class, the lesser at a tie; noise counts as a cluster."""
    return found.groupBy("cluster_id").agg(F.mode("truth", True).alias("class_id"))


def confusion(found: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp. Classes other than 0 and 1 raise."""
    mapped = found.join(class_map(found), "cluster_id")
    truth = F.when(F.col("truth").isin(0, 1), F.col("truth")).otherwise(F.raise_error(F.lit("classes must be 0 or 1")).cast("int"))
    both = mapped.select(truth.alias("t"), F.col("class_id").alias("p"))
    return both.agg(*[F.count_if((F.col("t") == t) & (F.col("p") == p)).alias(name) for name, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def metrics(found: DataFrame) -> DataFrame:
    """One row: precision, recall, f1, specificity (0 where nothing is to divide by) and the counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(found).select(_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tn, tn + fp).alias("specificity"), "tn", "fp", "fn", "tp")


def report(found: DataFrame) -> str:
    """The metrics, counts and class map as text."""
    m = metrics(found).first()
    lines = [f"{k:<12}{m[k]:.4f}" for k in ("precision", "recall", "f1", "specificity")]
    lines += [f"{k:<12}{m[k]}" for k in ("tn", "fp", "fn", "tp")]
    return "\n".join(lines + [f"cluster {r.cluster_id} -> class {r.class_id}" for r in class_map(found).orderBy("cluster_id").collect()])


def interpretation(clusters: Column, f1: Column) -> Column:
    """What a number of clusters and an F1 say of a parameter choice."""
    return F.when((clusters == 2) & (f1 > 0.8), "excellent").when(clusters > 2, "over-segmented").when(clusters == 1, "under-segmented").when(clusters == 0, "all noise").otherwise("poor")
