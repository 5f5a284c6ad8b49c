"""Bags as points of the plane: centroids, then centred PCA or, for few bags, t-SNE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .epsjoin import dimensions

#: Bags up to which t-SNE is offered; it compares all pairs on the driver.
MOST_TSNE = 2000


def centroids(bags: DataFrame, dims: int | None = None) -> DataFrame:
    """(pos, bag_id, centroid) of bags that are not empty."""
    dims = dims or dimensions(bags)
    return bags.where(F.size("instances") > 0).select("pos", "bag_id", V.centroid(F.col("instances"), dims).alias("centroid"))


def components_of(points: DataFrame, dims: int, k: int = 2) -> tuple[list[float], np.ndarray]:
    """Mean and first k principal directions of `centroid`. Each task adds up products of its points; only the sums are shuffled and gathered. Each direction's largest loading is positive."""
    at = [F.get("centroid", i) for i in range(dims)]
    means = points.agg(*[F.avg(a).alias(f"m{i}") for i, a in enumerate(at)]).first()
    mean = [m or 0.0 for m in means]

    def products(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(-1, dims) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dims), dims)), pa.array(np.tile(np.arange(dims), dims)), pa.array(total.ravel())], names=["i", "j", "s"])

    matrix = np.zeros((dims, dims))
    for r in points.select("centroid").mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        matrix[r.i, r.j] = r.s
    directions = np.linalg.eigh(matrix)[1][:, ::-1][:, :k]
    largest = np.abs(directions).argmax(axis=0)
    return mean, directions * np.sign(directions[largest, range(directions.shape[1])])


def pca(bags: DataFrame, dims: int | None = None) -> DataFrame:
    """(pos, bag_id, x, y)."""
    dims = dims or dimensions(bags)
    points = centroids(bags, dims)
    mean, directions = components_of(points, dims)

    def along(k: int):
        if k >= directions.shape[1]:
            return F.lit(0.0)
        return sum(((F.get("centroid", i) - mean[i]) * float(directions[i, k]) for i in range(dims)), F.lit(0.0))

    return points.select("pos", "bag_id", along(0).alias("x"), along(1).alias("y"))


def tsne(bags: DataFrame, dims: int | None = None, perplexity: float = 30.0, seed: int = 42, rounds: int = 500) -> DataFrame:
    """(pos, bag_id, x, y) by exact t-SNE for at most MOST_TSNE bags."""
    points = centroids(bags, dims).orderBy("pos").limit(MOST_TSNE + 1).collect()
    if len(points) > MOST_TSNE:
        raise ValueError(f"t-SNE takes at most {MOST_TSNE} bags")
    n = len(points)
    x = np.array([p.centroid for p in points], float).reshape(n, -1)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    if n > 2:
        perplexity = min(perplexity, n - 1)
        square = ((x[:, None] - x[None]) ** 2).sum(-1)
        p = np.zeros((n, n))
        for i in range(n):
            low, high = 1e-12, 1e12
            for _ in range(60):
                beta = (low * high) ** 0.5
                w = np.exp(np.minimum(0, -(square[i] - square[i][np.arange(n) != i].min()) * beta))
                w[i] = 0
                w /= w.sum()
                entropy = -(w[w > 0] * np.log(w[w > 0])).sum()
                low, high = (beta, high) if entropy > np.log(perplexity) else (low, beta)
            p[i] = w
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        step = np.zeros_like(y)
        for t in range(rounds):
            q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
            np.fill_diagonal(q, 0)
            force = ((12 if t < 100 else 1) * p - np.maximum(q / q.sum(), 1e-12)) * q
            grad = 4 * (force.sum(1)[:, None] * y - force @ y)
            step = (0.5 if t < 100 else 0.8) * step - max(n / 48, 10) * grad
            y = y + step
            y -= y.mean(0)
    rows = [(r.pos, r.bag_id, float(a), float(b)) for r, (a, b) in zip(points, y, strict=True)]
    return bags.sparkSession.createDataFrame(rows, "pos long, bag_id string, x double, y double")


def plot_table(bags: DataFrame, assignments: DataFrame, method: str = "pca") -> DataFrame:
    """(bag_id, cluster_id, x, y): what a scatter plot of clusters shows; bags without a cluster are left out."""
    placed = pca(bags) if method == "pca" else tsne(bags)
    return placed.join(assignments.select("pos", "cluster_id"), "pos").select("bag_id", "cluster_id", "x", "y")
