"""Connected components of links that are spread over executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep


def _joined(batches):
    """All links (a, b) in one go: roots that are linked are hung under the lesser one until none are."""
    found = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not found:
        return
    ends = np.concatenate([np.concatenate(side) for side in zip(*found, strict=True)])
    nodes, at = np.unique(ends, return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "comp"])


#: Links that a task contracts together.
HELD = 1 << 20


def _contracted(batches):
    """Links (a, b) with the same components, of which a task keeps about one for each node: it is linked to the least node that the task's links reach."""
    waiting, size = [], 0

    def stars():
        for batch in _joined(iter(waiting)):
            far = pa.array(batch.column(0).to_numpy() != batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([c.filter(far) for c in batch.columns], names=["a", "b"])

    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= HELD:
            waiting = list(stars())
            size = sum(b.num_rows for b in waiting)
            if size > HELD // 2:
                yield from waiting
                waiting, size = [], 0
    yield from stars()


def components(links: DataFrame, alone: int = 0) -> DataFrame:
    """Rows (a, b) of links give rows (node, comp): the least node that each can reach.

    Tasks first contract the links that they read; where a column `part` is given, links of different parts share no node, and each
    part is contracted by one task. Each round takes the least label among neighbours and then the label of that label, so long chains halve.
    Labels are written to the shared folder after each round. A node with very many links is a skewed join key,
    which adaptive execution splits; labels of its neighbours meet as partial minima. Up to `alone` links, counted in both
    directions, are less work for one task than the rounds are for the cluster."""
    found = links.where("a <> b")
    if "part" in links.columns:
        found = found.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    fewer = keep(found.select("a", "b").mapInArrow(_contracted, "a long, b long"), "links")
    if alone and 2 * fewer.count() <= alone:
        return keep(fewer.coalesce(1).mapInArrow(_joined, "node long, comp long"), "labels")
    both = keep(fewer.union(fewer.select("b", "a")).distinct(), "links")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        nearer = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("to"))
        jumped = nearer.join(labels.select(F.col("node").alias("to"), F.col("comp").alias("beyond")), "to", "left")
        labels = keep(jumped.select("node", "old", F.least("to", F.coalesce("beyond", "to")).alias("comp")), "labels")
        if labels.where("comp <> old").isEmpty():
            return labels.select("node", "comp")
