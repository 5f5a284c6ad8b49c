"""Clusters for a stream of new bags: a stateless join with the cores of a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cluster import Model


def assign_stream(stream: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of bags (pos, bag_id, label, instances) is predicted and given to the sink with its number, so a sink that replaces what a number wrote before is exactly-once."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(model.predict(batch), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
