"""What the operators of this subpackage share: tables, the shared folder, batch helpers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

from ..storage import keep, shared_dir, table

__all__ = ["LOWER_AZ", "as_bytes", "cached", "keep", "partitions", "shared_dir", "small", "table", "turn_to"]

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte as it is.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches, rows: int = 1000):
    """Batches in pieces, so that a task holds the values of few rows as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_caches: dict[str, list[dict]] = {}
_turn = ""


def cached(operator: str, values: dict) -> dict:
    """A cache of a worker process that is kept while one operator's tasks follow each other."""
    _caches.setdefault(operator, []).append(values)
    return values


def turn_to(operator: str) -> None:
    """At the start of a task: worker processes outlive queries, so what other operators kept is given back."""
    global _turn
    if _turn == operator:
        return
    _turn = operator
    for values in (v for name, kept in _caches.items() if name != operator for v in kept):
        values.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_bytes(column) -> list:
    """The values of an Arrow string column as UTF-8 bytes (null: None), undecoded."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
