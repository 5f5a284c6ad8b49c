"""Bags with equal instances as one.

Copies are at distance 0 from each other and at the same distance from every other bag. So what concerns pairs is done
between one bag of each class of copies, weighted by the class's size, and holds for all its members; pairs of members
are made only where they are asked for.

A key of 128 bits of SHA-256 over the sorted instances stands for a class. Where bags come as rows, its key is the number of
its instances and two sums of their 64-bit hashes. Values that are equal but written differently
(0.0 and -0.0) may make classes of their own, which are linked like any others. Bags that are empty or hold a value that is
no finite number have no neighbours, not even copies of themselves: each is a class by itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .gapjoin import held_values, mixed

#: Members of a class that are listed in one row, on average, at most.
LISTED = 1000


class Classes:
    """`members`: bags without their instances, with `rep`, the least position of their class, and `n`, its size; may be made when first asked for. `reps`: pos, n, instances of one bag of each class. `bags`: all bags with their instances, if at hand."""

    def __init__(self, members: DataFrame | Callable[[], DataFrame], reps: DataFrame, bags: Callable[[], DataFrame] | None = None):
        self._members, self.reps, self.bags = members, reps, bags

    @cached_property
    def members(self) -> DataFrame:
        return self._members() if callable(self._members) else self._members


def classes(bags: DataFrame) -> Classes:
    """The classes of bags (pos, ..., instances), written."""
    text = F.sort_array("instances").cast("string")
    lone = (F.coalesce(F.size("instances"), F.lit(0)) < 1) | text.rlike("[NIu]")  # NaN, Infinity, null
    key = F.substring(F.unhex(F.sha2(F.when(lone, F.concat(F.lit("bag "), F.col("pos").cast("string"))).otherwise(text), 256)), 1, 16)
    keyed = keep(bags.withColumn("key", key).drop("instances"), "keyed")
    found = keep(keyed.groupBy("key").agg(F.min("pos").alias("rep"), F.count("*").alias("n")), "classes")
    members = keep(keyed.join(found, "key").drop("key"), "members")
    reps = keep(bags.select("pos", "instances").join(found.select(F.col("rep").alias("pos"), "n"), "pos").select("pos", "n", "instances"), "reps")
    return Classes(members, reps)


#: Bits of the NaN that stands for null among the bytes of a bag.
_NULL = np.uint64(0x7FF8_6E75_6C6C_0001)


def _bagged(dims: int):
    """Rows (pos, is_known, label, a column for each dimension) sorted by pos give bags with their keys and their values as bytes."""

    def work(rows: pa.Table):
        pos, known = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(bool)
        values = np.empty((len(pos), dims))
        for k in range(dims):
            column = rows.column(3 + k)
            values[:, k] = column.to_numpy()
            if column.null_count:
                values.view(np.uint64)[np.asarray(pa.compute.is_null(column)), k] = _NULL
        own, values = pos[~known], values[~known]
        if not len(own) or not known.any():
            return
        places, begins = np.unique(pos[known], return_index=True)
        texts = rows.column(2).filter(pa.array(known)).combine_chunks()
        texts = (texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)).dictionary_encode()
        names = texts.dictionary.to_pylist()
        ordered = sorted(names)
        code = np.array([ordered.index(v) for v in names] + [-1])[np.asarray(pa.compute.fill_null(texts.indices, len(names)))]
        code = np.maximum.reduceat(code, begins)
        at = np.minimum(np.searchsorted(places, own), len(places) - 1)
        named = places[at] == own
        own, values, at = own[named], values[named], at[named]
        if not len(own):
            return
        order = np.lexsort((*values.T[::-1], own))
        own, values, at = own[order], np.ascontiguousarray(values[order]), at[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
        sizes = np.diff(np.append(first, len(own)))
        words = (values + 0.0).view(np.uint64)
        keys = []
        for seed in (1, 2):
            h = np.full(len(own), seed, np.uint64)
            for k in range(dims):
                h = mixed(h ^ words[:, k])
            keys.append(np.add.reduceat(h, first).view(np.int64))
        lone = np.add.reduceat(~np.isfinite(values).all(axis=1), first, dtype=int) > 0
        key = [np.where(lone, -1, sizes), np.where(lone, own[first], keys[0]), np.where(lone, 0, keys[1])]
        ends = np.append(first, len(own)).astype(np.int32) * (8 * dims)
        held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(values)])
        code = code[at[first]]
        labels = pa.array(ordered, pa.string()).take(pa.array(code, mask=code < 0))
        yield pa.RecordBatch.from_arrays([pa.array(own[first]), labels, *(pa.array(k) for k in key), held], names=["pos", "label", *KEY, "bag"])

    def run(batches):
        waiting = []  # the last bag may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column(0).to_numpy()
            begins = int(np.searchsorted(pos, pos[-1]))
            if begins or (waiting and waiting[-1].column(0)[-1].as_py() != pos[-1]):
                yield from work(pa.Table.from_batches([*waiting, batch.slice(0, begins)]))
                waiting = []
            waiting.append(batch.slice(begins))
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    return run


#: What equal bags have in common: their number of instances and two sums of hashes.
KEY = ["size", "sum1", "sum2"]


def _listed(held: pa.Array, dims: int) -> pa.Array:
    """Instances of bags from their bytes."""
    values, ends = held_values(held, dims)
    flat = values.ravel()
    null = flat.view(np.uint64) == _NULL
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), pa.array(flat, mask=null) if null.any() else pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), inner)


def _firsts(dims: int):
    """Rows (size, sum1, sum2, pos, bag) sorted by all but the last give the first bag of each key and the number of bags."""

    def made(rows: pa.Table, n: list[int]):
        held = rows.column(4).combine_chunks()
        held = held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)
        one = lambda k: pa.array(rows.column(k).to_numpy())
        return pa.RecordBatch.from_arrays([one(3), pa.array(n, pa.int64()), _listed(held, dims), one(0), one(1), one(2)], names=["pos", "n", "instances", *KEY])

    def run(batches):
        open_one, count, last = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            begins = np.flatnonzero(np.concatenate([[last is None or (key[0] != last).any()], (np.diff(key, axis=0) != 0).any(axis=1)]))
            last = key[-1]
            count += int(begins[0]) if len(begins) else len(key)
            if not len(begins):
                continue
            sizes = np.diff(np.append(begins, len(key)))
            rows, n = [batch.take(pa.array(begins[:-1]))], sizes[:-1].tolist()
            if open_one is not None:
                rows, n = [open_one, *rows], [count, *n]
            if n:
                yield made(pa.Table.from_batches(rows), n)
            open_one, count = batch.take(pa.array(begins[-1:])), int(sizes[-1])
        if open_one is not None:
            yield made(pa.Table.from_batches([open_one]), [count])

    return run


def classes_of_rows(rows: DataFrame, known: DataFrame) -> Classes:
    """The classes of bags whose instances are rows (pos, a column for each dimension); known: (pos, label) of the bags that count.

    Rows move once to make bags and keys, and bags once, as bytes, to meet their copies."""
    values = [c for c in rows.columns if c != "pos"]
    dims = len(values)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.select("pos", F.lit(False).alias("is_known"), F.lit(None).cast("string").alias("label"), *values).union(known.select("pos", F.lit(True), F.col("label").cast("string"), *[F.lit(0.0)] * dims)).where("pos is not null")
    schema = ", ".join(f"{k} long" for k in KEY)
    bags = keep(each.repartition(tasks, "pos").sortWithinPartitions("pos").mapInArrow(_bagged(dims), f"pos long, label string, {schema}, bag binary"), "classes")
    meeting = bags.select(*KEY, "pos", "bag").repartition(tasks, *KEY).sortWithinPartitions(*KEY, "pos")
    firsts = keep(meeting.mapInArrow(_firsts(dims), f"pos long, n long, instances array<array<double>>, {schema}"), "reps")

    def members() -> DataFrame:
        found = firsts.select(*KEY, F.col("pos").alias("rep"), "n")
        return keep(bags.select("pos", "label", *KEY).join(found, KEY).select("pos", F.col("pos").cast("string").alias("bag_id"), "label", "rep", "n"), "members")

    def listed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _listed(batch.column(2), dims)], names=["pos", "label", "instances"])

    def whole() -> DataFrame:
        return bags.select("pos", "label", "bag").mapInArrow(listed, "pos long, label string, instances array<array<double>>").select("pos", F.col("pos").cast("string").alias("bag_id"), "label", "instances")

    return Classes(members, firsts.select("pos", "n", "instances"), whole)


def restricted(whole: Classes, some: DataFrame) -> Classes:
    """The classes of some of the members, named anew by their least positions."""
    found = keep(some.groupBy("rep").agg(F.min("pos").alias("least"), F.count("*").alias("own")), "classes")
    members = keep(some.drop("n").join(found, "rep").drop("rep").withColumnsRenamed({"least": "rep", "own": "n"}), "members")
    reps = keep(whole.reps.select(F.col("pos").alias("rep"), "instances").join(found, "rep").select(F.col("least").alias("pos"), F.col("own").alias("n"), "instances"), "reps")
    return Classes(members, reps)


def expanded(links: DataFrame, of: Classes) -> DataFrame:
    """(a, b, dist) with a < b of all members of classes that are linked by (a, b, dist), and of members of one class.

    Members are listed in rows of bounded size, and pairs of lists are dealt over tasks before they become pairs of bags."""
    part = F.pmod(F.xxhash64("pos"), F.ceil(F.col("n") / LISTED))
    lists = keep(of.members.select("rep", part.alias("part"), "pos").groupBy("rep", "part").agg(F.collect_list("pos").alias("list")), "lists")
    own = of.reps.where("n > 1").select(F.col("pos").alias("a"), F.col("pos").alias("b"), F.lit(0.0).alias("dist"))
    both = links.select("a", "b", "dist").union(own)
    for side in "ab":
        both = both.join(lists.select(F.col("rep").alias(side), F.col("part").alias(f"part_{side}"), F.col("list").alias(f"list_{side}")), side)
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.where("a <> b or part_a <= part_b").repartition(tasks, "a", "part_a", "b", "part_b")
    one_list = (F.col("a") == F.col("b")) & (F.col("part_a") == F.col("part_b"))
    pairs = dealt.select(one_list.alias("one"), "dist", F.explode("list_a").alias("x"), "list_b").select("one", "dist", "x", F.explode("list_b").alias("y"))
    return pairs.where("not one or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")
