"""Packing of documents into token sequences.

A document is its token ids and an end id. It is cut into full pieces of the sequence length and one rest. The
rests of a randomised group of documents are packed first-fit decreasing: a tournament tree over the bins' free
room gives the first bin that a piece fits, in time logarithmic in the bins. Groups are packed independently, one
task each. Sequences whose length is a power of two need no padding; all others are padded to the full length.
With some thousand documents to a group the padding is a few ten-thousandths of the ids.

A group holds about `group` documents, or as many as have about `group_bytes` of text if ids are carried along. The
rows are dealt by a hash of their number in the table, and full pieces one by one, so no hot source, id, repeated row
or long text gathers in one group. Only lengths and checksums are shuffled, and ids where sequences are written.

Defined results: a null or empty text is the end id alone; repeated rows, and rows with a null id, are packed each by
itself; an empty table gives no rows; other columns of documents are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, table
from .tokens import encoder, slices, vocabulary_path

LENGTH, END_ID, GROUP, GROUP_BYTES = 2048, 1, 4096, 16 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of bins, with the most of every subtree: the first bin that has enough is found from the root."""

    def __init__(self, bins: int, room: int) -> None:
        self.size = 1 << max(1, bins - 1).bit_length()
        self.most = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        most, at = self.most, 1
        while at < self.size:
            at *= 2
            if most[at] < need:
                at += 1
        return at - self.size

    def take(self, at: int, need: int) -> int:
        """Takes room of a bin; gives where in it the room begins, counted from the bin's full room."""
        most, at = self.most, at + self.size
        before = most[at]
        most[at] -= need
        while at > 1:
            at //= 2
            if most[at] == (now := max(most[2 * at], most[2 * at + 1])):
                break
            most[at] = now
        return before


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all at most `room`); bins are numbered from 0 without gaps."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(len(lengths), room)
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[i] = b = tree.first(need)
        offsets[i] = room - tree.take(b, need)
    return bins, offsets


def pieces(docs: DataFrame, path: str, room: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's pieces in order: full ones, then the rest. with_ids: the ids too, as little-endian 32-bit numbers."""

    def cut(batches):
        encode, tail = encoder(path, False), np.array([end_id], "<u4").tobytes()
        for batch in small(batches):
            texts, own, numbers = (batch.column(i).to_pylist() for i in (1, 0, 2))
            for a, b in slices(texts):
                rows = []
                for doc, row, parts in zip(own[a:b], numbers[a:b], encode(texts[a:b]), strict=True):
                    ids = b"".join(parts) + tail
                    n = len(ids) // 4
                    for start in range(0, n, room):
                        piece = ids[4 * start : 4 * (start + room)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, row, *([piece] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(columns)], names=names)

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def packed_group(group: pa.Table, room: int) -> pa.Table:
    """Sequences of one group, in an order that its rows' arrival doesn't change. Full pieces have their own; rests are packed first-fit decreasing."""
    group = group.take(np.lexsort([group.column(c).to_numpy() for c in ("start", "row")]))
    lengths = group.column("length").to_numpy()
    full = lengths == room
    bins, offsets = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    bins[full] = np.arange(full.sum())
    if (~full).any():
        found, offsets[~full] = first_fit_decreasing(lengths[~full], room)
        bins[~full] = found + full.sum()
    sequence = group.column("part").to_numpy() * (1 << 32) + bins
    columns = [n for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens") if n in group.column_names]
    out = group.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))
    return out.append_column("ids", group.column("ids")) if "ids" in group.column_names else out


def pack(docs: DataFrame, path: str, room: int = LENGTH, end_id: int = END_ID, group: int = GROUP, seed: int = 7, with_ids: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per piece: where it lies in its document, its checksum, its place in a sequence, and (with_ids) its ids.

    A sequence is the ids of its pieces by offset; `sequences` puts them together."""
    if with_ids:
        size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first()
        groups = max(1, -(-size.n // group), -(-size.b // group_bytes))
    else:
        groups = max(1, -(-docs.count() // group))
    own = F.when(F.col("length") == room, F.col("start")).otherwise(F.lit(-1))
    cut = pieces(docs, path, room, end_id, with_ids).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row", own), F.lit(groups)))
    return cut.groupBy("part").applyInArrow(lambda g: packed_group(g, room), PACKED + (", ids binary" if with_ids else ""))


def sequences(packed: DataFrame, room: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, used (ids before padding) and ids (binary, little-endian 32-bit, padded unless the length is a power of two) of
    pieces that carry their ids. A sequence has at most `room` pieces."""
    made = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    used = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    rows = made.select("sequence_id", used.alias("used"), joined.alias("ids"))
    lacking = F.when(F.bit_count("used") == 1, F.lit(0)).otherwise(F.lit(room) - F.col("used")).cast("int")
    padding = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), lacking))
    return rows.select("sequence_id", "used", F.concat("ids", padding).alias("ids"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
