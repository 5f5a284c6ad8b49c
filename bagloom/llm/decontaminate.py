"""Benchmark decontamination.

One Aho-Corasick automaton holds every window of the normalised benchmark texts; each document is scanned
once. Normalising maps one byte to one byte, so a match in the normalised text is an offset in the original.

The windows are cut into blocks of bounded bytes. Each block is broadcast by itself (its size is proven when
it is cut) and becomes one automaton; a usual benchmark fits one block. With more blocks a task takes them
one after the other over some megabytes of documents, so memory holds one automaton at a time, and making it anew
costs less than the scan.

Defined results: a null or empty text has no words and no hits; items without words, with a null id or a null
text have no windows; repeated items and repeated documents count each by itself; an empty benchmark hits
nothing. Further columns of the inputs, whatever their names, are ignored by `scan` and kept by `clean`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cached, small, table, turn_to

#: A-Z become a-z; 0-9, a-z and every byte from 0x80 stay; all others separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of windows in one automaton: at about 50 bytes a node, some 200 MB at most.
BLOCK_BYTES = 4 << 20
#: Bytes of texts for which automata are made anew if there are several.
SLICE_BYTES = 32 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    """All windows of so many consecutive words; fewer words make one window."""
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def blocks_of(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[list[tuple[bytes, int, list[str]]]]:
    """Windows with their length in words and their items, in blocks of bounded bytes."""
    block: dict[bytes, tuple[int, set[str]]] = {}
    size = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item_id is not null and text is not null")
    for row in items.toLocalIterator():
        words = words_of(row.text.encode())
        for window in windows_of(words, width):
            if window not in block:
                if size + len(window) > block_bytes and block:
                    yield [(w, k, sorted(ids)) for w, (k, ids) in block.items()]
                    block, size = {}, 0
                block[window] = (min(width, len(words)), set())
                size += len(window) + 2
            block[window][1].add(row.item)
    if block:
        yield [(w, k, sorted(ids)) for w, (k, ids) in block.items()]


def automaton_of(block: list[tuple[bytes, int, list[str]]]):
    """Windows stand between spaces, so that they match whole words only."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for window, k, ids in block:
        found.add_word(f" {window.decode('latin-1')} ", (k, ids))
    found.make_automaton()
    return found


#: In a worker process: the last automaton that was built, by its block's name.
_built = cached("decontamination", {})


def _automaton(name: str, block):
    if name not in _built:
        _built.clear()
        _built[name] = automaton_of(block.value)
    return _built[name]


def hits_of(automaton, folded: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges [first, last + 1) of all occurrences, and their items. folded: words between single spaces, with one at either end."""
    found, items, at, words = [], set(), 0, -1
    for end, (k, ids) in automaton.iter(folded):
        words += folded.count(" ", at, end + 1)  # spaces up to the closing one, less one: words so far
        at = end + 1
        found.append((words - k, words))
        items.update(ids)
    return found, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character ranges of the original text that hold the given word ranges."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    return [{"start": len(raw[: at[a][0]].decode()), "stop": len(raw[: at[b - 1][1]].decode())} for a, b in ranges]


def sliced(batches, most: int):
    """Batches put together up to so many bytes."""
    waiting, size = [], 0
    for batch in batches:
        if waiting and size + batch.nbytes > most:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _hits(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int):
    """A function from texts to their words, hit word ranges and items, for use in tasks."""
    blocks = [(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(b)) for b in blocks_of(benchmark, width, block_bytes)]

    def hits(raw: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        turn_to("decontamination")
        counts, ranges, items = [0] * len(raw), [[] for _ in raw], [set() for _ in raw]
        for name, block in blocks or [("", None)]:
            automaton = _automaton(name, block) if block is not None else None
            for i, r in enumerate(raw):
                words = words_of(r)
                counts[i] = len(words)
                if words and automaton is not None:
                    found, of = hits_of(automaton, f" {b' '.join(words).decode('latin-1')} ")
                    ranges[i] += found
                    items[i] |= of
        return counts, [merged(r) for r in ranges], items

    return hits, len(blocks)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, with_spans: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window, items that occur, hit spans of the original text (empty without with_spans)."""
    hits, blocks = _hits(docs, benchmark, width, block_bytes)

    def scanned(batches):
        for batch in small(batches) if blocks < 2 else sliced(batches, slice_bytes):
            raw = as_bytes(batch.column(1))
            counts, ranges, items = hits(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array([original_spans(t, r) if r and with_spans else [] for t, r in zip(raw, ranges, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanned, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark window. No shuffle: each row is judged where it is read."""
    hits, _ = _hits(docs, benchmark, width, block_bytes)

    def free(texts: pa.Array) -> pa.Array:
        return pa.array([not r for r in hits(as_bytes(texts))[1]], pa.bool_())

    return docs.where(F.arrow_udf(free, "boolean")(F.col("text").cast("string")))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i+least(10, len(w))-1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
cand AS (SELECT doc_id, p, k, array_to_string(w[p:p+k-1], ' ') AS s FROM pos, ks WHERE p + k - 1 <= len(w)),
hit AS (SELECT c.doc_id, c.p, c.k, x.item_id FROM cand c JOIN win x ON c.s = x.s AND c.k = x.k),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
