"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links form.

A document's set holds the hashes of its distinct word n-grams (64 bits; fewer words than n make one n-gram). Two
documents link if their sets' Jaccard similarity reaches the threshold. The join is exact, whatever the copies:

1. Windows. Tasks take documents in windows of bounded size. Equal sets of a window count as one. The global
   n-gram order, that of the hashes, is cut into more fragments than a linked pair can have differences, so a
   linked pair has an equal fragment; the number of cuts depends on a class of sizes, and a document that can link
   into the next class is cut by that one too. Small fragments match by chance, so there are spare cuts, and a
   document skips its smallest fragments, all up to some size, as far as these are no more than the spare cuts. A
   linked pair has more equal fragments than spare cuts, so one is left that neither skips. Documents of a window
   that share a fragment are compared at once with the first of them, so large groups of copies shrink before
   anything is shuffled.
2. Suspects. One entry for each fragment and group of the window is dealt out by the fragment. Only groups that
   share a fragment with another group go on; most documents end here. No pairs are made.
3. Counting. The suspects' distinct sets are put in a second global order, rare n-grams first, by exact counts over
   all suspects; n-grams of one suspect alone drop out. This order is cut into fragments by count (2-3, 4-7, ...), so
   a fragment tells how many suspects hold its n-grams.
4. Candidates. Linked documents share one of the first few n-grams of this order (and have room for enough overlap
   after it). First each is paired with one pivot for each such n-gram, then, in the groups that are still
   apart, with all of other groups; pairs within a group never need to be made. An n-gram that many suspects hold
   is dealt into parts, and what joins it is repeated for each, so no task gets all of its documents.
   Pairs with more differences than a linked pair can have are not made: n-grams of one suspect alone differ, and
   so do parity bits of sets with other n-grams (each bit says whether the n-grams that hash to it are odd in number).
5. Verification. For each pair, the overlap is counted fragment by fragment, and summed.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; a null id
has no group; rows that repeat an id are one document that has all their links, each row by its own set; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import LOWER_AZ, as_bytes, cached, keep, partitions, small, table, turn_to

#: N-grams in one window of a task, and rounds of pivots before all remaining pairs are made.
WINDOW, PIVOT_ROUNDS = 400_000, 2
#: Sizes of fragments, from 0, that can be skipped.
SKIPPED = 6
#: Fragments of the second order: counts of 2-3, 4-7, ... and the last beyond. Holders of an n-gram in one part.
COUNT_FRAGMENTS, HOLDERS = 24, 512
#: 64-bit words of parity bits of a set.
PARITY_WORDS = 8
_PARITY = [f"p{i}" for i in range(PARITY_WORDS)]
_U = np.uint64
_RECORD = "kind int, doc long, same long, root long, n int, h1 long, h2 long, bucket int, data binary"
_DEALT = "bucket int, kind int, n int, base long, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = cached("ngrams", _Hashes())


def ngram_set(raw: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = raw.translate(LOWER_AZ).split() if raw else []
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(_hashes.__getitem__, words), _U, len(words))
    size = min(width, len(words))
    h = np.full(len(words) - size + 1, size, _U)
    for j in range(size):
        h = mixed(h * _U(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j])
    return np.unique(h)


@lru_cache
def classes(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least sizes of the classes; fragments of each; fragments of each that may be skipped."""
    if not 76 <= threshold <= 100:
        raise ValueError("the threshold must be 76 to 100 percent")
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, least[-1] * 3 // 2))
    most = np.array(least[1:], np.int64) - 1
    differ = 2 * most * (100 - threshold) // (100 + threshold)
    spare = differ // 4
    return np.array(least, np.int64), differ + 1 + spare, spare


def fragment_keys(sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets' fragments and the index of the set of each. Linked sets have an equal key."""
    least, cuts, spare = classes(threshold)
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(least, n, side="right") - 1
    keys, owners = [], []
    for up in (0, 1):
        chosen = np.ones(len(sets), bool) if up == 0 else n * 100 >= threshold * least[own + 1]
        which = np.flatnonzero(chosen)
        if not len(which):
            continue
        level = own[which] + up
        m = cuts[level]
        values = flat if up == 0 else flat[np.repeat(chosen, n)]
        at = np.repeat(np.arange(len(which)), n[which])
        fragment = ((values >> _U(32)) * m[at].astype(_U)) >> _U(32)
        offset = np.cumsum(m) - m
        group = offset[at] + fragment.astype(np.int64)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        count = np.diff(np.append(starts, len(values)))
        total = np.add.reduceat(mixed(values), starts)
        owner = at[starts]
        # skipped: fragments of at most so many n-grams, the most that the spare cuts allow (-1: not even empty ones)
        below = m - np.bincount(owner, minlength=len(which))
        skip = np.full(len(which), -1)
        skip += below <= spare[level]
        for size in range(1, SKIPPED):
            below = below + np.bincount(owner[count == size], minlength=len(which))
            skip += below <= spare[level]
        kept = count > skip[owner]
        salt = mixed(level[owner].astype(_U) * _U(0x632BE59BD9B4E019) + (group[starts] - offset[owner]).astype(_U))
        keys.append(mixed(total + salt + count.astype(_U))[kept])
        owners.append(which[owner[kept]])
        for i in np.flatnonzero((skip < 0) & (np.bincount(owner, minlength=len(which)) < m)):  # too many are empty: these count too
            empty = np.setdiff1d(np.arange(m[i]), group[starts[owner == i]] - offset[i])
            keys.append(mixed(mixed(np.full(len(empty), level[i], _U) * _U(0x632BE59BD9B4E019) + empty.astype(_U))))
            owners.append(np.full(len(empty), which[i]))
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, _U), np.empty(0, np.int64))


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two runs: one merge
    return (100 + threshold) * int((both[1:] == both[:-1]).sum()) >= threshold * len(both)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: first all lowest bytes, and so on; what is alike lies together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(data, np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(_U).ravel() for c in flat]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _packed(bucket: np.ndarray, kind: int, columns: list[np.ndarray]):
    """One row for each bucket; bucket is ascending."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    data = [b"".join(planes(c[a:b].astype(_U)) for c in columns) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([kind] * len(starts), pa.int32()), pa.array(ends - starts, pa.int32()), pa.array([0] * len(starts), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "kind", "n", "base", "data"])


class _Window:
    """Documents of one task that are looked at together."""

    def __init__(self, threshold: int, buckets: int) -> None:
        self.threshold, self.buckets, self.ids, self.sets, self.size = threshold, buckets, [], [], 0

    def add(self, doc: int, ngrams: np.ndarray) -> bool:
        self.ids.append(doc)
        self.sets.append(ngrams)
        self.size += len(ngrams) + 20
        return self.size >= WINDOW

    def rows(self):
        """What goes on: a record for each document, and the fragments' keys with their groups."""
        order = np.argsort(np.array(self.ids, np.int64), kind="stable")
        ids, sets = np.array(self.ids, np.int64)[order], [self.sets[i] for i in order]
        n = np.array([len(s) for s in sets], np.int64)
        h1 = np.array([mixed(s).sum(dtype=_U) if len(s) else 0 for s in sets], _U)
        h2 = np.array([mixed(s ^ _U(0xD6E8FEB86659FD93)).sum(dtype=_U) if len(s) else 0 for s in sets], _U)
        first: dict = {}
        same = np.array([first.setdefault((a, b, c), i) if c else i for i, (a, b, c) in enumerate(zip(h1.tolist(), h2.tolist(), n.tolist(), strict=True))])
        reps = np.flatnonzero((same == np.arange(len(ids))) & (n > 0))
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        if len(reps):
            keys, owner = fragment_keys([sets[i] for i in reps], self.threshold)
            owner = reps[owner]
            by = np.lexsort((owner, keys))
            keys, owner = keys[by], owner[by]
            new = np.diff(keys, prepend=~keys[:1]) != 0
            pivot = owner[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            apart = owner != pivot
            for i, p in np.unique(np.stack([owner[apart], pivot[apart]], axis=1), axis=0).tolist():
                a, b = find(i), find(p)
                if a != b and linked(sets[i], sets[p], self.threshold):
                    root[max(a, b)] = min(a, b)
        root = np.array([find(i) for i in range(len(ids))])
        where = int(mixed(ids[:1].astype(_U))[0]) % self.buckets
        yield _packed(np.full(len(ids), where), 0, [ids.view(_U), ids[same].view(_U), ids[root[same]].view(_U), n.astype(_U), h1, h2])
        if len(reps) and len(keys):
            holder = ids[root[owner]]
            once = np.ones(len(keys), bool)
            by = np.lexsort((holder, keys))
            keys, holder = keys[by], holder[by]
            once[1:] = (np.diff(keys) != 0) | (np.diff(holder) != 0)
            yield _packed(_bucket(keys[once], self.buckets), 1, [keys[once], holder[once].view(_U)])


def _windows(width: int, threshold: int, buckets: int):
    def run(batches):
        turn_to("ngrams")
        window, lost = _Window(threshold, buckets), []
        for batch in small(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ngrams = ngram_set(raw, width)
                if doc is None:
                    lost.append(len(ngrams))
                elif window.add(doc, ngrams):
                    yield from window.rows()
                    window = _Window(threshold, buckets)
        if window.ids:
            yield from window.rows()
        if lost:
            yield _packed(np.zeros(len(lost), np.int64), 2, [np.array(lost, _U)])

    return run


def _record(kind: int, count: int, **columns) -> pa.RecordBatch:
    """Rows of _RECORD; columns that aren't given are null."""
    types = {"doc": pa.int64(), "same": pa.int64(), "root": pa.int64(), "n": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "bucket": pa.int32(), "data": pa.binary()}
    own = [columns[name] if name in columns else pa.nulls(count, t) for name, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind, np.int32)), *own], names=["kind", *types])


def _suspects(buckets: int):
    """Records pass; of keys, the groups that share one with another group, packed and dealt out by group: a group is found once for each of its keys."""

    def run(batches):
        turn_to("ngrams")
        keys, holders = [], []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if kind == 1:
                    k, h = unplanes(data, 2)
                    keys.append(k)
                    holders.append(h)
                elif kind == 0:
                    doc, same, root, n, h1, h2 = (c.view(np.int64) for c in unplanes(data, 6))
                    yield _record(0, len(doc), doc=pa.array(doc), same=pa.array(same), root=pa.array(root), n=pa.array(n.astype(np.int32)), h1=pa.array(h1), h2=pa.array(h2))
                else:
                    (n,) = unplanes(data, 1)
                    yield _record(2, len(n), n=pa.array(n.astype(np.int32)))
        if keys:
            k, h = np.concatenate(keys), np.concatenate(holders)
            by = np.lexsort((h, k))
            k, h = k[by], h[by]
            starts = np.flatnonzero(np.append(True, np.diff(k) != 0))
            ends = np.append(starts[1:], len(k)) - 1
            several = h[starts] != h[ends]
            found = np.unique(h[np.repeat(several, np.diff(np.append(starts, len(k))))])
            to = _bucket(mixed(found), buckets)
            by = np.argsort(to, kind="stable")
            if len(by):
                packed = _packed(to[by], 1, [found[by]])
                yield _record(1, packed.num_rows, bucket=packed.column(0), data=packed.column(4))

    return run


def _once(batches):
    """Each suspected group once."""
    found = [unplanes(data, 1)[0] for batch in batches for data in batch.column(1).to_pylist()]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["root"])


def _dealt_sets(width: int, buckets: int):
    """Suspects' sets dealt out by n-gram: (n-gram, document or key of its set, size of its set)."""

    def flush(part):
        values = np.concatenate([s for _, s in part])
        docs = np.repeat(np.array([d for d, _ in part], np.int64), [len(s) for _, s in part])
        sizes = np.repeat(np.array([len(s) for _, s in part]), [len(s) for _, s in part])
        by = np.argsort(values, kind="stable")
        return _packed(_bucket(values[by], buckets), 0, [values[by], docs[by].view(_U), sizes[by]])

    def run(batches):
        turn_to("ngrams")
        part, size = [], 0
        for batch in small(batches):
            for doc, raw, n, h1 in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ngrams = ngram_set(raw, width)
                if len(ngrams) == n and int(mixed(ngrams).sum(dtype=_U).view(np.int64)) == h1:  # an id can repeat with another text
                    part.append((doc, ngrams))
                    size += len(ngrams)
                if size >= WINDOW:
                    yield flush(part)
                    part, size = [], 0
        if part:
            yield flush(part)

    return run


def _columns_of(batches, columns: int) -> list[np.ndarray]:
    found = [unplanes(data, columns) for batch in batches for data in batch.column(4).to_pylist()]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, _U)] * columns


def _counted(buckets: int):
    """N-grams of two suspects or more, with their counts, dealt out by document."""

    def run(batches):
        values, docs, sizes = _columns_of(batches, 3)
        by = np.lexsort((docs, values))
        values, docs, sizes = values[by], docs[by], sizes[by]
        once = np.append(True, (np.diff(values) != 0) | (np.diff(docs) != 0))[: len(values)]
        values, docs, sizes = values[once], docs[once], sizes[once]
        starts = np.flatnonzero(np.append(True, np.diff(values) != 0))[: len(values)]
        counts = np.diff(np.append(starts, len(values)))
        count = np.repeat(counts, counts)
        shared = count >= 2
        values, docs, sizes, count = values[shared], docs[shared], sizes[shared], count[shared]
        to = _bucket(mixed(docs), buckets)
        by = np.argsort(to, kind="stable")
        if len(by):
            yield _packed(to[by], 0, [values[by], docs[by], sizes[by], count[by].astype(_U)])

    return run


def _ordered(batches):
    """A row for each suspect: its n-grams that others share, rare ones first, cut into fragments by count; and their parity bits."""
    values, docs, sizes, count = _columns_of(batches, 4)
    by = np.lexsort((values, count, docs))
    values, docs, sizes, count = values[by], docs[by], sizes[by].astype(np.int64), count[by]
    if not len(docs):
        return
    fragment = np.minimum(np.floor(np.log2(count.astype(np.float64))).astype(np.int64) - 1, COUNT_FRAGMENTS - 1)
    starts = np.flatnonzero(np.append(True, np.diff(docs) != 0))
    ends = np.append(starts[1:], len(docs))
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    inner = np.bincount(owner * COUNT_FRAGMENTS + fragment, minlength=len(starts) * COUNT_FRAGMENTS)
    bit = _U(1) << (values & _U(63))
    word = ((values >> _U(6)) % _U(PARITY_WORDS)).astype(np.int64)
    parity = [np.bitwise_xor.reduceat(np.where(word == w, bit, _U(0)), starts).view(np.int64) for w in range(PARITY_WORDS)]
    for a in range(0, len(starts), 5000):
        b = min(a + 5000, len(starts))
        cuts = np.concatenate([[0], np.cumsum(inner[a * COUNT_FRAGMENTS : b * COUNT_FRAGMENTS])])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values[starts[a] : ends[b - 1]].view(np.int64)))
        nested = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * COUNT_FRAGMENTS, pa.int32()), lists)
        rest = sizes[starts[a:b]] - (ends[a:b] - starts[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(docs[starts[a:b]].view(np.int64)), pa.array(sizes[starts[a:b]]), pa.array(rest), nested, *(pa.array(p[a:b]) for p in parity)], names=["doc", "n", "own", "fragments", *_PARITY])


def verified(pairs: DataFrame, ordered: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those that link: overlaps are counted fragment by fragment and summed."""
    side = lambda d: ordered.select(F.col("doc").alias(d), F.col("n").alias(f"n{d}"), F.col("fragments").alias(f"f{d}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    overlap = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.size(F.array_intersect(x, y))), F.lit(0), lambda s, v: s + v)
    return both.where((overlap * (100 + threshold)) >= threshold * (F.col("na") + F.col("nb"))).select("a", "b")


def _can_link(x: str, y: str, threshold: int):
    """Sizes are close enough; after the common n-gram enough are left on both sides; and there are not more
    differences than a linked pair has: those n-grams that nobody shares, and at least the parity bits that differ."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    room = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    differ = F.col(f"{x}.own") + F.col(f"{y}.own")
    for p in _PARITY:
        differ = differ + F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}")))
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (room * (100 + threshold) >= threshold * (n + m)) & (differ * (100 + threshold) <= (100 - threshold) * (n + m))


def groups(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (the least doc_id that links lead to)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(partitions(spark), 4 * texts.rdd.getNumPartitions())
    first = texts.mapInArrow(_windows(width, threshold, buckets), _DEALT).repartition(buckets, "bucket")
    first = keep(first.mapInArrow(_suspects(buckets), _RECORD), "windows")
    records = first.where("kind <> 1").drop("bucket", "data")
    # ids whose rows have different sets; their sets go by a key of their own below
    several = keep(records.where("doc is not null").groupBy("doc").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("doc"), "several")
    # distinct sets: window by window, then over all
    reps = records.where("doc = same and n > 0")
    leads = reps.groupBy("n", "h1", "h2").agg(F.min("doc").alias("lead"))
    suspects = first.where("kind = 1").select("bucket", "data").repartition(buckets, "bucket").mapInArrow(_once, "root long")
    known = keep(reps.join(leads, ["n", "h1", "h2"]).join(suspects.withColumn("suspect", F.lit(True)), "root", "left").select("doc", "root", "lead", "n", "h1", F.coalesce("suspect", F.lit(False)).alias("suspect")), "reps")
    links = known.where("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")).union(known.where("doc <> lead").select("doc", "lead"))
    links = links.union(records.where("doc <> same").join(several, "doc").select("doc", "same"))
    labels = components(links)
    own = several.select(F.col("doc").alias("lead"), F.lit(True).alias("own"))
    chosen = known.where("suspect").select("lead", "n", "h1").distinct().join(own, "lead", "left")
    chosen = chosen.select(F.col("lead").alias("doc_id"), F.when(F.col("own"), F.xxhash64("lead", "n", "h1")).otherwise(F.col("lead")).alias("set"), "n", "h1")
    leads_of = chosen.where("set <> doc_id").select(F.col("set").alias("doc"), F.col("doc_id").alias("lead"))
    dealt = texts.join(chosen, "doc_id").select("set", "text", "n", "h1").mapInArrow(_dealt_sets(width, buckets), _DEALT).repartition(buckets, "bucket")
    by_doc = dealt.mapInArrow(_counted(buckets), _DEALT).repartition(buckets, "bucket")
    ordered = keep(by_doc.mapInArrow(_ordered, "doc long, n long, own long, fragments array<array<long>>, " + ", ".join(f"{p} long" for p in _PARITY)), "ordered")
    # positions count from the n-grams that nobody shares: they come first in the order
    reach = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - F.col("own")
    parts = F.array(*[F.lit(max(1, 2 ** (f + 1) // HOLDERS)) for f in range(COUNT_FRAGMENTS)])
    marked = F.flatten(F.transform("fragments", lambda ngrams, f: F.transform(ngrams, lambda g: F.struct(g.alias("ngram"), F.get(parts, f).alias("parts")))))
    few = F.slice(marked, F.lit(1), F.greatest(F.lit(0), reach).cast("int"))
    carried = ["doc", "n", "own", *_PARITY]
    prefix = ordered.select(*carried, F.posexplode(few).alias("i", "x")).select(*carried, (F.col("own") + F.col("i")).alias("at"), "x.ngram", "x.parts", F.pmod(F.xxhash64("doc"), F.col("x.parts")).cast("int").alias("part"))
    carried += ["at", "ngram", "parts", "part"]
    prefix = prefix.join(keep(leads_of, "leads"), "doc", "left").withColumn("node", F.coalesce("lead", "doc"))
    prefix = keep(prefix.join(labels, "node", "left").select(*carried, F.coalesce("comp", "node").alias("comp")), "prefix")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(name)
    for turn in range(PIVOT_ROUNDS + 1):
        mixed_up = prefix.groupBy("ngram", "parts").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by(F.struct(*[c for c in carried if c not in ("ngram", "parts", "part")], "comp"), F.xxhash64("doc", F.lit(turn))).alias("pivot")).where("low < high")
        if turn < PIVOT_ROUNDS:
            met = prefix.alias("x").join(mixed_up.select("ngram", "pivot.*", each("part")).alias("y"), ["ngram", "part"]).where("x.comp <> y.comp")
        else:
            apart = prefix.join(mixed_up.select("ngram", each("part")), ["ngram", "part"], "left_semi")
            met = apart.select("*", each("other")).alias("x").join(apart.withColumnRenamed("part", "other").select("*", each("part")).alias("y"), ["ngram", "part", "other"]).where("x.comp < y.comp")
        flip = F.col("x.doc") < F.col("y.doc")
        low, high = (lambda c: F.when(flip, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))), (lambda c: F.when(flip, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
        pairs = met.where(_can_link("x", "y", threshold)).select(low("doc").alias("a"), high("doc").alias("b"), low("comp").alias("ca"), high("comp").alias("cb")).distinct()
        pairs = keep(pairs, "pairs")
        if pairs.isEmpty():
            if turn == PIVOT_ROUNDS or mixed_up.isEmpty():
                break
            continue
        found = keep(verified(pairs, ordered, threshold).join(pairs.select("a", "b", "ca", "cb"), ["a", "b"]), "found")
        if found.isEmpty():
            continue
        merged = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        renamed = merged.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        labels = keep(labels.join(renamed, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).union(merged.join(labels, "node", "left_anti").select("node", "comp")), "labels")
        prefix = keep(prefix.join(renamed, "comp", "left").select(*carried, F.coalesce("to", "comp").alias("comp")), "prefix")
    out = records.join(labels.select(F.col("node").alias("same"), "comp"), "same", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "same").alias("component_id"))


def representatives(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The rows, with all their columns, whose document has the least id of its group. Of rows of such an id with equal texts one
    stays, the least as JSON; rows with other texts stay too. Rows without an id or without words all stay."""
    found = groups(docs, width, threshold)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    several = keep(found.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if several.isEmpty():
        return left
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    repeated = left.where(worded).join(several.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = repeated.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    rest = left.join(several, "doc_id", "left_anti").union(left.where(~F.coalesce(worded, F.lit(False))).join(several, "doc_id", "left_semi"))
    return rest.select(*docs.columns).union(once.select(*docs.columns))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=3, threshold=90)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = d.doc_id
"""
