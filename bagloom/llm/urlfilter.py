"""URL filters by Bloom filter cascades.

Rules are keys of a host and the beginning of a path. A URL has the keys that could fit it: each suffix of its
host at a label (of as many labels as some rule has), followed by the beginnings of its path that have the length of some rule's path. The rules of
one action are the listed keys of a cascade. Its first level is a Bloom filter of the listed keys; the keys of
the corpus's complete universe that pass it wrongly are encoded in the second level, the listed keys that pass
that one in the third, and so on until none is left. For every key of that universe membership is then exact,
without a join: a key that fails at an odd level is not listed, at an even level listed.

The first level's error rate is chosen from the numbers of keys, so that about as many keys pass wrongly as are
listed, however large the corpus; so all levels are bounded by the listed keys (and the logarithm of the
corpus). Rules are dealt into blocks of about `block` keys by a hash of the key, each with cascades of its own for the
keys of that block. The corpus's keys are gone through once for all cascades together; judging takes the blocks one
after the other, in the same pass over the pages, so a task holds few cascades at a time and any number of rules works.

Defined results: a null URL, or one without `://`, has an empty host and path and meets no rule; repeated rows
are judged each by itself; an empty table gives no rows. If the longest fitting rules are equally long, the one
with the longer host wins, then the allowing one. What no rule fits is not listed by the cascades: allowed. A null
page_id is judged like others; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEFAULT = "allow"
#: Rules that share cascades (some MB).
BLOCK_RULES = 1 << 20
_SEED = 991  # of the hash that deals keys into blocks
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bloom:
    """A Bloom filter by double hashing of one 64-bit hash."""

    def __init__(self, hashes: np.ndarray, error: float) -> None:
        n = max(1, len(hashes))
        self.bits = np.uint64(max(64, math.ceil(-n * math.log(error) / math.log(2) ** 2)))
        self.probes = max(1, round(int(self.bits) / n * math.log(2)))
        self.data = np.zeros(int(self.bits) // 8 + 1, np.uint8)
        for at in self._at(hashes):
            np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _at(self, hashes: np.ndarray):
        h = np.asarray(hashes).view(np.uint64)
        low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(self.probes):
            yield (low + np.uint64(i) * step) % self.bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._at(hashes):
            out &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def hashes_of(keys: list[str], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode(), seed) for k in keys], np.uint64).view(np.int64)


class Cascade:
    """Levels in turn of listed and wrongly passed keys. The hash of a level is xxHash64 with its own seed."""

    def __init__(self, listed: list[str], universe: int, seed: int) -> None:
        """The first level alone; universe: about how many keys the corpus has."""
        self.seed, self.levels = seed, []
        if listed:
            self.levels.append(Bloom(hashes_of(listed, seed), min(0.5, max(1e-12, len(listed) / (math.sqrt(2) * max(1, universe))))))

    def deepen(self, listed: list[str], passed: set[str]) -> None:
        """The other levels, from all keys of the universe that pass the first."""
        inside, outside = listed, sorted(passed.difference(listed))
        while outside:
            n = len(self.levels)
            self.levels.append(Bloom(hashes_of(outside, self.seed + n), 0.5))
            inside, outside = outside, [k for k, passes in zip(inside, self.levels[n].has(hashes_of(inside, self.seed + n)), strict=True) if passes]

    def passing_first(self, keys: list[str]) -> np.ndarray:
        return self.levels[0].has(hashes_of(keys, self.seed)) if self.levels and keys else np.zeros(len(keys), bool)

    def has_past_first(self, key: str) -> bool:
        """Whether a key is listed that passed the first level."""
        for n in range(1, len(self.levels)):
            if not self.levels[n].has(hashes_of([key], self.seed + n))[0]:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")


def keys_of(host: Column, path: Column, path_lengths: list[int], most_labels: int) -> Column:
    """All keys that a rule with such path lengths, and at most so many labels in its host, can fit a URL by."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def block_of(keys: list[str], blocks: int) -> np.ndarray:
    return (hashes_of(keys, _SEED).view(np.uint64) % np.uint64(blocks)).astype(np.int64) if keys else np.empty(0, np.int64)


ACTIONS = ("allow", "block")


def cascades_of(universe: DataFrame, rows: int, rules, block: int) -> list[list[Cascade]]:
    """For each block of rules, a cascade for each action. universe: arrays of keys, gone through once."""
    blocks = max(1, -(-len(rules) // block))
    listed = [[[] for _ in ACTIONS] for _ in range(blocks)]
    for i, action in enumerate(ACTIONS):
        keys = sorted({r for a, r in rules if a == action})
        for k, at in zip(keys, block_of(keys, blocks).tolist(), strict=True):
            listed[at][i].append(k)
    cascades = [[Cascade(keys, rows // blocks, seed=1000 * (2 * at + i)) for i, keys in enumerate(pair)] for at, pair in enumerate(listed)]
    sent = [universe.sparkSession.sparkContext.broadcast(pair) for pair in cascades]

    def passing(batches):
        for batch in batches:
            flat = sorted(set(batch.column(0).flatten().to_pylist()))
            of = block_of(flat, blocks)
            for at in np.unique(of).tolist():
                mine = [flat[i] for i in np.flatnonzero(of == at)]
                for i, cascade in enumerate(sent[at].value):
                    found = [k for k, passes in zip(mine, cascade.passing_first(mine), strict=True) if passes]
                    yield pa.RecordBatch.from_arrays([pa.array([2 * at + i] * len(found), pa.int32()), pa.array(found, pa.string())], names=["cascade", "key"])

    passed: list[list[set]] = [[set() for _ in ACTIONS] for _ in range(blocks)]
    for r in universe.mapInArrow(passing, "cascade int, key string").distinct().toLocalIterator():
        passed[r.cascade // 2][r.cascade % 2].add(r.key)
    for pair, keys, wrong in zip(cascades, listed, passed, strict=True):
        for cascade, own, found in zip(pair, keys, wrong, strict=True):
            cascade.deepen(own, found)
    return cascades


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, block: int = BLOCK_RULES) -> DataFrame:
    """page_id, host, path, the longest fitting rule (else null) and its verdict (else `default`)."""
    lengths = sorted({len(r) - len(r.split("/", 1)[0]) for _, r in rules}) or [1]
    urls = pages.select(F.col("page_id").cast("long"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    labels = max((r.split("/", 1)[0].count(".") + 1 for _, r in rules), default=1)
    keyed = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    # a key for some three labels of a host and each length of a path: this only sets the first level's error rate
    cascades = cascades_of(keyed.select("keys"), 3 * len(lengths) * pages.count(), rules, block)
    blocks = len(cascades)
    found = keyed.withColumn("rule", F.lit(None).cast("string")).withColumn("action", F.lit(-1))
    for at, pair in enumerate(cascades):
        sent = pages.sparkSession.sparkContext.broadcast(pair)

        def judged(batches, sent=sent, at=at):
            cascades, known = sent.value, [{}, {}]
            for batch in batches:
                keys = batch.column(3)
                flat, ends = keys.flatten().to_pylist(), np.cumsum([0, *(x or 0 for x in pa.compute.list_value_length(keys).to_pylist())])
                owner = np.repeat(np.arange(len(keys)), np.diff(ends))
                if blocks > 1:
                    own = np.flatnonzero(block_of(flat, blocks) == at)
                    flat, owner = [flat[i] for i in own], owner[own]
                rank = lambda key, i: (len(key), len(key.split("/", 1)[0]), -i, key)
                best = [() if r is None else rank(r, i) for r, i in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                for i, c in enumerate(cascades):
                    for n in np.flatnonzero(c.passing_first(flat)):
                        key = flat[n]
                        if key not in known[i]:
                            if len(known[i]) > 100_000:
                                known[i].clear()
                            known[i][key] = c.has_past_first(key)
                        if known[i][key]:
                            best[owner[n]] = max(best[owner[n]], rank(key, i))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([b[3] if b else None for b in best], pa.string()), pa.array([-b[2] if b else -1 for b in best], pa.int32())], names=["page_id", "host", "path", "keys", "rule", "action"])

        found = found.mapInArrow(judged, "page_id long, host string, path string, keys array<string>, rule string, action int")
    verdict = F.when(F.col("action") == 0, ACTIONS[0]).when(F.col("action") == 1, ACTIONS[1]).otherwise(default)
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
