"""Toxicity: cumulative-link ordinal regression over sparse text features.

The grades 0 (clean) to 3 (severe) share one weight vector; ordered thresholds cut its score: the chance of a
grade of at most k is logistic(threshold_k - score). The expected grade is the severity that comes out.

`labels` tells toxic from clean only, so the grades above 0 are made from it: words that toxic labels favour
strongly form a lexicon, and labelled toxic texts are graded by terciles of the lexicon's part of their words.
Features are hashed words, weighted log(1 + count), where texts of over 100 words have their counts per 100 words, so
one bound serves all lengths; those kept have some support and differ between the labels.

The model is fitted on the driver from a bounded sample of labelled texts: at most `sample` of them and at most
`most_words` distinct words added up over them, half for each class, in the order of a hash of the id, weighted back to
the classes' shares. All documents are scored, whole texts. The
rejecting bound on the chance of any toxicity is the one with the best F1 over the sample, in two halves that
judge each other.

Defined results: a null or empty text has no features, so its severity is the model's least; without labelled
rows of both classes every severity is 0 and nothing is rejected. Labels with a null id or null toxic are left
out; an id that is labelled twice is toxic if one of its labels says so; of rows that repeat a labelled id, the text
with the least hash trains. Repeated documents are scored each by itself; an empty table gives no rows; other columns of
documents are ignored in scoring and kept in filtering.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cached, keep, small, table, turn_to
from .decontaminate import words_of

SAMPLE, MOST_WORDS, BUCKETS, FEATURES, GRADES = 12_000, 6_000_000, 1 << 20, 20_000, 4
#: Words from which counts become shares, so that a text's length alone doesn't raise its score.
LONG = 100
_words: dict[bytes, int] = cached("toxicity", {})


def buckets_of(words) -> list[int]:
    """Hash buckets of words; a worker keeps those of words that it has seen."""
    turn_to("toxicity")
    if len(_words) > 100_000:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w) % BUCKETS
    return [_words[w] for w in words]


def weighted(count, length):
    """The values of words in a text of so many words."""
    return np.log1p(count * (LONG / np.maximum(length, LONG)))


@dataclass
class Model:
    """Weights of the buckets that count, the thresholds, and the chance of toxicity from which texts are rejected."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))
    bound: float = 2.0

    def score(self, raw: bytes | None) -> float:
        counted = Counter(words_of(raw))
        weights = self.weights
        found = [(weights[b], n) for b, n in zip(buckets_of(counted), counted.values(), strict=True) if b in weights]
        w, n = np.array(found, float).reshape(-1, 2).T
        return float((w * weighted(n, counted.total())).sum())

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """The chance of more than each grade but the last."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))

    def judge(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected severity, likeliest grade, whether rejected."""
        above = self.chances(np.array([self.score(t) for t in texts], float))
        exact = -np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]), axis=1)
        return above.sum(axis=1), exact.argmax(axis=1), above[:, 0] >= self.bound


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, weight: np.ndarray, width: int, penalty: float = 0.3, rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by penalised maximum likelihood (Adam); the design is sparse triples.

    Thresholds are a first one and the exponentials of the gaps, so they stay in order."""
    n, cuts = len(grades), GRADES - 1
    p = np.zeros(width + cuts)
    p[width] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    total = weight.sum()
    for t in range(1, rounds + 1):
        w, gaps = p[:width], np.exp(p[width + 1 :])
        theta = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, values * w[columns], minlength=n)
        f = 1 / (1 + np.exp(-np.clip(np.hstack([np.full((n, 1), -np.inf), theta[None, :] - score[:, None], np.full((n, 1), np.inf)]), -40, 40)))
        f[:, 0], f[:, -1] = 0.0, 1.0
        at = np.arange(n)
        high, low = f[at, grades + 1], f[at, grades]
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / chance * weight, low * (1 - low) / chance * weight
        d_score = d_high - d_low  # of the negative log-likelihood
        d_theta = np.bincount(np.minimum(grades, cuts - 1), np.where(grades < cuts, -d_high, 0), minlength=cuts)[:cuts]
        d_theta += np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, d_low, 0), minlength=cuts)[:cuts]
        g = np.concatenate([np.bincount(columns, values * d_score[rows], minlength=width) + penalty * w, [d_theta.sum()], [d_theta[k + 1 :].sum() * gaps[k] for k in range(cuts - 1)]]) / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, most_words: int) -> list:
    """Features of the sampled texts: (toxic, buckets, counts)."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ranked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for t in (0, 1)]
    chosen = [(r.doc_id, r.toxic) for part in ranked for r in part.collect()]
    if not chosen:
        return []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int")), "doc_id")

    def features(batches):
        for batch in small(batches):
            counted = [Counter(words_of(t)) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array([buckets_of(c) for c in counted], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))], names=["toxic", "doc_id", "h", "buckets", "counts"])

    each = texts.select("text", "toxic", "doc_id", F.xxhash64("text").alias("h")).mapInArrow(features, "toxic int, doc_id long, h long, buckets array<int>, counts array<int>")
    found = each.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "buckets", "counts"), "h").alias("x")).select("doc_id", F.xxhash64("doc_id").alias("place"), "x.*")
    found = keep(found, "toxicity-sample")
    taken = []
    sizes = sorted(found.select("toxic", "place", "doc_id", F.size("buckets").alias("n")).collect())
    for t in (0, 1):
        mine = [r for r in sizes if r.toxic == t]
        total = np.cumsum([r.n for r in mine])
        taken += [(r.doc_id,) for r in mine[: max(1, int(np.searchsorted(total, most_words // 2, side="right")))]]
    if not taken:
        return []
    gathered = found.join(F.broadcast(spark.createDataFrame(taken, "doc_id long")), "doc_id").select("doc_id", "toxic", "buckets", "counts").toArrow()
    flat = lambda c: [np.asarray(x.values) for x in gathered.column(c).combine_chunks()]
    rows = zip(gathered.column("doc_id").to_pylist(), gathered.column("toxic").to_pylist(), flat("buckets"), flat("counts"), strict=True)
    return [r[1:] for r in sorted(rows, key=lambda r: r[0])]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_words: int = MOST_WORDS) -> Model:
    rows = _sampled(docs, labels, sample, most_words)
    toxic = np.array([r[0] for r in rows], int)
    if len(set(toxic.tolist())) < 2:
        return Model()
    shares = labels.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double")).alias("s")).first().s
    weight = np.where(toxic == 1, shares / toxic.mean(), (1 - shares) / (1 - toxic.mean()))
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    bucket, count = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    by = [np.bincount(bucket[toxic[row] == t], minlength=BUCKETS) for t in (0, 1)]
    of = [max(1, (toxic == t).sum()) for t in (0, 1)]
    odds = np.log((by[1] + 0.5) / (of[1] + 1)) - np.log((by[0] + 0.5) / (of[0] + 1))
    sure = np.abs(odds) / np.sqrt(1 / (by[0] + 0.5) + 1 / (by[1] + 0.5))
    support = max(3, len(rows) // 3000)
    kept = np.flatnonzero((by[0] + by[1] >= support) & (sure > 2.0))
    kept = kept[np.argsort(-sure[kept], kind="stable")][:FEATURES]
    lexicon = np.zeros(BUCKETS, bool)
    lexicon[kept[(odds[kept] > 2.5)]] = True
    part = np.bincount(row, np.where(lexicon[bucket], count, 0), minlength=len(rows)) / np.maximum(1, np.bincount(row, count, minlength=len(rows)))
    cuts = np.quantile(part[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (part[:, None] > cuts[None, :]).sum(axis=1), 0)
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    use = column[bucket] >= 0
    length = np.bincount(row, count, minlength=len(rows))
    triples = row[use], column[bucket[use]], weighted(count[use], length[row[use]])

    def fitted(at: np.ndarray) -> Model:
        mine = at[triples[0]]
        renumbered = np.cumsum(at) - 1
        w, theta = fit_ordinal(renumbered[triples[0][mine]], triples[1][mine], triples[2][mine], grades[at], weight[at], len(kept))
        return Model({int(b): float(x) for b, x in zip(kept, w, strict=True) if abs(x) > 1e-4}, theta)

    def chance(model: Model) -> np.ndarray:
        w = np.array([model.weights.get(int(b), 0.0) for b in kept])
        return model.chances(np.bincount(triples[0], triples[2] * w[triples[1]], minlength=len(rows)))[:, 0]

    half = np.arange(len(rows)) % 2 == 0
    crossed = np.where(half, chance(fitted(~half)), chance(fitted(half)))
    model = fitted(np.ones(len(rows), bool))
    bounds = np.linspace(0.05, 0.95, 91)
    hit = [(weight * toxic * (crossed >= b)).sum() * 2 / ((weight * (crossed >= b)).sum() + (weight * toxic).sum()) for b in bounds]
    model.bound = float(bounds[int(np.argmax(hit))])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: expected severity (0 to 3), likeliest grade, whether it is rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in small(batches):
            severity, grade, rejected = sent.value.judge(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(rejected, pa.bool_())], names=["doc_id", "severity", "grade", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, severity double, grade int, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fine(texts: pa.Array) -> pa.Array:
        return pa.array(~sent.value.judge(as_bytes(texts))[2], pa.bool_())

    return docs.where(F.arrow_udf(fine, "boolean")(F.col("text").cast("string")))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
