"""Document fingerprints: bottom-k sketches of word-shingle hashes, by DataFrame functions only.

A sketch is the sorted array of the k least distinct 64-bit hashes of a text's shingles (five consecutive words;
a shorter text is one shingle). Sketches of parts merge to the sketch of the whole: the k least of their union.
The k least hashes of a union are a uniform sample of it; the share of them that both sketches hold estimates
resemblance, and with the distinct counts, containment. Where a sketch holds fewer than k hashes it is the whole
set, and all estimates are exact.

Words are the lower-cased runs without white space (space and U+0009 to U+000D).

Defined results: a null or empty text, or one without words, has an empty sketch; two empty sketches resemble
each other by 1, an empty and another one by 0. Repeated rows are each a document: they follow each other by id,
then text. A null id comes first. An empty table gives no rows; a table of one row is its own next document. Other
columns are ignored. Rows that repeat one id stay in one range, whose window spills to disk.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

K, WIDTH = 128, 5
#: Ranges of documents for each shuffle partition when documents are put in order.
RANGES_PER_PARTITION = 4
_SPREAD = float(1 << 64)


def word_hashes(text: Column) -> Column:
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.transform(F.array_remove(F.split(spaced, " "), ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """A hash for each run of so many words; a shorter text is one run, a text without words none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(F.size(words) >= width, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds the sketch of a text column. The words' hashes are a column of their own, so each is computed once."""
    words = df.withColumn("_words", word_hashes(F.col(text)))
    return words.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.col("_words"), width))), 1, k)).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _common(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b))).cast("double")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of the union, 0 to 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_common(a, b, k) / F.greatest(F.size(merge(a, b, k)), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes; else from where the k-th least hash lies among all."""
    least = (F.element_at(a, k).cast("double") + F.lit(_SPREAD / 2)) / F.lit(_SPREAD)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(least, F.lit(1e-300)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The part of a's shingles that b has too, 0 to 1."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _literal(values: list) -> Column:
    """An array that is one constant of the plan, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the value, by bisection; 0 for null."""
    at = _literal(bounds)
    whole = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.get(at, middle) <= value
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    steps = F.array(*[F.lit(0)] * len(bounds).bit_length())
    return F.when(value.isNull() | F.lit(not bounds), 0).otherwise(F.aggregate(steps, whole, halved, lambda s: s["low"]))


def with_next(docs: DataFrame, order: str, ranges: int) -> DataFrame:
    """Rows dealt into ranges by ascending `order` (long), each with `part` (its range) and `kept`.

    The first row of each range stands, not kept, at the end of the range before it too, and the first of all at
    the end of the last range, so that a window over one range sees every row's successor. Only the ranges'
    bounds and first ids are gathered: a few numbers for each range. A row finds its range by bisection.
    """
    bounds = []
    if ranges > 1:
        bounds = sorted(set(docs.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("b")).first().b or []))
    rows = docs.withColumn("part", range_of(F.col(order), bounds))
    firsts = {r.part: r.first for r in rows.groupBy("part").agg(F.min_by(order, F.struct(F.col(order).isNotNull(), order)).alias("first")).collect()}
    held = sorted(firsts)
    if not held:
        return rows.withColumn("kept", F.lit(True)).withColumn("turn", F.lit(0))
    first_of, before = [None] * (held[-1] + 1), [None] * (held[-1] + 1)
    for i, p in enumerate(held):
        first_of[p], before[p] = firsts[p], held[i - 1]
    at = lambda values: F.get(_literal(values), F.col("part"))
    again = F.when(F.col(order).eqNullSafe(at(first_of)), at(before).cast("int"))
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("kept"), F.lit(0).alias("turn")), F.struct(again.alias("part"), F.lit(False).alias("kept"), F.lit(1).alias("turn")))
    placed = rows.withColumn("place", F.explode(F.filter(places, lambda p: p["part"].isNotNull())))
    return placed.drop("part").select("*", "place.part", "place.kept", "place.turn").drop("place")


def with_edited(docs: DataFrame, k: int = K, width: int = WIDTH, ranges: int | None = None) -> DataFrame:
    """Each text's sketch beside those of its edited text and of the next document (by doc_id)."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = ranges or RANGES_PER_PARTITION * partitions(docs.sparkSession)
    placed = with_next(own, "doc_id", ranges)
    window = Window.partitionBy("part").orderBy("turn", "doc_id", "text")
    lined = with_sketch(placed, "text", "sketch", k, width).withColumn("next_text", F.lead("text").over(window)).withColumn("next_sketch", F.lead("sketch").over(window)).where("kept")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return with_sketch(lined.withColumn("edited", edited).withColumn("n_chars", n.cast("long")), "edited", "edited_sketch", k, width)


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = with_edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
