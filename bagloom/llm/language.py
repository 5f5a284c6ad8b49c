"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters in a row binds (multiplies) those of
its letters, permuted by their place: rolled twice, once, and not. A text bundles (adds) the vectors of all its
letter triples; a language's prototype bundles those of all its training texts. A text has the language whose
prototype has the greatest cosine with it; the cosine is the score (0 if negative).

Letters are lower-cased; a run of other characters is one gap, which has a vector too, and a triple has a letter
in its middle, so every text with a letter has triples. Bundling is linear: tasks first add up counts of distinct
triples, and multiply them with the triples' vectors in blocks. So memory is bounded whatever the alphabet: long texts
go through in pieces, and counts of many texts by many triples never stand in one matrix. In training only one vector
for each language is shuffled, summed component by component.

Languages come to the driver, and go from there to the tasks, in blocks of at most `block` prototypes (16 MB); beyond
one block the texts are judged block by block, with the best language so far. Their number has no bound.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text if there is no
training text. Null languages and texts do not train. Repeated rows count each by itself; ties go to the lesser name;
an empty table gives no rows; a null id is predicted for, and not trained from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached, small, table, turn_to

DIMENSIONS, SEED, UNKNOWN = 2048, 20, "und"
#: Characters that are counted together, cells of a matrix of texts by triples, triples whose vectors are made at once,
#: and prototypes that are broadcast and languages whose sums a task holds together.
SLICE, CELLS, TRIPLES, LANGUAGES = 1 << 20, 1 << 22, 1024, 1024
#: Cells of a block to one that is filled, up to which the block is multiplied as a whole.
FILLED = 24


class Space:
    """Random vectors of letters and triples; a worker process makes each letter's once."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}
        #: For each code point, the code point of its letter, or 0.
        self.letter = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        if len(self._letters) > 30_000:
            self._letters.clear()
        for c in codes.tolist():
            if c not in self._letters:
                self._letters[c] = np.random.default_rng([self.seed, c]).choice(np.array([-1, 1], np.int8), self.dimensions)
        return np.array([self._letters[c] for c in codes.tolist()], np.int8).reshape(-1, self.dimensions)

    def triples(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of triples, given as rows of three code points."""
        known, at = np.unique(codes, return_inverse=True)
        v, at = self.letters(known), at.reshape(-1, 3)
        return (np.roll(v, 2, axis=1)[at[:, 0]] * np.roll(v, 1, axis=1)[at[:, 1]] * v[at[:, 2]]).astype(np.float32)


def parts_of(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, lower-cased, in parts of bounded characters: indices and pieces, each with one character of context on either side (a
    space at a text's ends). Long texts are cut into several pieces."""
    owners, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        t = f" {t.lower()} " if t else "  "
        for a in range(0, max(1, len(t) - 2), SLICE):
            piece = t[a : a + SLICE + 2]
            if owners and size + len(piece) > SLICE:
                yield owners, pieces
                owners, pieces, size = [], [], 0
            owners.append(i)
            pieces.append(piece)
            size += len(piece)
    if owners:
        yield owners, pieces


def counted(space: Space, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples as code points; and, for each pair of a piece and a triple that it has: piece, triple, count."""
    rows = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in pieces]
    lengths = np.array([len(r) for r in rows])
    codes = space.letter[np.concatenate(rows)]
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(codes), bool)  # a middle has its context in the same piece
    inner[first] = inner[first + lengths - 1] = False
    middle = np.flatnonzero(inner & (codes != 0))
    owner = np.repeat(np.arange(len(pieces)), lengths)[middle]
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    x, base = number[codes], max(1, len(alphabet))
    triple = (x[middle - 1] * base + x[middle]) * base + x[middle + 1]
    if base**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(triple, minlength=1))
        place = np.zeros(base**3, np.int64)
        place[seen] = np.arange(len(seen))
        column = place[triple]
    else:
        seen, column = np.unique(triple, return_inverse=True)
    pair = owner * max(1, len(seen)) + column
    if len(pieces) * len(seen) <= CELLS:
        full = np.bincount(pair, minlength=1)
        pairs = np.flatnonzero(full)
        counts = full[pairs]
    else:
        pairs, counts = np.unique(pair, return_counts=True)
    codes_of = np.stack([alphabet[seen // base**2], alphabet[seen // base % base], alphabet[seen % base]], axis=1)
    return codes_of, pairs // max(1, len(seen)), pairs % max(1, len(seen)), counts


def bundled(space: Space, groups: np.ndarray, n: int, codes: np.ndarray, column: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bundles of n groups, where pairs of a group and a triple have counts. Triples' vectors are made block by block, frequent
    triples first, so that early blocks are well filled."""
    out = np.zeros((n, space.dimensions), np.float32)
    order = np.argsort(-np.bincount(column, minlength=len(codes)), kind="stable")
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))
    codes, column = codes[order], place[column]
    by = np.argsort(column, kind="stable")
    groups, column, counts = groups[by], column[by], counts[by]
    for a in range(0, len(codes), TRIPLES):
        b = min(a + TRIPLES, len(codes))
        vectors = space.triples(codes[a:b])
        lo, hi = np.searchsorted(column, [a, b])
        g, c, k = groups[lo:hi], column[lo:hi] - a, counts[lo:hi]
        present, row = np.unique(g, return_inverse=True)
        if len(present) * (b - a) <= FILLED * len(g) + 4 * (b - a):  # well filled: one product
            matrix = np.zeros((len(present), b - a), np.float32)
            np.add.at(matrix, (row, c), k)
            out[present] += matrix @ vectors
        else:
            by_group = np.argsort(row, kind="stable")
            starts = np.flatnonzero(np.diff(row[by_group], prepend=-1))
            for i, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True)):
                mine = by_group[s:e]
                out[present[i]] += k[mine].astype(np.float32) @ vectors[c[mine]]
    return out


_spaces = cached("language", {})


def space_of(dimensions: int, seed: int) -> Space:
    turn_to("language")
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def bundles_of(space: Space, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For parts of the texts, in order: indices of texts and their bundles; a long text comes in several parts, to be added up."""
    for owners, pieces in parts_of(texts):
        codes, piece, column, counts = counted(space, pieces)
        yield np.array(owners), bundled(space, piece, len(pieces), codes, column, counts).astype(np.float64)  # whole numbers


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(lang, v) from rows of (text, lang): a language's bundle, summed component by component."""

    def summed(batches):
        space, sums = space_of(dimensions, seed), {}

        def rows():
            for name, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(np.rint(v).astype(np.int64))], names=["lang", "i", "part"])

        for batch in small(batches):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for owners, pieces in parts_of(texts):
                codes, piece, column, counts = counted(space, pieces)
                names, group = np.unique(langs[owners].astype(str), return_inverse=True)
                pair, at = np.unique(group[piece] * max(1, len(codes)) + column, return_inverse=True)
                total = np.bincount(at, counts)
                found = bundled(space, pair // max(1, len(codes)), len(names), codes, pair % max(1, len(codes)), total) if len(pair) else np.zeros((len(names), dimensions), np.float32)
                for name, v in zip(names.tolist(), found, strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
                if len(sums) > LANGUAGES:
                    yield from rows()
                    sums.clear()
        yield from rows()

    rows = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    parts = rows.mapInArrow(summed, "lang string, i int, part long").groupBy("lang", "i").agg(F.sum("part").alias("v"))
    return parts.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))


def blocks_of(learnt: DataFrame, block: int = LANGUAGES) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages by name and their unit prototypes, so many at a time."""
    names, vectors = [], []
    for r in learnt.orderBy("lang").toLocalIterator():
        v = np.array(r.v, np.float64)
        names.append(r.lang)
        vectors.append(v / (np.linalg.norm(v) or 1.0))
        if len(names) == block:
            yield names, np.array(vectors)
            names, vectors = [], []
    if names:
        yield names, np.array(vectors)


def _nearer(names: list[str], known: np.ndarray, langs: list[str], scores: np.ndarray, texts: list[str | None], space: Space) -> None:
    """Puts the nearest of some languages in place of those so far, where it is nearer."""
    pending: tuple[int, np.ndarray] | None = None

    def judge(index: np.ndarray, bundles: np.ndarray) -> None:
        norms = np.linalg.norm(bundles, axis=1)
        some = norms > 0
        cosines = bundles[some] @ known.T / norms[some, None]
        best = cosines.argmax(axis=1)
        for i, b, c in zip(index[some].tolist(), best.tolist(), cosines[np.arange(len(best)), best].tolist(), strict=True):
            c = min(1.0, max(0.0, round(c, 9)))  # the order of sums doesn't show
            if langs[i] == UNKNOWN or c > scores[i]:
                langs[i], scores[i] = names[b], c

    for index, bundles in bundles_of(space, texts):
        if pending is not None and pending[0] != index[0]:
            judge(np.array([pending[0]]), pending[1])
            pending = None
        if pending is not None:
            bundles[0] += pending[1][0]
        judge(index[:-1], bundles[:-1])
        pending = int(index[-1]), bundles[-1:]  # its text may go on
    if pending is not None:
        judge(np.array([pending[0]]), pending[1])


def identify(docs: DataFrame, blocks, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Rows of (doc_id, held_out, text): the nearest language by cosine. blocks: as from blocks_of."""
    found = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for names, known in blocks:
        sent = docs.sparkSession.sparkContext.broadcast((names, known))

        def judged(batches, sent=sent):
            space, (names, known) = space_of(dimensions, seed), sent.value
            for batch in small(batches):
                langs, scores = batch.column(3).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False).copy()
                _nearer(names, known, langs, scores, batch.column(2).to_pylist(), space)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "text", "lang_pred", "score"])

        found = found.mapInArrow(judged, "doc_id long, held_out boolean, text string, lang_pred string, score double")
    return found.drop("text")


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of an id leaves 1 when divided by 3: such documents don't train."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learnt = prototypes(rows.where("not held_out and doc_id is not null"))
    return identify(rows.drop("lang"), blocks_of(learnt))
