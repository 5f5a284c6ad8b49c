"""Token counts and token ids.

Texts are cut at safe boundaries, the pieces are encoded in batches balanced by bytes, and a bounded memo keeps
what came out for short pieces, since most words recur. Tasks return lengths or packed ids.

The `tokenizers` library defines the result. It is slow on words that it has not seen, so where the vocabulary
file has a twin of ranks beside it, pieces of characters below U+0530 without special strings go to `tiktoken`,
which merges by the same ranks; all others go to the library, since the two can differ in which characters of
newer scripts are letters. The tests hold both ways against each other.

A boundary is safe before a space that stands between two characters that are not white space: the byte-level
pre-tokenizer always starts a new token there (` ?\\p{L}+` and its like take the space along), and its only
look-ahead, `\\s+(?!\\S)`, concerns runs of white space. Special strings hold no space, so no cut falls inside one.
Hence the ids of a text are those of its pieces in a row. A very long text without such a boundary is one piece.

Defined results: a null text is empty, with 0 bytes and 0 tokens; repeated rows, and rows with a null id, count each by
itself; an empty table gives no rows; other columns of documents are ignored.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, small, table, turn_to

#: The vocabulary file that queries use; operators take any other as a parameter.
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that the memo keeps, their greatest length, and bytes that the library encodes at once.
MEMO, MEMO_CHARS, BATCH_BYTES = 150_000, 48, 256 << 10
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_NEWER = re.compile("[\u0530-\U0010ffff]")
_ODD = re.compile(r"^\s| |\s$|^$")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ranks:
    """Encodes by a file of ranks. Many pieces become one text; the bytes of each token tell where pieces end."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = [len(k) for k in ranks]

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, each with a space before it, and where each piece ends. No piece may hold a space or begin or end with white space."""
        text = " " + " ".join(pieces)
        ids, raw = self.ids(text), np.frombuffer(text.encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
        return ids, np.searchsorted(np.cumsum(self._bytes[ids]), ends, side="right")


def by_ranks(path: str) -> Ranks | None:
    """The same vocabulary as ranks, if there is such a file beside it."""
    twin = re.sub(r"\.json$", ".tiktoken", path)
    return Ranks(twin) if twin != path and os.path.exists(twin) else None


def bytes_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def balanced(pieces: list[str], most: int = BATCH_BYTES):
    """Batches of pieces of about so many bytes; a longer piece is a batch by itself."""
    batch, size = [], 0
    for p in pieces:
        own = bytes_of(p)
        if batch and size + own > most:
            yield batch
            batch, size = [], 0
        batch.append(p)
        size += own
    if batch:
        yield batch


class Encoder:
    """Gives the ids of each piece of a text as little-endian 32-bit bytes, or their number; results for short pieces are kept."""

    def __init__(self, path: str, only_count: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library, self._only_count = Tokenizer.from_file(path), only_count
        self._library.no_truncation()
        self._library.no_padding()
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._ranks = by_ranks(path)
        self._memo: dict = {}

    def _plain(self, text: str) -> bool:
        """Whether ranks give the library's ids of a text."""
        return (text.isascii() or not _NEWER.search(text)) and not any(s in text for s in self._special)

    def _pack(self, ids):
        return len(ids) if self._only_count else np.asarray(ids, "<u4").tobytes()

    def _encode(self, keys, lead: str) -> dict:
        out, rest, joined = {}, keys, []
        if self._ranks:
            rest = []
            for k in keys:
                if not self._plain(k):
                    rest.append(k)
                elif lead and not _ODD.search(k):
                    joined.append(k)
                else:
                    out[k] = self._pack(self._ranks.ids(lead + k))
            for batch in balanced(joined):
                ids, ends = self._ranks.each(batch)
                if self._only_count:
                    out.update(zip(batch, np.diff(ends, prepend=0).tolist(), strict=True))
                else:
                    raw, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                    out.update((k, raw[cuts[i] : cuts[i + 1]]) for i, k in enumerate(batch))
        for batch in balanced(sorted(rest, key=len)):
            for key, found in zip(batch, self._library.encode_batch_fast([lead + k for k in batch], add_special_tokens=False), strict=True):
                out[key] = self._pack(found.ids)
        return out

    def __call__(self, texts: list[str | None]) -> list[list]:
        """For each text, what its pieces give. Where ids are wanted and ranks give them, a text is one piece: ids of many pieces cost more to keep and join than to make."""
        if not self._ranks or self._only_count:
            return self._by_pieces(texts)
        plain = [bool(t) and self._plain(t) for t in texts]
        rest = iter(self._by_pieces([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [[self._pack(self._ranks.ids(t))] if p else next(rest) for t, p in zip(texts, plain, strict=True)]

    def _by_pieces(self, texts: list[str | None]) -> list[list]:
        if len(self._memo) > MEMO:
            self._memo.clear()
        known = self._memo
        cut = [t.split(" ") if t else [] for t in texts]
        lacking = [[p for p in pieces[1:] if p not in known] for pieces in cut]
        odd = {p for new in map(set, lacking) for p in new if not p or p[0].isspace() or p[-1].isspace()}
        for i, t in enumerate(texts):
            if cut[i] and (not cut[i][0] or cut[i][0][-1].isspace() or odd and not odd.isdisjoint(lacking[i])):
                cut[i] = _SAFE.split(t)  # a space beside other white space: not every space is a boundary
                lacking[i] = [p for p in cut[i][1:] if p not in known]
        new = self._encode(set().union(*lacking), " ")
        first = self._encode({pieces[0] for pieces in cut if pieces}, "")
        known.update(new)
        out = [[first[pieces[0]], *map(known.__getitem__, pieces[1:])] if pieces else [] for pieces in cut]
        for k in new:
            if len(k) > MEMO_CHARS:
                del known[k]
        return out


_encoders = cached("tokens", {})


def encoder(path: str, only_count: bool) -> Encoder:
    """One for each worker process, file and kind of result."""
    turn_to("tokens")
    if (path, only_count) not in _encoders:
        _encoders[path, only_count] = Encoder(path, only_count)
    return _encoders[path, only_count]


def slices(texts: list, most: int = 2 << 20):
    """Ranges of texts of about so many bytes, so that memory holds the pieces of few texts at once."""
    at = size = 0
    for i, t in enumerate(texts):
        size += bytes_of(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text): bytes of UTF-8 and tokens of the whole text, without added special tokens."""

    def counted(batches):
        count = encoder(path, True)
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            n = [sum(x) for a, b in slices(texts) for x in count(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def op3_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"), vocabulary_path()).withColumn("over_limit", F.col("n_tokens") > limit)
