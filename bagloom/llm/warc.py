"""WARC archives: writing records of pages and reading them back.

Each record is one gzip member. A task writes one archive as a run of segments of whole members, so every
segment is a valid archive by itself, any tool reads the segments put together, and readers need no order among
them. Segments are rows of a table in the shared folder; `export` makes files of them. The reader goes through
bytes once: it inflates member after member from chunks, takes the header up to its empty line, then as many
bytes as Content-Length says, and verifies the digests of block and payload (SHA-1, SHA-256 or MD5, in base 32 or
hexadecimal). Any kind of record is read: the payload is the body of an HTTP message (of a chunked one, what its chunks
hold; its digest may be of either form) or, without HTTP, the whole block; a revisit has that of the record it refers
to, whose digest it states and whose length it states at most as its Content-Length header.

Of records with equal payloads of at least `least` bytes the one with the largest page id is a response, and the
others are revisits that refer to it and hold no payload. Which pages are revisits is found from ids and digests
alone, counted before shuffling; only revisits (a third of the rows, if one payload is that frequent) are joined
back by page id, evenly.

Defined results: a null html is an empty payload; rows that repeat the largest page id of a payload are each a
response; a null page id is a response by itself; an empty table gives no records; other columns are ignored. Damaged
archives raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table

LEAST, SEGMENT_BYTES, CHUNK = 1000, 1 << 20, 64 << 10
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
SEGMENTS = "archive string, segment int, content binary"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, content_length long"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id, url: str | None, payload: bytes, response) -> bytes:
    """A response, or if `response` is the id of another page a revisit of that."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", "response" if response is None else "revisit"), ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    if response is not None:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{_PAGE}{response}>")]
    return member(headers, block)


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of one gzip member after the other, from chunks of any size."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            parts.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, begun = zlib.decompressobj(31), [], False
            else:
                break
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def record_of(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, framed by Content-Length; digests are verified."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if "warc-type" not in headers or not headers.get("content-length", "").isdigit():
        raise ValueError("a record lacks its type or its length")
    length = int(headers["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("the block does not have the length that Content-Length says")
    if not fits(headers.get("warc-block-digest"), block):
        raise ValueError("the block does not have its digest")
    if headers["warc-type"] != "revisit" and "warc-payload-digest" in headers:
        plain, sent = payload_of(headers, block), http_of(headers, block)
        if not fits(headers["warc-payload-digest"], plain) and not (sent and fits(headers["warc-payload-digest"], sent[1])):
            raise ValueError("the payload does not have its digest")
    return headers, block


def fits(stated: str | None, data: bytes) -> bool:
    """Whether data has a stated digest; digests of unknown kinds are not judged."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(kind.lower().replace("-", ""), data)
    return value.lower() == digest.hexdigest() or value.upper().rstrip("=") == base64.b32encode(digest.digest()).decode().rstrip("=")


def hexadecimal(stated: str) -> str:
    """The value of a digest such as sha1:..., in lower-case hexadecimal."""
    kind, _, value = stated.rpartition(":")
    sizes = {"sha1": 40, "sha256": 64, "md5": 32}
    if len(value) == sizes.get(kind.lower().replace("-", ""), 40):
        return value.lower()
    return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()


def http_of(headers: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and body of an HTTP message, if the block is one."""
    if not headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, body


def unchunked(body: bytes) -> bytes:
    """What the chunks of a chunked body hold; a body that isn't well formed stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if end < 0 or size < 0:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
        if len(out[-1]) != size or body[at - 2 : at] != b"\r\n":
            return body


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if (http := http_of(headers, block)) is None:
        return block
    return unchunked(http[1]) if http[0].get("transfer-encoding", "").lower() == "chunked" else http[1]


def described(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS."""
    stated = headers.get("warc-payload-digest")
    if headers["warc-type"] == "revisit":
        length = (http_of(headers, block) or ({}, b""))[0].get("content-length", "")
        digest, size = hexadecimal(stated) if stated else None, int(length) if length.isdigit() else None
    else:
        payload = payload_of(headers, block)
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return headers.get("warc-record-id", "").strip("<>"), headers["warc-type"], headers.get("warc-target-uri", "").strip("<>"), headers.get("warc-refers-to", "").strip("<>") or None, digest, size, int(headers["content-length"])


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    for data in members(chunks):
        yield record_of(data)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and `response`: the page that a revisit refers to."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    slim = own.where(F.octet_length("html") >= least).where("page_id is not null").select("page_id", F.sha1("html").alias("digest"))
    repeated = slim.groupBy("digest").agg(F.max("page_id").alias("response"), F.min("page_id").alias("first")).where("first < response").select("digest", "response")
    revisits = slim.join(repeated, "digest").where("page_id < response").select("page_id", "digest", "response").distinct()
    return own.withColumn("digest", F.sha1("html")).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "response")


def write(marked: DataFrame) -> DataFrame:
    """Segments of one archive for each task, each with a record that describes the archive."""

    def written(batches):
        name, number, parts, size = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0, [], 0
        info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

        def row():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["archive", "segment", "content"])

        for batch in batches:
            for page_id, url, html, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.extend([info] if not (number or parts) else [])
                parts.append(page_record(page_id, url, html.encode(), response))
                size += len(parts[-1])
                if size >= SEGMENT_BYTES:
                    yield row()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield row()

    return marked.mapInArrow(written, SEGMENTS)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives, or of their segments, in a binary column `content` (as Spark's binaryFile source gives files)."""

    def read_back(batches):
        for batch in batches:
            for content in batch.column(0):
                view, rows = memoryview(content.as_buffer()), []
                for headers, block in records(view[i : i + CHUNK] for i in range(0, len(view), CHUNK)):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    rows.append(described(headers, block))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 5 else pa.int64()) for k, c in enumerate(columns)], names=["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "content_length"])

    return archives.select("content").mapInArrow(read_back, RECORDS)


def export(segments: DataFrame, folder: str) -> None:
    """Writes each segment as a file of its own, `<archive>-<segment>.warc.gz`, to a folder (a URI that all executors reach)."""

    def put(rows):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        for r in rows:
            with store.open_output_stream(f"{top}/{r.archive.removesuffix('.warc.gz')}-{r.segment:05d}.warc.gz", compression=None) as out:
                out.write(bytes(r.content))

    segments.foreachPartition(put)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    found = read(keep(write(with_revisits(table(spark, sf_dir, "pages"))), "warc"))
    page = lambda c: F.substring(c, len(_PAGE) + 1, 30).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
m AS (SELECT page_id, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
