"""WARC archives: writing, reading, and reassembly of segmented records.

Pages become WARC/1.1 records: an HTTP response with a chunked body, or a revisit of an earlier response with an equal
payload. A block over SEGMENT bytes is cut into the response and continuation records. Archives are gzip files that
Spark's text writer commits task by task, so lost tasks leave nothing behind; each of its lines holds records of about
LINE bytes and ends with CRLF, which the format asks for, and FILE_LINES of them make a file. The reader unpacks files
piece by piece, follows Content-Length, groups continuations by WARC-Segment-Origin-ID, orders them by
WARC-Segment-Number, verifies WARC-Segment-Total-Length and the digest, and decodes the chunked framing.

Null html counts as empty, a null url has no WARC-Target-URI. Of equal payloads of at least SMALL bytes the row with the
largest page_id is the response (every row with it, if rows repeat; revisits refer to the last of them); if none has an
id, all are responses. Every row gets a record of its own, named by its id and its number. Payloads of any length are
taken whole; an empty table gives archives without records; other columns are ignored. Records that can't be put
together come back with a `problem`, and so does the rest of an archive that is cut off or damaged (type `damaged`, with
the archive's path as its uri).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEGMENT, CHUNK, SMALL, LINE, FILE_LINES = 16_384, 4096, 1000, 1 << 20, 64
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if at + n + 2 > len(body) or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record, without the last of the two line ends after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n"])


def page_records(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    uri = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    same = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()), ("WARC-Payload-Length", len(payload)), ("WARC-Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE), *same], HTTP)]
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *same], block)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Segment-Number", 1), *same], block[:segment])]
    for k, i in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", len(block))] if i + segment >= len(block) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:segment-{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", k), *last], block[i : i + segment]))
    return out


def parse(pieces: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; holds one record and one piece at a time."""
    source, held, done, at = iter([pieces] if isinstance(pieces, bytes) else pieces), bytearray(), False, 0

    def until(ready) -> bool:
        """Reads on until ready(); whether it came to that."""
        nonlocal done
        while not ready():
            piece = next(source, None)
            if piece is None:
                done = True
                return False
            held.extend(piece)
        return True

    while until(lambda: len(held) > 0):
        if not until(lambda: len(held) >= 7) or held[:7] != b"WARC/1.":
            raise ValueError(f"no record at byte {at}")
        if not until(lambda: held.find(b"\r\n\r\n") >= 0):
            raise ValueError(f"a header is cut off at byte {at}")
        end = held.find(b"\r\n\r\n")
        fields = {}
        for line in held[:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        if not fields.get("content-length", "").isdecimal() or "warc-record-id" not in fields or "warc-type" not in fields:
            raise ValueError(f"a header without length, id or type at byte {at}")
        size = int(fields["content-length"])
        if not until(lambda: len(held) >= end + 4 + size):
            raise ValueError(f"the last record is cut off at byte {at}")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        until(lambda: len(held) >= end + 4 + size + 4)
        del held[: end + 4 + size + 4]
        at += end + 4 + size + 4


def gunzip(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """All members of a gzip file, in pieces."""
    while data:
        d = zlib.decompressobj(31)
        rest, piece = data, b""
        while not d.eof and (rest or piece):  # output may be pending when all input is taken
            try:
                piece = d.decompress(rest, step)
            except zlib.error as e:
                raise ValueError(f"bad compression: {e}") from e
            rest = d.unconsumed_tail
            yield piece
        if not d.eof:
            raise ValueError("the compressed data is cut off")
        data = d.unused_data


def with_revisits(pages: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(page_id, url, html bytes, row, refers_to, refers_to_row): id and number of the row whose payload this one repeats, or nulls.

    Only digests are grouped; groups of several pages are written out, so that Spark knows their size before it joins.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.utf8("html")).withColumn("row", F.monotonically_increasing_id())
    key = [F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")]
    large = p.select("page_id", "row", *key).filter(f"size >= {SMALL}").groupBy("digest", "size").agg(F.max(F.struct("page_id", "row")).alias("target"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.keep(large.filter("n > 1 and target.page_id is not null").select("digest", "size", F.col("target.page_id").alias("target"), F.col("target.row").alias("target_row")), "repeated")
    joined = p.select("page_id", "url", "html", "row", *key).join(repeated, ["digest", "size"], "left")
    own = F.col("page_id").eqNullSafe(F.col("target"))
    return joined.select("page_id", "url", "html", "row", F.when(~own, F.col("target")).alias("refers_to"), F.when(~own, F.col("target_row")).alias("refers_to_row"))


def write(pages: DataFrame, path: str, scratch: common.Scratch) -> None:
    """Writes gzipped WARC files under path."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(line)], pa.binary())], names=["records"])

        for b in batches:
            for page_id, url, html, row, target, target_row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in page_records(f"urn:page:{page_id}:{row}", page_id, url, html, None if target is None else f"urn:page:{target}:{target_row}"):
                    line.append(r)
                    size += len(r)
                    if size >= LINE:
                        yield batch()
                        line, size = [], 0
        if line:
            yield batch()

    records = common.stream_arrow(with_revisits(pages, scratch), f, "records binary").select(F.col("records").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_LINES).text(path)


READ = "origin string, segment int, type string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, total long, block binary"
DAMAGED = "damaged"
DONE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary, problem string"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under path, put together: page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload, problem.

    Files are parsed in parallel. Only segments of cut records carry their bytes through the shuffle.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def page(x: str | None) -> int | None:
        return None if x is None else int(x.strip("<>").split(":")[2])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in READ.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names)
            return out if with_payload else finished(out)

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                try:
                    for x, block in parse(gunzip(content.as_py())):
                        digest = x.get("warc-payload-digest")
                        rows.append((
                            x.get("warc-segment-origin-id", x["warc-record-id"]), int(x.get("warc-segment-number", 0)), x["warc-type"], number(x.get("warc-page-id")), x.get("warc-target-uri"),
                            page(x.get("warc-refers-to")), number(x.get("warc-payload-length")), digest and digest.partition(":")[2], number(x.get("warc-segment-total-length")), block,
                        ))
                        size += len(block)
                        if size >= common.BATCH_BYTES or len(rows) >= 512:
                            yield batch(rows)
                            rows, size = [], 0
                except (ValueError, IndexError) as e:
                    rows.append((file, 0, DAMAGED, None, file, None, None, None, None, str(e).encode()))
                if rows:
                    yield batch(rows)

    def payload_of(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
        try:
            head, _, body = block.partition(b"\r\n\r\n")
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        except ValueError as e:
            return None, f"bad framing: {e}"
        return payload, None if digest in (None, hashlib.sha1(payload).hexdigest()) else "the digest differs"

    def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Uncut responses are checked where they are read; their bytes don't go through the shuffle."""
        rows = batch.to_pylist()
        for r in rows:
            if r["segment"] == 0 and r["type"] != DAMAGED:
                payload, problem = payload_of(r["block"], r["payload_digest"]) if r["type"] == "response" else (None, None)
                if r["type"] == "response":
                    r["payload_bytes"], r["payload_digest"] = (len(payload), hashlib.sha1(payload).hexdigest()) if payload is not None else (None, None)
                r["block"] = problem.encode() if problem else None
        return pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in DONE.split(", ")]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for _, segment, kind, page_id, uri, refers_to, size, digest, total, block in common.groups(batches, 1):
            payload = problem = None
            if kind[0] == DAMAGED:
                size, digest, problem = None, None, block[0].decode()
            elif segment[0] == 0 and not with_payload:
                size, digest, problem = size[0], digest[0], block[0] and block[0].decode()
            elif kind[0] == "revisit":
                size, digest = size[0], digest[0]
            elif segment != ([0] if len(segment) == 1 and segment[0] == 0 else list(range(1, len(segment) + 1))):
                size, digest, problem = None, None, f"segments {segment}"
            else:
                whole = b"".join(block)
                if segment[0] and total[-1] != len(whole):
                    size, digest, problem = None, None, f"{len(whole)} bytes of {total[-1]}"
                else:
                    payload, problem = payload_of(whole, digest[0])
                    size, digest = (None, None) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())
            out.append((page_id[0], size, digest, kind[0], refers_to[0], uri[0], payload if with_payload else None, problem))
            if len(out) >= 1024 or payload and len(payload) > 1 << 20:
                yield batch()
                out.clear()
        if out:
            yield batch()

    rows = common.stream_arrow(files, parsed, READ)
    return common.stream_arrow(rows.repartition("origin").sortWithinPartitions("origin", "segment"), assembled, DONE)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), f"{scratch.root}/archives", scratch)
    out = read(spark, f"{scratch.root}/archives", with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


#: Of records with equal payloads of at least 1000 bytes, that with the largest page_id is the response.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), t AS (
  SELECT page_id, html, payload_bytes, max(page_id) OVER (PARTITION BY html) AS target FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN target END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM t
"""
