"""WARC archives written from, and read into, a chunked record table.

A record is never assembled. The writer cuts an oversized payload into a first record and continuation records of at most CHUNK bytes
(WARC/1.1 segmentation); each is a gzip member of its own and one row (several where a url of megabytes makes long headers), so archives can be read from any record on. The reader streams
an archive's lines out of Spark's text source, which unzips as it goes, and yields rows of record identifier, chunk number and at most CHUNK bytes.
Digests are carried from chunk to chunk. Files are written by Spark's own writer and renamed through the store's own file system,
so any store that Spark writes will do and a lost task is written again.

Of records with equal payloads (of at least least_bytes), that of the largest page_id is the response; the others are revisits,
which hold headers only. Payload size and digest in revisits are those of the full payload. Which payloads occur more than once is decided on
digests; this table is broadcast up to BROADCAST_PAYLOADS rows of some 60 bytes, and beyond that payloads meet it in a hash join.

Defined results: a null html is an empty payload; a null url leaves its header out; rows with the response's page_id and payload are
responses too (repeated rows); a null page_id ranks below all others; an empty table gives an empty table; other columns are ignored.
A row of pages is held once by the task that reads it, as any row of a table is; what is written for it is held chunk by chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, skew_join, table

CHUNK = 1 << 16  # bytes of a record that are held at once
MEMBER = 8 << 20  # bytes of a gzip member, unzipped
BATCH = 4 << 20  # bytes of rows handed over at once
BROADCAST_PAYLOADS = 200_000
LINES = 256  # lines joined at once
DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def shared_payloads(source: DataFrame, least_bytes: int = 0) -> DataFrame:
    """digest and size of the payloads that several rows have, with page_id (refers_to) and refers_uid of the row that is the response."""
    sums = source.select("digest", "size", "page_id", "uid").filter(F.col("size") >= least_bytes)
    groups = sums.groupBy("digest", "size").agg(F.max(F.struct("page_id", "uid")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.select("digest", "size", F.lit(True).alias("shared"), F.col("top.page_id").alias("refers_to"), F.col("top.uid").alias("refers_uid"))


def record_id(page_id: int | None, uid: int) -> str:
    return f"<urn:parley:page:{'' if page_id is None else page_id}:{uid}>"


_PAGE = re.compile(r"<urn:parley:page:(-?[0-9]*):[0-9]+>")


def _headers(fields: Iterable[tuple[str, object]], length: int) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}WARC-Date: {DATE}\r\nContent-Length: {length}\r\n\r\n".encode()


def _records(page_id: int | None, uid: int, url: str | None, payload: memoryview | bytes, size: int, digest: str, refers: str | None, chunk: int) -> Iterator[list[bytes | memoryview]]:
    """The records of one row, each as a list of pieces."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    own = record_id(page_id, uid)
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    common = [("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        yield [_headers([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", refers), ("WARC-Profile", REVISIT_PROFILE)], len(http)), http, b"\r\n\r\n"]
        return
    first = min(size, chunk)
    yield [_headers([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1 if size > chunk else None)], len(http) + first), http, payload[:first], b"\r\n\r\n"]
    for number, low in enumerate(range(first, size, chunk), 2):
        part = payload[low : low + chunk]
        total = len(http) + size if low + chunk >= size else None
        yield [_headers([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{number}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], len(part)), part, b"\r\n\r\n"]


def _members(pieces: list[bytes | memoryview]) -> Iterator[bytes]:
    """The gzip member of a record without its last byte, which is the highest of the member's size and hence zero.

    A record is one member unless a url makes its headers pass MEMBER bytes; then it is several, one after another.
    """
    if sum(map(len, pieces)) <= MEMBER:
        groups = [pieces]
    else:
        groups = [[memoryview(p)[low : low + MEMBER]] for p in pieces for low in range(0, len(p), MEMBER)]
    for group in groups:
        zipped = zlib.compressobj(4, zlib.DEFLATED, 31)
        out = b"".join([*map(zipped.compress, group), zipped.flush()])
        if out[-1]:
            raise ValueError("a gzip member of 16 MiB or more")
        yield out[:-1]


def records(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The archives' rows: member, a gzip member (of a record, a segment, or a piece of one with headers of over 8 MiB) but for its last byte, which is zero."""
    if chunk >= MEMBER:
        raise ValueError("a segment must be shorter than 8 MiB")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(bytearray()))
    # uid only makes record identifiers unique; it follows from the files' splits
    source = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    source = source.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size"))
    shared = materialize(shared_payloads(source, least_bytes), "payloads")
    if shared.count() <= BROADCAST_PAYLOADS:
        rows = source.join(F.broadcast(shared), ["digest", "size"], "left")
    else:  # a hash join, so that payloads are not sorted
        rows = skew_join(source, shared.hint("shuffle_hash"), ["digest", "size"])
    again = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = rows.select("uid", "page_id", "url", F.when(~again, F.col("html")).alias("html"), "size", "digest", again.alias("again"), "refers_to", "refers_uid")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("uid", "page_id", "url", "size", "digest", "again", "refers_to", "refers_uid")]
            for html, uid, page_id, url, n, digest, again, refers_to, refers_uid in zip(batch.column("html"), *plain):
                payload = memoryview(html.as_buffer()) if html.is_valid else b""
                refers = record_id(refers_to, refers_uid) if again else None
                for pieces in _records(page_id, uid, url, payload, n, base32_sha1(bytes.fromhex(digest)), refers, chunk):
                    for member in _members(pieces):
                        out.append(member)
                        size += len(member)
                        if size >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                            out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return rows.mapInArrow(write, "member binary")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, chunk: int = CHUNK) -> None:
    """Write each row of pages (page_id, url, html) as a WARC record, or several, into *.warc.gz under path, which must not exist."""
    parts = f"{path.rstrip('/')}.parts"
    # the text writer puts its separator after each row: the member's last byte
    records(pages, least_bytes, chunk).select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(parts)
    _publish(pages.sparkSession, parts, path)


def _publish(spark: SparkSession, parts: str, path: str) -> None:
    """Rename the files that the text writer has made, which ends their names in .txt."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = Path(parts), Path(path)
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target) or not store.mkdirs(target):
        raise FileExistsError(path)

    def move(file) -> None:
        name = file.getPath().getName()
        if name.startswith("part-") and file.getLen():
            if not store.rename(file.getPath(), Path(target, name.removesuffix(".txt") + ".warc.gz")):
                raise OSError(f"{name} could not be renamed")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, store.listStatus(source)))
    store.delete(source, True)


def stream(parts: Iterable[bytes], chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bool, bytes]]:
    """(headers, number, is last, bytes) of the chunks of the records of archives, in order. parts: the archives' bytes, cut anywhere."""
    source, buffer = iter(parts), bytearray()

    def more() -> bool:
        part = next(source, None)
        if part is None:
            return False
        buffer.extend(part)
        return True

    while True:
        while True:
            while buffer[:1] in (b"\r", b"\n"):  # what ends the record before
                del buffer[:1]
            if (end := buffer.find(b"\r\n\r\n")) >= 0:
                break
            if not more():
                if buffer:
                    raise ValueError("the archive ends within a record's headers")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        del buffer[: end + 4]
        left, number = int(headers["content-length"]), 0
        while True:
            while len(buffer) < min(left, chunk):
                if not more():
                    raise ValueError("the archive ends within a record")
            part = bytes(buffer[: min(left, chunk)])
            del buffer[: len(part)]
            left -= len(part)
            yield headers, number, not left, part
            number += 1
            if not left:
                break


ROW = "record string, number long, record_type string, page_id long, refers_to long, named_digest string, payload binary, payload_bytes long, payload_digest string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The bytes of the lines."""
    for batch in batches:
        lines = batch.column("line").to_pylist()
        for low in range(0, len(lines), LINES):
            yield b"\n".join([*lines[low : low + LINES], b""])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk table of archives. A record that is one chunk has its digest at once and no payload."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string())
    names = [x.strip().split(" ")[0] for x in ROW.split(",")]
    page = lambda x: int(m[1]) if x and (m := _PAGE.match(x)) and m[1] else None
    out, size, http, in_headers, open_record = [], 0, b"", False, None
    for headers, number, last, part in stream(_joined(batches)):
        kind = headers["warc-type"]
        if kind not in ("response", "revisit", "continuation"):
            continue
        record = headers.get("warc-segment-origin-id") or headers["warc-record-id"]
        segment = int(headers.get("warc-segment-number", 1))
        named = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if segment == 1 and number == 0:
            http, in_headers = b"", True
        if segment == 1 and in_headers:  # the headers of a foreign record may be longer than a chunk
            http, ended, part = (http + part).partition(b"\r\n\r\n")
            in_headers = not ended
            if in_headers and not last:
                continue
        row = [record, segment << 32 | number, kind, page(record), page(headers.get("warc-refers-to")), named]
        if kind == "revisit":
            if last:
                stated = re.search(rb"(?im)^content-length:[ ]*([0-9]+)", http)
                out.append((*row, None, int(stated[1]) if stated else None, named))
        elif segment == 1 and last and "warc-segment-number" not in headers and (number == 0 or record != open_record):
            out.append((*row, None, len(part), base32_sha1(hashlib.sha1(part).digest())))
        else:
            out.append((*row, part, None, None))
            size, open_record = size + len(part), record
        if len(out) >= 4096 or size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, named_digest string"


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by record and number to records; the running digest is all that is kept of a record."""
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    now, digest, total, row = None, None, 0, ()

    def done() -> tuple:
        return (row[0], total, base32_sha1(digest.digest()), "response", None, row[1])

    for batch in batches:
        out = []
        for record, page_id, named, part in zip(batch.column("record").to_pylist(), batch.column("page_id").to_pylist(), batch.column("named_digest").to_pylist(), batch.column("payload")):
            if record != now:
                if now is not None:
                    out.append(done())
                now, digest, total, row = record, hashlib.sha1(), 0, (page_id, named)
            view = memoryview(part.as_buffer())
            digest.update(view)
            total += len(view)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(done()), kinds)], names=names)


def read_chunks(spark, path: str) -> DataFrame:
    """The chunk table of the archives (*.gz) under path. A file is read by one task, as a stream of lines."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.col("value").cast("binary").alias("line")).mapInArrow(_rows, ROW)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; named_digest is what the archive says."""
    chunks = materialize(read_chunks(spark, path), "chunks")
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
    whole = chunks.filter(F.col("payload").isNull()).select(*names)
    parts = chunks.filter(F.col("payload").isNotNull()).select("record", "number", "page_id", "named_digest", "payload")
    return whole.unionByName(parts.repartition("record").sortWithinPartitions("record", "number").mapInArrow(_carry, RECORD))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    same = F.assert_true(F.col("payload_digest").eqNullSafe(F.col("named_digest")), "an archive's payload differs from its digest")
    return found.select("page_id", "payload_bytes", F.coalesce(same.cast("string"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest FROM h),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM g
"""
