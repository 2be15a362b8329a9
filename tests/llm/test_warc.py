"""op8: archives round trip, with segments, revisits, odd payloads and lost ends."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import pytest

from parley.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, uid string"


def pages():
    rng = random.Random(4)
    big = "".join(rng.choice("abc é\r\n") for _ in range(200_000))
    return [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u\r\nWARC/1.1", ""), (4, "u", None), (5, "u", big), (6, "u", big), (7, "u", "y\r\n\r\nWARC/1.1\r\n"), (8, "u", "\r\n"), (8, "u", "\r\n"), (None, "u", "x"), (9, "u", "\0\n\0"), (10, "u", "z" * 65_536), (11, "u", "z" * 65_537)]


def wanted(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out = Counter()
    for i, _, h in rows:
        data, best = (h or "").encode(), top[h or ""]
        again = i != (best if best >= 0 else None)
        out[i, len(data), warc.base32_sha1(hashlib.sha1(data).digest()), "revisit" if again else "response", best if again else None] += 1
    return out


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_PAYLOADS, 0])
def test_round_trip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", broadcast)
    path = str(tmp_path / "w")
    warc.write_archives(make(spark, pages()), path)
    rows = warc.read_archives(spark, path).collect()
    assert Counter(tuple(r)[:5] for r in rows) == wanted(pages())
    assert all(r["named_digest"] == r["payload_digest"] for r in rows)
    assert warc.read_chunks(spark, path).selectExpr("max(length(payload))").first()[0] <= warc.CHUNK
    with pytest.raises(FileExistsError):
        warc.write_archives(make(spark, pages()), path)


def test_no_written_row_is_longer_than_a_chunk(spark):
    rng = random.Random(5)
    long = rng.randbytes(12 << 20).hex()
    sizes = warc.records(make(spark, [(1, "u", long), (2, "u", "x")])).selectExpr("length(member) AS n").collect()
    assert len(sizes) == 2 + (24 << 20) // warc.CHUNK - 1 and max(r["n"] for r in sizes) < warc.CHUNK + 1024


def test_each_record_is_a_member(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(make(spark, pages()).coalesce(1), path)
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    data, members = file.read_bytes(), []
    while data:
        unzip = zlib.decompressobj(31)
        members.append(unzip.decompress(data))
        data = unzip.unused_data
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    segments = Counter(m.split(b"WARC-Type: ")[1].split(b"\r\n")[0] for m in members)
    big = len(pages()[4][2].encode())
    assert segments == {b"response": 9, b"revisit": 4, b"continuation": -(-big // warc.CHUNK) - 1 + 1}


def test_archives_of_one_member(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"warcinfo", b"software: x\r\n") + record(b"response", http + b"hello\n\nworld")))
    (row,) = warc.read_archives(spark, str(tmp_path)).collect()
    assert row["payload_bytes"] == 12 and row["payload_digest"] == warc.base32_sha1(hashlib.sha1(b"hello\n\nworld").digest())


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 1000])
def test_stream_of_parts_cut_anywhere(cut):
    data = b"".join(b"".join(p) for p in warc._records(1, 2, "u", b"abc\r\n\r\ndef" * 9, 90, "D", None, 16))
    whole = [(h["warc-type"], n, last, part) for h, n, last, part in warc.stream([data], 10)]
    assert [(h["warc-type"], n, last, part) for h, n, last, part in warc.stream([data[i : i + cut] for i in range(0, len(data), cut)], 10)] == whole
    for lost in (1, 5, 40):
        with pytest.raises(ValueError, match="archive ends"):
            list(warc.stream([data[: -4 - lost]], 10))


def test_least_bytes(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(make(spark, [(1, "u", "x"), (2, "u", "x"), (3, "u", "long one"), (4, "u", "long one")]), path, least_bytes=2)
    assert {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, path).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_query_and_empty_table(spark, tmp_path):
    make(spark, pages()).write.parquet(f"{tmp_path}/pages.parquet")
    assert Counter(map(tuple, warc.op8_warc(spark, str(tmp_path)).collect())) == wanted(pages())
    make(spark, []).write.parquet(f"{tmp_path}/none/pages.parquet")
    out = warc.op8_warc(spark, f"{tmp_path}/none")
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and out.count() == 0


def test_urls_of_many_megabytes(spark, tmp_path):
    """A url of 5.6 million two-byte letters is quoted to 34 MB of headers: several members, none of 16 MiB, and the archive is read back."""
    rows = [(1, "http://a/" + "é" * 5_600_000, "x"), (2, "u", "x"), (3, "u", "y")]
    path = str(tmp_path / "w")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert len(warc.records(df).collect()) > 3
    warc.write_archives(df, path)
    assert Counter(tuple(r)[:5] for r in warc.read_archives(spark, path).collect()) == wanted(rows)


def test_headers_of_foreign_records_longer_than_a_chunk(spark, tmp_path):
    """The body begins after the blank line, wherever the chunks end; a revisit's size is that which its long headers state."""
    long = b"X-Long: " + b"h" * 150_000 + b"\r\n"
    body = b"b" * 70_000
    records = []
    for n, (kind, content) in enumerate([("response", b"HTTP/1.1 200 OK\r\n" + long + b"\r\n" + body), ("response", b"HTTP/1.1 200 OK\r\n" + long + b"\r\n"), ("response", b"HTTP/1.1 200 OK\r\n" + long), ("revisit", b"HTTP/1.1 200 OK\r\n" + long + b"Content-Length: 7\r\n\r\n"), ("response", b"HTTP/1.1 200 OK\r\n\r\nsmall")]):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\nContent-Length: {len(content)}\r\n\r\n".encode()
        records.append(gzip.compress(head + content + b"\r\n\r\n"))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(records))
    got = Counter((r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    digest = lambda b: warc.base32_sha1(hashlib.sha1(b).digest())
    assert got == Counter([("response", 70_000, digest(body)), ("response", 0, digest(b"")), ("response", 0, digest(b"")), ("revisit", 7, None), ("response", 5, digest(b"small"))])
