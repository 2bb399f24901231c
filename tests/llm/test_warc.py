"""Chunked WARC records: SQL, round trips through files, truncation."""

import gzip
import hashlib
import io
import random
import tempfile
import zlib
from pathlib import Path

from compare import spark_rows, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import catalogue, warc


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(catalogue.QUERIES["op5_warc"](spark, sf)) == sql_rows(catalogue.ORACLES["op5_warc"], sf)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=8), st.integers(1, 9))
def test_chunks_of_any_pieces(pieces, size):
    whole = b"".join(pieces)
    rows = list(warc.chunk_rows(iter(pieces), size))
    assert b"".join(r[3] for r in rows) == whole
    assert [r[0] for r in rows] == list(range(len(rows))) and len(rows) == max(1, -(-len(whole) // size))
    at = 0
    for no, begin, n, part, digest, last in rows:
        assert (begin, n, last) == (at, len(part), no == len(rows) - 1) and n <= size
        at += n
        assert digest == hashlib.sha1(whole[:at]).hexdigest()


def test_files(spark):
    warc.register(spark)
    payloads = {f"<urn:{i}>": bytes([i]) * n for i, n in enumerate((0, 1, 4096, 4097, 300_000))}
    records = [warc.record_bytes(i, "http://a/", p) for i, p in payloads.items()]
    with tempfile.TemporaryDirectory() as d:
        Path(d, "a.warc").write_bytes(b"".join(records))
        Path(d, "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
        Path(d, "cut.warc").write_bytes(records[-1][:-1000])
        for name in ("a.warc", "b.warc.gz"):
            rows = spark.read.format("warc").option("chunk_bytes", 4096).load(str(Path(d, name)))
            back = {r.record_id: (bytes(r.payload), r.verified) for r in warc.assemble(rows, "record_id").collect()}
            assert back == {i: (p, True) for i, p in payloads.items()}
        cut = spark.read.format("warc").load(str(Path(d, "cut.warc")))
        assert [r.verified for r in warc.assemble(cut, "record_id").collect()] == [False]


def read(data, size=8):
    """Record id to (payload, complete, error, digest_ok) of a file's bytes; and the rows in order."""
    out = {}
    for r in warc.read_records(io.BytesIO(data), size):
        payload = out.get(r[0], (b"",))[0] + r[7]
        out[r[0]] = (payload, r[9], r[10], r[11])
    return out


def head(length, more=""):
    return f"WARC/1.1\r\nWARC-Record-ID: <bad>\r\n{length}{more}\r\n\r\n".encode()


SOUND = warc.record_bytes("<a>", "http://a/", b"sound payload"), warc.record_bytes("<b>", "http://b/", b"another sound one")
GOOD = {"<a>": (b"sound payload", True, None, True), "<b>": (b"another sound one", True, None, True)}


def test_bad_lengths_give_a_row_and_reading_goes_on():
    for length, error in (("Content-Length: -5", "bad length"), ("Content-Length: x", "bad length"), ("X: 1", "no length"), ("Content-Length: 1e3", "bad length")):
        assert read(SOUND[0] + head(length) + b"lost\r\n\r\n" + SOUND[1]) == GOOD | {"<bad>": (b"", False, error, None)}
    assert read(SOUND[0] + b"WARC/1.1\r\nWARC-Record-ID: <bad>\r\nContent-") == {"<a>": GOOD["<a>"], "<bad>": (b"", False, "header cut short", None)}


def test_damaged_gzip():
    zipped = [gzip.compress(r) for r in SOUND]
    long = gzip.compress(warc.record_bytes("<long>", "u", random.Random(1).randbytes(300_000)))
    assert read(zipped[0] + bytes(700) + zipped[1] + bytes(300)) == GOOD
    assert read(zipped[0] + b"garbage" + zipped[1]) == GOOD
    broken = bytearray(long)
    broken[len(long) // 2 :] = b"\xff" * (len(long) - len(long) // 2)
    found = read(zipped[0] + bytes(broken) + zipped[1], 4096)
    assert {k: found[k] for k in GOOD} == GOOD and found["<long>"][1:] == (False, "payload cut short", None)
    cut = read(zipped[0] + long[: len(long) // 2], 4096)
    assert cut["<a>"] == GOOD["<a>"] and cut["<long>"][1:] == (False, "payload cut short", None)
    flipped = bytearray(zipped[0])
    flipped[-6] ^= 1  # the member's own checksum
    assert read(bytes(flipped) + zipped[1])["<b>"] == GOOD["<b>"]


def test_long_header_lines_are_cut(monkeypatch):
    monkeypatch.setattr(warc, "LINE_BYTES", 1000)
    record = head("Content-Length: 3", "\r\nX: " + "y" * 300_000) + b"abc\r\n\r\n"
    assert read(record + SOUND[0]) == {"<bad>": (b"abc", True, "header line too long", None), "<a>": GOOD["<a>"]}


def test_declared_digests():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload"
    own, other = (hashlib.sha1(x).hexdigest() for x in (b"payload", b"other"))
    for digest, same in ((f"sha1:{own}", True), (f"sha1:{other}", False), (f"md5:{hashlib.md5(b'payload').hexdigest()}", True), ("what:ever", None)):
        record = head(f"Content-Length: {len(body)}", f"\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: {digest}") + body
        for size in (3, 4096):
            assert read(record, size)["<bad>"] == (body, True, None, same)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.booleans())
def test_any_bytes_end(noise, zipped):
    """Whatever a file holds, reading it ends and doesn't raise."""
    data = SOUND[0] + noise + SOUND[1]
    data = gzip.compress(data)[: -len(noise) or None] if zipped else data
    assert ("<a>" in read(data)) or zipped


def test_a_huge_record_is_never_held():
    """300 MB of one gzip member and of one header line pass through a few MB."""
    import tracemalloc

    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    data = z.compress(head(f"Content-Length: {300 << 20}"))
    data += b"".join(z.compress(bytes(1 << 20)) for _ in range(300)) + z.flush()
    tracemalloc.start()
    n = sum(r[6] for r in warc.read_records(io.BytesIO(data), 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 << 20 and peak < 20 << 20


def test_through_files(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u\r\nv"), (3, "é" * 3000, None), (3, "é" * 3000, "w"), (None, "x", "u")], "page_id bigint, html string, chunk_no string")
    direct = sorted(map(tuple, warc.chunk_table(df, "page_id", "html").collect()), key=repr)
    assert sorted(map(tuple, warc.through_files(df, "page_id", "html", uri_col="chunk_no").collect()), key=repr) == direct
    assert warc.through_files(df.where("false"), "page_id", "html").count() == 0


def test_defined_results(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "é" * 3000, 0), (3, "é" * 3000, 0), (None, "x", 0)], "page_id bigint, html string, chunk_no int")
    rows = warc.chunk_table(df, "page_id", "html").collect()
    assert sorted((r.page_id or 0, r.chunk_no, r.n_bytes, r.is_last) for r in rows) == sorted([(0, 0, 1, True), (2, 0, 0, True)] + [(3, 0, 4096, False), (3, 1, 1904, True)] * 2)
    assert warc.chunk_table(df.where("false"), "page_id", "html").count() == 0
