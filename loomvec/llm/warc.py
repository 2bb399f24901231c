"""WARC records as a chunked table.

A payload becomes rows (record_id, chunk_no, ...) of at most chunk_bytes each.
Every row carries the SHA-1 of the payload up to and including its own bytes, so
the last row's digest is the record's and a reader can check a prefix without
the rest. Files are read through a fixed buffer: neither a record nor a file is
ever held whole, and gzip members are inflated piece by piece. Paths may be of any file
system that pyarrow opens (file, hdfs, s3, gs); a file is one task.

Defined results of tables: a null payload gives no rows, an empty one a single empty row
with is_last true; repeated records give repeated rows; extra columns are
ignored; an empty table gives no rows.

Defined results of files: `error` tells what is wrong with a record, null for a sound one.
  * A length that is missing, negative or no number gives one empty row with is_last false; reading goes on at the next
    line that begins a record.
  * A payload cut short by the end of the file or a corrupt gzip member ends with a row with is_last false
    (up to a buffer's bytes before the corrupt place are lost with it). Reading goes on at the next member that can be inflated.
  * Zeros and other bytes between members are skipped, lines between records are too.
  * A header line counts up to LINE_BYTES; of a longer one the rest is dropped and the record's rows say so.
  * digest_ok, on the last row, compares the declared block and payload digests (SHA-1, SHA-256, MD5; of
    HTTP records the payload follows the HTTP header) and is null where none can be compared.
Line ends in ids and URIs that are written become %0D and %0A."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomvec.session import shared_dir

CHUNK_BYTES = 4096
#: Bytes of rows sent to Spark at once; it changes no result.
FLUSH = 4 << 20
#: Bytes of a header line at most.
LINE_BYTES = 1 << 20

ROWS = "chunk_no int, byte_from bigint, n_bytes int, payload binary, prefix_sha1 string, is_last boolean"
RECORD = f"record_id string, warc_type string, uri string, warc_date string, {ROWS}, error string, digest_ok boolean"


def chunk_rows(pieces: Iterator[bytes], chunk_bytes: int, length: int | None = None) -> Iterator[tuple]:
    """ROWS of one payload that arrives in pieces of any size; length, where the
    header declares one, tells whether the payload is complete."""
    digest, held, at, no = hashlib.sha1(), bytearray(), 0, 0
    for piece in pieces:
        held += piece
        while len(held) > chunk_bytes:
            part = bytes(held[:chunk_bytes])
            del held[:chunk_bytes]
            digest.update(part)
            yield no, at, len(part), part, digest.hexdigest(), False
            at, no = at + len(part), no + 1
    digest.update(held)
    yield no, at, len(held), bytes(held), digest.hexdigest(), length is None or at + len(held) == length


def chunk_table(records: DataFrame, id_col: str, payload_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of a binary or string column; strings count as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, payloads = batch.column(0), batch.column(1)
            rows, of, size = [], [], 0
            for i in range(batch.num_rows):
                payload = payloads[i]
                if not payload.is_valid:
                    continue
                view = memoryview(payload.as_buffer())
                for row in chunk_rows((view[a : a + chunk_bytes] for a in range(0, len(view), chunk_bytes)), chunk_bytes):
                    rows.append(row)
                    of.append(i)
                    size += row[2]
                    if size > FLUSH:
                        yield arrow_rows(ids.take(pa.array(of)), rows, id_col)
                        rows, of, size = [], [], 0
            if rows:
                yield arrow_rows(ids.take(pa.array(of)), rows, id_col)

    chosen = records.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload"))
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)['id']}, {ROWS}")


def arrow_rows(ids: pa.Array, rows: list[tuple], id_col: str) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_())
    names = [id_col, "chunk_no", "byte_from", "n_bytes", "payload", "prefix_sha1", "is_last"]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(zip(*rows), kinds))], names=names)


def assemble(chunks: DataFrame, id_col: str) -> DataFrame:
    """id_col, payload and whether it is complete and has the digest it states; for
    records that fit in memory. Repeated chunk rows count once."""
    once = chunks.dropDuplicates([id_col, "chunk_no"])
    joined = once.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "payload", "prefix_sha1", "is_last"))).alias("c"))
    payload = F.aggregate("c", F.lit(b""), lambda s, x: F.concat(s, x["payload"]))
    last = F.element_at("c", -1)
    return joined.select(id_col, payload.alias("payload"), (last["is_last"] & (last["chunk_no"] == F.size("c") - 1) & (F.sha1(payload) == last["prefix_sha1"])).alias("verified"))


# Files


def inflated(f: BinaryIO, buffer: int = 1 << 16) -> Iterator[bytes | None]:
    """The file's bytes in pieces of at most buffer; gzip members are inflated one after
    another. None stands for a place where bytes are lost."""
    head = f.read(buffer)
    if head[:2] != b"\x1f\x8b":
        while head:
            yield head
            head = f.read(buffer)
        return
    while head:
        at = head.find(b"\x1f\x8b\x08")  # past zeros and whatever else lies between members
        if at < 0:
            more = f.read(buffer)
            head = head[-2:] + more if more else b""
            continue
        head, begun = head[at:], head[at + 3 :]
        unzip = zlib.decompressobj(31)
        try:
            while not unzip.eof:
                piece = unzip.decompress(head, buffer)
                if piece:
                    yield piece
                head = unzip.unconsumed_tail
                if not head and not unzip.eof:
                    head = begun = f.read(buffer)
                    if not head:
                        yield None
                        return
            head = unzip.unused_data or f.read(buffer)
        except zlib.error:
            yield None
            head = begun or f.read(buffer)


class Cursor:
    """Lines and counted bytes out of a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes | None]):
        self.pieces, self.held, self.at, self.gap = pieces, b"", 0, False

    def more(self) -> bool:
        """Whether there is another piece without bytes lost before it; gap stays set until passed()."""
        if self.gap:
            return False
        piece = next(self.pieces, b"")
        if piece is None:
            self.gap = True
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return bool(piece)

    def passed(self) -> bool:
        """Goes on after lost bytes, without what was left before them."""
        self.held, self.at, gap, self.gap = (b"", 0, self.gap, False) if self.gap else (self.held, self.at, False, False)
        return gap

    def line(self) -> tuple[bytes, bool] | None:
        """The next line up to LINE_BYTES and whether it is whole; None at the end or at lost bytes."""
        kept, long = b"", False
        while True:
            end = self.held.find(b"\n", self.at)
            part = self.held[self.at : end if end >= 0 else len(self.held)]
            room = LINE_BYTES - len(kept)
            kept, long, self.at = kept + part[:room], long or len(part) > room, end + 1 if end >= 0 else len(self.held)
            if end >= 0:
                return kept.rstrip(b"\r"), not long
            if not self.more():
                return None

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0 and (self.at < len(self.held) or self.more()):
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            yield part


class Digests:
    """The declared digests of a record beside those of the pieces that pass through."""

    def __init__(self, header: dict[str, str]):
        self.sums = []
        for name in ("warc-block-digest", "warc-payload-digest"):
            algorithm, _, value = header.get(name, "").partition(":")
            if (algorithm := algorithm.lower().replace("-", "")) in ("sha1", "sha256", "md5") and value:
                inner = name == "warc-payload-digest" and header.get("content-type", "").lower().startswith("application/http")
                self.sums.append((hashlib.new(algorithm), value, inner))
        self.begin, self.past = b"", not any(inner for *_, inner in self.sums)

    def through(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        for piece in pieces:
            payload = piece if self.past else b""
            if not self.past:
                self.begin += piece
                blank = re.search(rb"\r?\n\r?\n", self.begin)
                if blank or len(self.begin) > LINE_BYTES:
                    self.past, payload, self.begin = True, self.begin[blank.end() :] if blank else b"", b""
            for digest, _, inner in self.sums:
                digest.update(payload if inner else piece)
            yield piece

    def same(self) -> bool | None:
        forms = lambda d: {d.hexdigest(), base64.b32encode(d.digest()).decode().rstrip("=").lower()}
        return all(value.rstrip("=").lower() in forms(d) for d, value, _ in self.sums) if self.sums else None


def read_records(f: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """RECORD rows of every record in the file."""
    cursor = Cursor(inflated(f))
    while True:
        found = cursor.line()
        if found is None:
            if cursor.passed():
                continue
            return
        if not found[0].startswith(b"WARC/"):
            continue
        header: dict[str, str] = {}
        error = None
        while (found := cursor.line()) and found[0]:
            name, _, value = found[0].decode("utf-8", "replace").partition(":")
            header[name.strip().lower()] = value.strip()
            error = error if found[1] else "header line too long"
        about = tuple(header.get(x) for x in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date"))
        length = header.get("content-length", "")
        if found is None or not re.fullmatch(r"[0-9]{1,18}", length):
            yield *about, 0, 0, 0, b"", hashlib.sha1().hexdigest(), False, "header cut short" if found is None else "no length" if not length else "bad length", None
            continue
        digests = Digests(header)
        before = None
        for row in chunk_rows(digests.through(cursor.take(int(length))), chunk_bytes, int(length)):
            if before:
                yield *about, *before, error, None
            before = row
        whole = before[-1]
        yield *about, *before, error if whole else "payload cut short", digests.same() if whole else None


def clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_head(record_id: str, uri: str, size: int, sha1: bytes, kind: str = "resource", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The header of one WARC/1.1 record."""
    sha = base64.b32encode(sha1).decode()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {clean(record_id)}\r\nWARC-Target-URI: {clean(uri)}\r\nWARC-Date: {date}\r\nWARC-Block-Digest: sha1:{sha}\r\nContent-Length: {size}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass")


def record_bytes(record_id: str, uri: str, payload: bytes, kind: str = "resource", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One whole record."""
    return record_head(record_id, uri, len(payload), hashlib.sha1(payload).digest(), kind, date) + payload + b"\r\n\r\n"


def write_files(records: DataFrame, id_col: str, payload_col: str, folder: str, uri_col: str | None = None) -> None:
    """A .warc.gz file for each partition, a member for each record with a payload. A file is
    written under the attempt's name and renamed when whole, so a task that is repeated leaves one file."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = records.select(text(id_col).alias("id"), (text(uri_col) if uri_col else F.lit("")).alias("uri"), F.col(payload_col).cast("binary").alias("payload")).where("payload is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        begun = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}.begun"
        with system.open_output_stream(begun, compression=None) as f:
            for batch in batches:
                for i in range(batch.num_rows):
                    payload = memoryview(batch.column(2)[i].as_buffer())
                    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                    f.write(zipped.compress(record_head(f"<{batch.column(0)[i].as_py()}>", batch.column(1)[i].as_py(), len(payload), hashlib.sha1(payload).digest())))
                    for a in range(0, len(payload), FLUSH):
                        f.write(zipped.compress(payload[a : a + FLUSH]))
                    f.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
        system.move(begun, f"{root}/{task.partitionId():06d}.warc.gz")
        yield from ()

    chosen.mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def through_files(records: DataFrame, id_col: str, payload_col: str, chunk_bytes: int = CHUNK_BYTES, uri_col: str | None = None) -> DataFrame:
    """id_col and ROWS of the records, written as files to the shared folder and streamed from
    there. A null id and an empty one are alike in a file and come back null."""
    spark = records.sparkSession
    folder = f"{shared_dir(spark)}/loomvec/warc-{uuid.uuid4().hex}"
    write_files(records, id_col, payload_col, folder, uri_col)
    register(spark)
    rows = spark.read.format("warc").option("chunk_bytes", chunk_bytes).load(folder)
    own = F.expr("nullif(substring(record_id, 2, length(record_id) - 2), '')").cast(records.schema[id_col].dataType)
    return rows.select(own.alias(id_col), *(x.split()[0] for x in ROWS.split(", ")))


class WarcSource(DataSource):
    """spark.read.format("warc").option("chunk_bytes", n).load(file or folder that all executors see); a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.chunk_bytes = int(options.get("chunk_bytes", CHUNK_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [InputPartition(root)]
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [InputPartition(p) for p in sorted(x.path for x in found if x.path.endswith((".warc", ".warc.gz")))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        kinds = (*[pa.string()] * 4, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in RECORD.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)
        with system.open_input_stream(partition.value, compression=None) as f:
            rows, size = [], 0
            for row in read_records(f, self.chunk_bytes):
                rows.append(row)
                size += row[6] + 200
                if size > FLUSH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
