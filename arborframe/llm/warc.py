"""Operator 1: WARC archives written and read as tables of record chunks.

Writing: every row becomes one record, a gzip member of its own, whose block is
an HTTP response.  Rows with equal payloads of at least ``min_bytes`` become one
response, that of the largest id, and revisits that refer to it; a revisit keeps
the HTTP head (with the full length) and the payload digest, not the payload.
Each task writes its archives straight to the shared folder under names of its
own attempt; the returned rows name the segments that count, so leftovers of a
lost attempt are never read.

Reading: a segment is a run of whole members inside an archive, so large
archives are read by many tasks.  Records are decompressed piece by piece and
leave as rows (record, chunk number, bytes) of at most ``chunk_bytes``; each row
carries the length and digest of the payload up to its end, and the last one
those of the whole.  No task holds a whole record, however long it is.

Defined results: a null payload is empty; records with a null id get one from
their position and refer to none; repeated ids are separate records; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, scratch_path
from .common import open_store, ship, utf8

MIN_REVISIT_BYTES = 1000
CHUNK_BYTES = 1 << 20
PIECE = 1 << 16  # bytes handled at a time
SEGMENT_BYTES = 64 << 20
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 16 << 20  # packed bytes of the segments that one task reads
MOST_TASKS = 100_000
ID = "urn:record:"
DATE = "2024-01-01T00:00:00Z"

CHUNKS = (
    "record_id string, id long, record_type string, refers_to long, target_uri string, declared_bytes long, declared_digest string, "
    "chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean"
)
SEGMENTS = "path string, start long, length long, records long"


def record_table(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``id, uri, payload, digest, refers_to`` (null for responses).

    Equal payloads are found on digests and lengths; only groups of two or more
    take part in the join, and a large group is split by adaptive execution.
    Shorter payloads, of which very many may be equal, go around the join.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), utf8(payload_col).alias("payload"))
    long_enough = F.octet_length("payload") >= min_bytes
    short, rows = (rows.where(c).withColumn("digest", F.sha1("payload")) for c in (~long_enough, long_enough))
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("first_id")).where("n > 1")
    groups = groups.select(F.col("digest").alias("__digest"), "first_id")
    joined = rows.join(groups, rows["digest"] == groups["__digest"], "left")
    columns = ["id", "uri", "payload", "digest"]
    refers_to = F.when(F.col("id") != F.col("first_id"), F.col("first_id")).alias("refers_to")
    return joined.select(*columns, refers_to).unionByName(short.select(*columns, F.lit(None).cast("long").alias("refers_to")))


def _hex_to_label(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _label_to_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def head_of(number, uri, digest, refers_to, length) -> bytes:
    """WARC and HTTP heads of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{number}>", f"WARC-Date: {DATE}"]
    if uri:
        lines.append("WARC-Target-URI: " + "".join(uri.split()))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    block = len(http) + (length if refers_to is None else 0)
    lines += [f"WARC-Payload-Digest: {_hex_to_label(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _write(folder: str, archive_bytes: int, segment_bytes: int):
    """Task function: record rows to archives; gives their segments."""

    def run(batches):
        store, root = open_store(folder)
        out = path = None
        segment, at, count = 0, 0, 0
        done = []

        def close_segment():
            nonlocal segment, count
            if count:
                done.append((path, segment, at - segment, count))
            segment, count = at, 0

        for batch in batches:
            for number, uri, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, segment, at, count = store.open_output_stream(path, compression=None), 0, 0, 0
                body = memoryview(payload.as_buffer())
                name = number.as_py() if number.is_valid else uuid.uuid4()
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                pieces = [head_of(name, uri.as_py(), digest.as_py(), refers_to.as_py(), len(body))]
                if not refers_to.is_valid:
                    pieces += [body[i : i + PIECE] for i in range(0, len(body), PIECE)]
                for piece in [*pieces, b"\r\n\r\n"]:
                    if packed := member.compress(piece):
                        at += out.write(packed)
                at += out.write(member.flush())
                count += 1
                if at - segment >= segment_bytes:
                    close_segment()
                if at >= archive_bytes:
                    close_segment()
                    out.close()
                    out = None
        if out is not None:
            close_segment()
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "start", "length", "records"])

    return run


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the rows of ``record_table`` and return the table of segments."""
    spark = records.sparkSession
    ship(spark)
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    return saved(records.select("id", "uri", "payload", "digest", "refers_to").mapInArrow(_write(folder, archive_bytes, segment_bytes), SEGMENTS), "warc-segments")


class _Members:
    """Bytes of a segment's gzip members, decompressed piece by piece."""

    def __init__(self, stream, length: int) -> None:
        self.stream, self.left, self.raw, self.ready = stream, length, b"", b""
        self.member, self.fresh, self.full = zlib.decompressobj(31), True, False

    def more(self) -> bool:
        while True:
            if self.member.eof:
                self.raw, self.member, self.fresh, self.full = self.member.unused_data, zlib.decompressobj(31), True, False
            if not self.raw and not self.full:  # a full piece may have more behind it, without further input
                self.raw = self.stream.read(min(PIECE, self.left)) if self.left else b""
                self.left -= len(self.raw)
                if not self.raw:
                    if self.left or not self.fresh:
                        raise EOFError("archive ends inside a record")
                    return False
            made = self.member.decompress(self.raw, PIECE)
            # at a member's end the rest is in unused_data alone
            self.raw = b"" if self.member.eof else self.member.unconsumed_tail
            self.fresh, self.full = False, len(made) == PIECE
            if made:
                self.ready += made
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything before the mark; None at the end of the segment."""
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                return None
        found, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return found

    def take(self, n: int):
        """The next n bytes in pieces."""
        while n:
            if not self.ready and not self.more():
                raise EOFError("record is cut short")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _number(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(ID)
    return int(text) if text.lstrip("-").isdigit() else None


def chunks_of(members: _Members, chunk_bytes: int):
    """Chunk rows of the records of a segment."""
    while (head := members.until(b"\r\n\r\n")) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        left = int(fields["content-length"])
        http = members.until(b"\r\n\r\n")
        left -= len(http) + 4
        record = (
            fields["warc-record-id"].strip("<>"), _number(fields["warc-record-id"]), fields["warc-type"], _number(fields.get("warc-refers-to")),
            fields.get("warc-target-uri"), int(_fields(http)["content-length"]), _label_to_hex(fields["warc-payload-digest"]),
        )
        digest, total, number, held = hashlib.sha1(), 0, 0, []
        size = 0
        for piece in members.take(left):
            while piece:
                part, piece = piece[: chunk_bytes - size], piece[chunk_bytes - size :]
                held.append(part)
                digest.update(part)
                size += len(part)
                total += len(part)
                if size == chunk_bytes and total < left:
                    yield (*record, number, b"".join(held), total, digest.hexdigest(), False)
                    number, held, size = number + 1, [], 0
        yield (*record, number, b"".join(held), total, digest.hexdigest(), True)
        for _ in members.take(4):  # the end mark of a record
            pass


def _read(folder: str, chunk_bytes: int):
    """Task function: segments to chunk rows; a batch holds a few chunks at most."""

    def run(batches):
        store, _ = open_store(folder)
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        names = [field.split()[0] for field in CHUNKS.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path, start, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(path) as stream:
                    stream.seek(start)
                    rows, held = [], 0
                    for row in chunks_of(_Members(stream, length), chunk_bytes):
                        rows.append(row)
                        held += len(row[8])
                        if held >= 4 * chunk_bytes or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return run


def read_chunks(segments: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, task_bytes: int = READ_BYTES) -> DataFrame:
    """The chunk table of the archives that ``segments`` names.

    The segments are dealt to a number of tasks that is counted from their
    packed bytes. Were it left to adaptive execution, the few bytes of the
    segment rows would bring them all into one task.
    """
    spark = segments.sparkSession
    ship(spark)
    count, packed = segments.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(count, max(-(-packed // task_bytes), min(count, spark.sparkContext.defaultParallelism)), MOST_TASKS))
    return segments.repartition(tasks, "path", "start").mapInArrow(_read(folder, chunk_bytes), CHUNKS)


def page_records(pages: DataFrame) -> DataFrame:
    """Write archives, read them back, and describe each page's record from its last chunk."""
    folder = scratch_path(pages.sparkSession, "warc")
    chunks = read_chunks(write_archives(record_table(pages), folder), folder)
    last = chunks.where("last")
    response = F.col("record_type") == "response"
    return last.select(
        F.col("id").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.col("chunk_no") + 1).alias("chunks"),
    )
