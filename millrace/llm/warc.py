"""WARC archives: a distributed writer and a splittable reader.

The writer puts one gzip member a record and one archive a partition into a folder that all executors share. Payloads
are grouped by SHA-1: the row with the largest id of a group is a ``response``, the others are ``revisit`` records that
name its digest and id and leave the payload out.

The reader cuts archives in byte ranges. A task looks for the gzip magic in its range, takes a candidate only if it
decodes to a WARC header and ends where another member or the file ends, and owns the records that start in its range;
it reads on beyond the range to end its last record. Members that stand inside a record's stored block look like
records, however many there are, but end before it does: a first pass finds where each range's last record ends, and a
range begins where the farthest of those before it ends, so what lies within a record of theirs is never taken.

Defined cases: a null payload is empty; a null url is an empty target; of repeated rows with one id and payload one is
the response and the others revisit it; a row without an id revisits one with an id, and is a response where none of
its group has one; payloads are written and read whole, however long; an empty table writes no archive and reads no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.words import chunks
from millrace.session import bounded_batches, qualified, scratch_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _line(value: str) -> str:
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(page_id: int | None, url: str, payload: bytes, response: bool, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if response else b"")
    name = "null" if page_id is None else str(page_id)
    head = [
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {_line(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not response:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str, batch_html: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        out = before = None
        size = 0
        for batch in chunks(batches, batch_html, CHUNK):
            for r in batch.to_pylist():
                if out is None:
                    fs, root = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    temporary, final = f"{root}/.part-{part:06d}-{attempt}", f"{root}/part-{part:06d}.warc.gz"
                    out = fs.open_output_stream(temporary, compression=None)
                payload = (r["html"] or "").encode()
                best = r["response_id"]
                # repeats of one row follow each other; the first is the response
                key = (r["digest"], r["page_id"])
                response = best is None or (r["page_id"] == best and key != before)
                before = key
                member = encode_record(r["page_id"], r["url"] or "", payload, response, best)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            # a repeated attempt has the same bytes; some stores do not move onto a file
            if fs.get_file_info(final).type != pafs.FileType.NotFound:
                fs.delete_file(final)
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{part:06d}.warc.gz"], "bytes": [size]})

    return write


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, salts: int = 16) -> list[tuple[str, int]]:
    """Write ``pages(page_id, url, html)``; returns the archives' paths and sizes, one a partition.

    Rows are dealt by payload hash and a salt of the id, so a payload that a third of all rows share is spread over
    ``salts`` tasks; the table of shared payloads is repeated per salt, which is all that is joined to them. A folder
    without a scheme is one of Spark's default store.
    """
    bounded_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    keys = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    shared = keys.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
    shared = shared.where("copies > 1").select("digest", "response_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).repartition("digest", "salt")
    # the join keeps that partitioning, so texts are shuffled once
    rows = rows.join(shared, ["digest", "salt"], "left").sortWithinPartitions("digest", "page_id", "url")
    written = rows.mapInArrow(_writer(folder, rows.columns.index("html")), "path string, bytes long").collect()  # a row an archive
    return [(r.path, r.bytes) for r in written]


class _Window:
    """Bytes of a file from some offset on, read in chunks and forgotten behind the reader."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.at, self.data = 0, b""

    def bytes(self, start: int, n: int) -> bytes:
        if start < self.at or start > self.at + len(self.data):
            self.at, self.data = start, b""
        while self.at + len(self.data) < min(start + n, self.size):
            self.file.seek(self.at + len(self.data))
            more = self.file.read(max(CHUNK, start + n - self.at - len(self.data)))
            if not more:
                break
            self.data = self.data[max(0, start - self.at) :] + more if start > self.at else self.data + more
            self.at = max(self.at, start)
        return self.data[start - self.at : start - self.at + n]


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """A member's text and its end, or None if no WARC record's member starts there."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    seen = 0
    while not unpacker.eof:
        chunk = window.bytes(at, CHUNK)
        if not chunk:
            return None
        try:
            piece = unpacker.decompress(chunk)
        except zlib.error:
            return None
        at += len(chunk) - len(unpacker.unused_data)
        if seen < len(VERSION):
            head = (b"".join(out) + piece)[: len(VERSION)]
            if not VERSION.startswith(head):
                return None
        seen += len(piece)
        out.append(piece)
    return (b"".join(out), at) if seen >= len(VERSION) else None


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
    kind = fields["WARC-Type"]
    return {
        "record_id": fields["WARC-Record-ID"],
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_digest": digest(payload) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": length,
        "payload": payload if kind == "response" else None,
    }


def _starts(window: _Window, lo: int, hi: int) -> tuple[bytes, int, int] | None:
    """The first record that starts in [lo, hi): its text, start and end."""
    at = lo
    while at < hi:
        found = window.bytes(at, min(CHUNK, hi - at) + len(MAGIC) - 1).find(MAGIC)
        if found < 0:
            at += min(CHUNK, hi - at)
            continue
        at += found
        member = _member(window, at)
        # a member inside a stored block of another one does not end where a member or the file ends
        if member and (member[1] >= window.size or window.bytes(member[1], len(MAGIC)) == MAGIC):
            return member[0], at, member[1]
        at += 1
    return None


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the last record that starts in each range ends; ranges without one have no row."""
    for batch in batches:
        for r in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(r["path"])
            with fs.open_input_file(path) as file:
                window, end = _Window(file, r["size"]), None
                record = _starts(window, r["lo"], r["hi"])
                while record is not None:
                    end = max(end or 0, record[2])
                    if end >= r["hi"]:
                        break
                    member = _member(window, record[2])
                    record = (member[0], record[2], member[1]) if member else _starts(window, record[2] + 1, r["hi"])
            if end is not None:
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "lo": [r["lo"]], "end": [end]})


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    for batch in batches:
        for r in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(r["path"])
            with fs.open_input_file(path) as file:
                window, rows, held = _Window(file, r["size"]), [], 0
                record = _starts(window, max(r["lo"], r["begin"]), r["hi"])
                while record is not None:
                    rows.append(_parse(record[0]))
                    held += len(record[0])
                    if held > 2 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                    if record[2] >= r["hi"]:
                        break
                    member = _member(window, record[2])
                    record = (member[0], record[2], member[1]) if member else _starts(window, record[2] + 1, r["hi"])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, archives: list[tuple[str, int]], split_bytes: int = 4 << 20) -> DataFrame:
    """The records of archives given by path and size, read in ranges of ``split_bytes``; columns: :data:`READ`."""
    files = spark.createDataFrame([(qualified(spark, p), n) for p, n in archives], "path string, size long")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("lo"))
    ranges = ranges.withColumn("hi", F.least(F.col("lo") + split_bytes, F.col("size")))
    count = max(1, min(100_000, sum(-(-n // split_bytes) for _, n in archives)))
    dealt = ranges.repartition(count, F.xxhash64("path", "lo"))
    cut = dealt.where(F.col("size") > split_bytes)  # an archive of one range has nothing before it
    ends = cut.mapInArrow(_ends, "path string, lo long, end long")
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.join(ends, ["path", "lo"], "left").select("path", "lo", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")).alias("begin"))
    placed = ranges.join(begins, ["path", "lo"]).where("begin < hi")  # a row a range
    return placed.repartition(count, F.xxhash64("path", "lo")).mapInArrow(_reader, READ)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: all ``pages`` written as archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = write_warc(pages, scratch_path(spark, "warc"))
    return read_warc(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
