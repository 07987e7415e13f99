"""WARC archives: a writer with revisit records and a splittable reader.

Writer. Each record is a gzip member of its own. Payloads are compared by SHA-1 digest;
the record of the smallest page_id is the response, equal ones are revisits that name it.
Only digests and ids are shuffled to find the payloads that occur twice. Up to BROADCAST_ROWS
of these go to every task, which then writes its pages where it reads them. Beyond, pages
are joined with them by digest; rows of very frequent payloads keep their place in no
group, but are dealt evenly, and travel without their payload unless they are responses.

Reader. A task gets a byte range of one archive, scans it for the gzip magic number,
validates a candidate by decoding its start as a WARC version line and headers, and owns
the records that start inside its range; from there on it goes from member to member, and
reads beyond the range only to end the last record. So ranges of any size give each record
once. Archives without compression are scanned for version lines in the same way.

Archives lie in a shared folder; they are read and written through Arrow's file systems (a
local path, HDFS or an object store that Arrow opens), each file under its own name at once,
so a task that runs again replaces its own file.

Edge cases: a null html is an empty payload; a null url is an empty target; a null
page_id is a revisit of the least id with its payload, or a response if there is none;
repeated rows give a record each, those of the least id a response each; payloads and
headers of any length stay whole; empty tables give no archive; extra columns are ignored.
In an archive without compression, a payload that itself holds a whole WARC header is told
apart only by a task that owns the record around it.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, bound_batches, join_skewed, materialize, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive for each task, and of one read.
RANGE, READ = 16 << 20, 1 << 20
LEVEL = 4
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    raw = b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def _target(url: str | None) -> str:
    return re.sub(r"[\r\n]", " ", url or "")


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def response_member(page_id: int | None, url: str | None, payload: bytes, sha: str, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Target-URI", _target(url)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(head, http + payload)


def revisit_member(page_id: int | None, url: str | None, length: int, sha: str, refers_to: int, date: str) -> bytes:
    head = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Target-URI", _target(url)), ("WARC-Date", date),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Bytes", str(length)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` under ``folder``; one row a file.

    ``date`` goes into every record, so that a task that runs again writes the same bytes.
    """
    bound_batches(pages.sparkSession)
    sha = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    plain = pages.select(F.col("page_id").cast("long"), "url", "html", sha.alias("sha"))
    first = plain.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "warc-first")
    if first.limit(broadcast_rows + 1).count() <= broadcast_rows:
        ready = plain.join(F.broadcast(first.drop("n")), "sha", "left")
    else:
        total = pages.count()
        frequent = F.broadcast(first.where(F.col("n") > total / 1000).select("sha", F.col("first").alias("known")))
        again = F.col("known").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("known"))
        bare = plain.withColumn("bytes", F.octet_length(F.coalesce("html", F.lit("")))).join(frequent, "sha", "left")
        ready = join_skewed(bare.select("sha", "page_id", "url", "bytes", F.when(~again, F.col("html")).alias("html")), first, "sha", total)
    if "bytes" not in ready.columns:
        ready = ready.withColumn("bytes", F.octet_length(F.coalesce("html", F.lit(""))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft, path = f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}"
        out, size, n = None, 0, 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "sha", "bytes", "first")]
            for page_id, url, sha, length, first_id, text in zip(*columns, b.column("html")):
                code = base64.b32encode(sha).decode()
                if first_id is not None and page_id != first_id:
                    data = revisit_member(page_id, url, length, code, first_id, date)
                else:
                    data = response_member(page_id, url, (text.as_py() or "").encode("utf-8", "replace"), code, date)
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(draft)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            store.move(draft, path)
            yield pa.RecordBatch.from_pylist([{"file": posixpath.join(folder, name), "size": size, "records": n}])

    return ready.select("sha", "page_id", "url", "bytes", "html", "first").mapInArrow(write, "file string, size long, records long")


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without HTTP headers."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def parse_record(raw: bytes, offset: int) -> Record | None:
    """A record from its decoded bytes; None if they aren't one."""
    if not _VERSION.match(raw):
        return None
    head, mark, rest = raw.partition(b"\r\n\r\n")
    headers: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not mark or not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return None
    return Record(offset, headers, rest[: int(headers["content-length"])])


class _Window:
    """Forward reads of a file from any place, in steps of READ bytes."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, b""
        file.seek(start)

    def fill(self, upto: int) -> bool:
        """Hold the bytes before ``upto``; False at the end of the file."""
        while self.base + len(self.data) < upto:
            more = self.file.read(READ)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, before: int) -> None:
        if before - self.base > READ:
            self.data, self.base = self.data[before - self.base :], before


def _gzip_member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """Decoded bytes of the member at ``at`` and the place of its end; None if it isn't a WARC record."""
    gz, parts, pos, checked = zlib.decompressobj(31), [], at, False
    try:
        while not gz.eof:
            w.fill(pos + READ)
            piece = w.data[pos - w.base : pos - w.base + READ]
            if not piece:
                return None
            parts.append(gz.decompress(piece))
            pos += len(piece)
            if not checked and len(parts[-1]):
                if not _VERSION.match(b"".join(parts)[:16]):
                    return None
                checked = True
    except zlib.error:
        return None
    return b"".join(parts), pos - len(gz.unused_data)


def _plain_record(w: _Window, at: int) -> tuple[Record | None, int, int]:
    """The record at ``at`` of an archive without compression, where its block starts, and 0 for its end."""
    w.fill(at + 32)
    if not _VERSION.match(w.data[at - w.base : at - w.base + 32]):
        return None, 0, 0
    more = True
    seen = at
    while (end := w.data.find(b"\r\n\r\n", seen - w.base)) < 0 and more:  # headers of any length
        seen = max(at, w.base + len(w.data) - 3)
        more = w.fill(w.base + len(w.data) + READ)
    body = w.base + end + 4
    return (parse_record(w.data[at - w.base : body - w.base], at), body, 0) if end >= 0 else (None, 0, 0)


def records_in_range(file, start: int, end: int) -> Iterator[Record]:
    """Records that start in ``[start, end)`` of an open file, compressed or not."""
    file.seek(0)
    zipped = file.read(len(MAGIC)) == MAGIC
    w, at, sure = _Window(file, start), start, False
    while at < end:
        if not sure:  # the first record of the range, or bytes that aren't one
            mark = MAGIC if zipped else b"WARC/"
            w.fill(min(at + READ, end + len(mark) - 1))
            hit = w.data.find(mark, at - w.base)
            if hit < 0:
                nxt = w.base + len(w.data) - len(mark) + 1
                if nxt <= at:
                    return
                at = nxt
                w.drop(at)
                continue
            at = w.base + hit
            if at >= end:
                return
        if zipped:
            found = _gzip_member(w, at)
            record = parse_record(found[0], at) if found else None
            stop = found[1] if found else 0
        else:
            record, body, stop = _plain_record(w, at)
            if record:
                stop = body + int(record.headers["content-length"])
                w.fill(stop + 4)
                record.block = w.data[body - w.base : stop - w.base]
                stop += 4
        sure = record is not None
        if record is None:
            at += 1
            continue
        yield record
        at = stop
        w.drop(at)


READ_SCHEMA = "file string, offset long, record_type string, record_id string, refers_to_id string, target string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, files: DataFrame, payloads: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Records of ``files(file, size)``, see READ_SCHEMA; digests and lengths of responses are computed from what is read.

    Ranges are dealt in turn to a stated number of partitions, which adaptive execution
    doesn't merge: one a range, up to eight for each core.
    """
    pieces = files.select("file", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {range_bytes}L)")).alias("start"), "size")
    n = pieces.count()
    most = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    spread = pieces.repartition(max(1, min(n, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        fields = [("file", pa.string()), ("offset", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to_id", "target", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        for b in batches:
            for piece in b.to_pylist():
                store, path = fs.FileSystem.from_uri(piece["file"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for r in records_in_range(file, piece["start"], min(piece["start"] + range_bytes, piece["size"])):
                        h, payload = r.headers, r.payload
                        revisit = h["warc-type"] == "revisit"
                        sha = h.get("warc-payload-digest", "").partition(":")[2] if revisit else digest(payload)
                        n = int(h.get("x-payload-bytes", "0")) if revisit else len(payload)
                        rows.append((piece["file"], r.offset, h["warc-type"], h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), sha, n, payload if payloads and not revisit else None))
                        held += len(payload) if payloads else 300
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    return spread.select("file", "start", "size").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, one row a record."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = materialize(write_archives(pages, folder), "warc-files")
    return read_archives(spark, files, payloads=False).select(
        F.regexp_extract("record_id", r"<urn:x-page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to_id", r"<urn:x-page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
    )
