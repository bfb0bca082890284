"""WARC archives of one gzip member a record, with a splittable reader.

The writer makes one archive a task, under a name of that attempt, and
reports it; only reported archives count.  Of records with equal payloads the
one with the smallest page id is a response, the others are revisits that
refer to it and hold no payload.

The reader cuts archives into byte ranges.  A task scans its range for the
gzip magic, tries to decode a WARC head at each place it finds, checks that
the member ends where another begins or the file ends, and owns the records
that start inside its range, reading past its end for the last one.  From the
first record on every place is known where a member must start, and so at the
start of a file; the member that follows a range's last one is decoded as
well, for the task that owns it can't tell a damaged first member from chance
bytes.  A member that must start and doesn't decode raises ValueError: an
archive is read whole or not at all.

Defined results: payloads are written whole, however long; a null one is empty; a null page id is never referred to
if its group has another, and null ids come back as null; rows that repeat
both the smallest id and the payload are all responses; a null url is written
as urn:page:<id>; an empty table gives no archives and no rows.  Of pages only
page_id, url and html are read: other columns, whatever their names, are not
part of a record and don't come back.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder
from .token_files import opened

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a range by default, and of one read beyond it.
RANGE, STEP = 4 << 20, 1 << 20
#: A broadcast table of repeated payloads has so many rows at most (28 bytes each); above, the join is shuffled.
BROADCAST_REPEATS = 50_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None = None, date: str = DATE) -> bytes:
    """A record's bytes before compression; a revisit if ``first`` is given."""
    digest = digest_of(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if first is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-Id: {first}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def fields(head: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def parsed(data: bytes) -> dict:
    """A record's fields, payload and full payload size.  A response whose digests don't match raises ValueError."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    own = fields(head)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = own["warc-payload-digest"].removeprefix("sha1:")
    response = own["warc-type"] == "response"
    if not gap or len(block) != int(own["content-length"]) or own.get("warc-block-digest", f"sha1:{digest_of(block)}") != f"sha1:{digest_of(block)}" or response and digest_of(payload) != digest:
        raise ValueError(f"a record's bytes don't match its head: {own.get('warc-record-id')}")
    return {
        "page_id": int(own["x-page-id"]) if "x-page-id" in own else None, "url": own.get("warc-target-uri"), "record_type": own["warc-type"], "payload_digest": digest, "payload_bytes": len(payload) if response else int(fields(http)["content-length"]),
        "refers_to": int(own["x-refers-to-page-id"]) if "x-refers-to-page-id" in own else None, "payload": payload if response else None,
    }


class Window:
    """A file's bytes from a place on, read as they are needed."""

    def __init__(self, file: pa.NativeFile, start: int, end: int):
        self.file, self.start, self.size = file, start, file.size()
        file.seek(start)
        self.data = bytearray(file.read(max(0, min(end + len(MAGIC) - 1, self.size) - start)))

    def more(self) -> bool:
        new = self.file.read(STEP)
        self.data += new
        return bool(new)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The WARC member at a place in the data and where it ends; None if there is none."""
        z, out, pos = zlib.decompressobj(31), bytearray(), at
        while not z.eof:
            if pos >= len(self.data) and not self.more():
                return None
            part = bytes(self.data[pos : pos + 65536])
            pos += len(part)
            try:
                out += z.decompress(part)
            except zlib.error:
                return None
            if not out.startswith(HEAD[: len(out)]):
                return None
        end = pos - len(z.unused_data)
        while len(self.data) < end + len(MAGIC) and self.more():
            pass
        follows = bytes(self.data[end : end + len(MAGIC)])
        return (bytes(out), end) if out.startswith(HEAD) and (not follows or follows == MAGIC) else None

    def due(self, at: int) -> tuple[bytes, int]:
        """The member that must start at a place."""
        found = self.member(at)
        if found is None:
            raise ValueError(f"no whole WARC member at byte {self.start + at}")
        return found

    def first(self, end: int) -> int | None:
        """Where the first member that starts before ``end`` does: at the file's start, else at the first magic that decodes."""
        at = 0 if not self.start and self.size else self.data.find(MAGIC)
        while self.start and 0 <= at < end - self.start and self.member(at) is None:
            at = self.data.find(MAGIC, at + 1)
        return at if 0 <= at < end - self.start else None


def records(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The records that start within a byte range of an archive; ValueError where one of them, or the one after them, is damaged."""
    window = Window(file, start, end)
    at = window.first(end)
    if at is None:
        return
    while start + at < min(end, window.size):
        data, at = window.due(at)
        yield data
    if start + at < window.size:
        window.due(at)


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (text), first: the page a row revisits, null for responses.

    Only payloads that occur more than once are joined, by digest.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    again = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = cut(again.select("sha1", "first"))
    few = again.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS
    df = rows.join(F.broadcast(again) if few else again.hint("merge"), "sha1", "left")
    return df.select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives and returns them: path, length, records."""
    where, root = opened(folder)
    where.create_dir(root, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = opened(folder)
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        head = next(rows, None)
        if head is None:
            return
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        length = n = 0
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            for page_id, url, payload, first in itertools.chain([head], rows):
                data = member(record(page_id, url, payload.encode("utf-8"), first))
                out.write(data)
                length, n = length + len(data), n + 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": pa.array([length], pa.int64()), "records": pa.array([n], pa.int64())})

    return cut(with_first(pages, min_bytes).mapInArrow(store, "path string, length long, records long"))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of all archives in a folder, for read()."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


def read(files: DataFrame, size: int = RANGE, payload: bool = True) -> DataFrame:
    """One row per record of the archives (path, length): page_id, url, record_type, payload_digest, payload_bytes, refers_to, and the payload if asked for (null for revisits)."""
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + size).alias("end"))
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64()} | ({"payload": pa.string()} if payload else {})

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                where, at = opened(path)
                with where.open_input_file(at) as file:
                    rows, held = [], 0
                    for data in records(file, start, end):
                        row = parsed(data)
                        held += len(data)
                        rows.append(row | ({"payload": row["payload"].decode("utf-8") if row["payload"] is not None else None} if payload else {}))
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], v) for k, v in kinds.items()})
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], v) for k, v in kinds.items()})

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{k} {'long' if v == pa.int64() else 'string'}" for k, v in kinds.items())
    return ranges.repartition(n).mapInArrow(load, schema)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, payload: bool = False) -> DataFrame:
    """Writes the pages to archives and reads them back; ValueError if the archives hold other records than were written.

    The records without payloads are kept in the shared folder, for their number is held against the writer's first.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    files = write(pages, folder, min_bytes)
    rows = cut(read(files, payload=False))
    written, found = files.agg(F.sum("records")).first()[0] or 0, rows.count()
    if written != found:
        raise ValueError(f"{written} records were written and {found} read")
    return read(files) if payload else rows
