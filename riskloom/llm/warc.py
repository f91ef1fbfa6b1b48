"""WARC archives with a salvage reader (operator 2).

Writing: records of a partition, in a fixed order, go to compressed archives in a shared folder, one gzip
member a record; a task that runs again writes the same files. Records with equal payloads of at least
``min_bytes`` are stored once: the one with the smallest id is the response, the others are revisit
records without a body that name it.

Reading: Spark's binary file source hands out whole archives (of bounded size). Members are read one after another; each must
inflate, pass its checksum, start with a version line, and hold as many bytes as its headers say with the block digest they give.
After any failed check the reader searches on, byte by byte, for the next gzip member or version line that starts a valid record;
the bytes passed over become a ``gap`` row with the reason, and later records are recovered. Members are inflated as far as they
go: records before, between and after damage inside a member are recovered as well, each by its own digest.

Every byte of an archive is in ``start``..``end`` of exactly one row: rows of one member share it, so the first carries its bytes
and the others stand empty at its end; their places in the inflated bytes are ``inner_start``..``inner_end`` (null outside members).
A damaged member whose end is unknown is a gap up to the next valid record, and its recovered records stand empty at its start.

Edge cases: a null payload counts as empty; a null id has no id header and comes back null, and is never preferred as a response;
rows that share the smallest id of a group are all responses; repeated rows are separate records; an empty table writes no archive
and reads back as no rows; other columns of ``pages`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm._shared import cut, mounted, new_folder, write_whole

ARCHIVE_BYTES = 32 << 20
VERSION = b"WARC/1.1"
_MAGIC = b"\x1f\x8b\x08"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit of that page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest or _digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
        *([("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to is not None else []),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; raises ValueError with the check that failed."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError("no version line")
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        raise ValueError("headers do not end")
    lines = data[at:split].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = _number(headers.get("content-length"))
    if size is None or size < 0:
        raise ValueError("no content length")
    block = data[split + 4 : split + 4 + size]
    end = split + 4 + size + 4
    if len(block) < size or data[end - 4 : end] != b"\r\n\r\n":
        raise ValueError("block of another length")
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != _digest(block):
        raise ValueError("block digest differs")
    return headers, block, end


_FEED = 1 << 14


def _body(data: bytes, at: int) -> int:
    """Where the compressed bytes of the gzip member at ``at`` begin."""
    if len(data) < at + 18:
        raise ValueError("member is cut short")
    flags, place = data[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            place = data.find(b"\0", place) + 1
            if not place:
                raise ValueError("member header does not end")
    return place + 2 * bool(flags & 2)


def inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(bytes, end, fault) of the gzip member at ``at``, inflated as far as it goes; ``end`` is known if there is no fault."""
    place, out, crc, size = _body(data, at), [], 0, 0
    unpack, feed, n = zlib.decompressobj(-15), _FEED, len(data)
    while not unpack.eof and place < n:
        before = unpack.copy() if feed == _FEED else None
        try:
            got = unpack.decompress(data[place : place + feed])
        except zlib.error as e:
            if before is None:
                return b"".join(out), place, f"member does not inflate: {e}"
            unpack, feed = before, 1  # what comes before the fault comes byte by byte
            continue
        out.append(got)
        crc, size, place = zlib.crc32(got, crc), size + len(got), place + feed
    if not unpack.eof:
        return b"".join(out), n, "member is cut short"
    end = min(place, n) - len(unpack.unused_data)
    if n < end + 8:
        return b"".join(out), n, "member is cut short"
    want = (int.from_bytes(data[end : end + 4], "little"), int.from_bytes(data[end + 4 : end + 8], "little"))
    return b"".join(out), end + 8, None if want == (crc, size & 0xFFFFFFFF) else "member checksum differs"


def _inside(raw: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of a member's inflated bytes, covering all of them."""
    at, gap = 0, None
    while at < len(raw):
        try:
            headers, block, end = parse(raw, at)
        except ValueError as e:
            gap = gap or (at, str(e))
            line = raw.find(b"WARC/", at + 1)
            at = line if line >= 0 else len(raw)
            continue
        if gap:
            yield "gap", gap[0], at, gap[1]
            gap = None
        yield "record", at, end, (headers, block)
        at = end
    if gap:
        yield "gap", gap[0], at, gap[1]


def _next_member(data: bytes, start: int, end: int) -> int | None:
    """The first member between start and end that holds a record."""
    while 0 <= (start := data.find(_MAGIC, start)) < end:
        try:
            if any(r[0] == "record" for r in _inside(inflate(data, start)[0])):
                return start
        except ValueError:
            pass
        start += 1
    return None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, int | None, int | None]]:
    """("record", start, end, (headers, block), inner start, inner end) and ("gap", start, end, reason, inner start, inner end)."""
    at, n = 0, len(data)
    gap: tuple[int, str] | None = None
    while at < n:
        rows: list[tuple] = []
        fault, lines = None, at + 1
        try:
            if data[at : at + 3] == _MAGIC:
                raw, end, fault = inflate(data, at)
                rows = list(_inside(raw))
                if not any(r[0] == "record" for r in rows):
                    raise ValueError(fault or (rows[0][3] if rows else "member is empty"))
            else:
                headers, block, end = parse(data, at)
                rows = [("record", None, None, (headers, block))]
        except ValueError as e:
            gap = gap or (at, str(e))
        else:
            if gap:
                yield "gap", gap[0], at, gap[1], None, None
                gap = None
            known = not fault or fault == "member checksum differs" and (end == n or data[end : end + 3] == _MAGIC or data[end : end + 5] == b"WARC/")
            if not known:  # its end may be anywhere: a member that was cut reads on into the next
                following = _next_member(data, at + 1, end)
                if following:
                    end = following
                    rows = list(_inside(inflate(data[:end], at)[0])) if end >= at + 18 else []
                for kind, a, b, x in rows:
                    yield kind, at, at, x, a, b
                gap, lines = (at, fault), end  # lines before that are those of its own records, stored as they are
            else:
                for k, (kind, a, b, x) in enumerate(rows):
                    yield kind, end if k else at, end, x, a, b
                at = end
                continue
        found = (data.find(_MAGIC, at + 1), data.find(b"WARC/", max(lines, at + 1)))
        at = min((x for x in found if x >= 0), default=n)
    if gap:
        yield "gap", gap[0], n, gap[1], None, None


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with payload_digest (hex SHA-1) and refers_to (null for responses)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.withColumn("_sha1", F.sha1(payload))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    # Only payloads that occur more than once take part in the join; the large column moves once.
    groups = pages.filter(large).groupBy("_sha1").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 AND _first IS NOT NULL").drop("_n")
    return pages.join(groups, "_sha1", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first"))).drop("_first")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, compress: bool = True) -> DataFrame:
    """Writes (page_id, url, html) as archives under ``folder``; returns (path, records, bytes) of each, already written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, members, size, records = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> None:
            path = os.path.join(mounted(folder), f"part-{part:05d}-{len(out):05d}.warc{'.gz' if compress else ''}")
            write_whole(path, *members)
            out.append((path, records, size))

        for batch in batches:
            ids, urls, pages_, refs, shas = (batch.column(c) for c in ("page_id", "url", "html", "refers_to", "_sha1"))
            for i in range(len(batch)):
                digest = base64.b32encode(bytes.fromhex(shas[i].as_py())).decode()
                raw = record(ids[i].as_py(), urls[i].as_py(), (pages_[i].as_py() or "").encode(), refs[i].as_py(), digest)
                if compress:
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = pack.compress(raw) + pack.flush()
                if members and size + len(raw) > ARCHIVE_BYTES:
                    flush()
                    members, size, records = [], 0, 0
                members.append(raw)
                size, records = size + len(raw), records + 1
        if members:
            flush()
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "records", "bytes"])

    ready = classify(pages.select(F.col("page_id").cast("long"), "url", "html"), min_bytes)
    # A fixed order in each partition: a task that runs again writes the same archives.
    ready = ready.select("page_id", "url", "html", "refers_to", "_sha1").sortWithinPartitions("page_id", "_sha1", "url")
    return cut(ready.mapInArrow(run, "path string, records long, bytes long"))


_LONG, _STRING = T.LongType(), T.StringType()
_FIELDS = [
    ("kind", _STRING), ("path", _STRING), ("start", _LONG), ("end", _LONG), ("inner_start", _LONG), ("inner_end", _LONG), ("reason", _STRING),
    ("page_id", _LONG), ("url", _STRING), ("record_type", _STRING), ("payload_digest", _STRING), ("payload_bytes", _LONG), ("refers_to", _LONG),
    ("payload", T.BinaryType()), ("archive_gaps", _LONG), ("archive_gap_bytes", _LONG),
]
READ = T.StructType([T.StructField(n, t) for n, t in _FIELDS])


def _number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.removeprefix("-").isdecimal() and len(text) < 19 else None


def _page(text: str | None) -> int | None:
    return _number((text or "").rstrip(">").rpartition(":")[2])


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record and per quarantined gap of the archives under ``folder``, each with its archive's number of gaps and of the
    bytes in them. A record whose payload does not match its digest is quarantined as well."""

    def rows_of(path: str, data: bytes) -> list[tuple]:
        rows: list[tuple] = []
        for kind, start, end, x, a, b in salvage(data):
            at = (path, start, end, a, b)
            if kind == "gap":
                rows.append(("gap", *at, x, *[None] * 7))
                continue
            headers, block = x
            revisit = headers.get("warc-type") == "revisit"
            payload = block.partition(b"\r\n\r\n")[2]
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if not revisit and digest != _digest(payload):
                rows.append(("gap", *at, "payload digest differs", *[None] * 7))
                continue
            size, page = _number(headers.get("x-payload-length")) if revisit else len(payload), _number(headers.get("x-page-id"))
            refers = _page(headers.get("warc-refers-to")) if revisit else None
            kept = payload if with_payload and not revisit else None
            rows.append(("record", *at, None, page, headers.get("warc-target-uri"), headers.get("warc-type"), digest, size, refers, kept))
        gaps = [r for r in rows if r[0] == "gap"]
        lost = sum((r[3] - r[2]) or (r[5] or 0) - (r[4] or 0) for r in gaps)
        return [(*r, len(gaps), lost) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {_LONG: pa.int64(), _STRING: pa.string(), T.BinaryType(): pa.binary()}
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = rows_of(path, content.as_buffer().to_pybytes())
                columns = list(zip(*rows, strict=True)) or [[]] * len(READ)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=READ.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInArrow(run, READ)


def gap_log(read: DataFrame) -> DataFrame:
    """The quarantined gaps among the rows of ``read_warc``."""
    return read.filter("kind = 'gap'").select("path", "start", "end", "inner_start", "inner_end", "reason")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to a fresh shared folder and reads them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    if write_warc(pages, folder, min_bytes).isEmpty():
        return spark.createDataFrame([], READ)
    return read_warc(spark, folder)
