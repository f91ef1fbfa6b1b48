"""Media columns: ISO base media containers written and read box by box (operator 9).

``write_media`` stores a payload of bytes as a raw 8-bit grey video track, one sample (frame) of ``frame_bytes`` after the other:
ftyp, moov with the sample tables, and mdat. A frame that differs much from the one before it starts a scene and is a sync sample.
``probe_media`` walks the nested boxes of any such container, decodes the sample tables of every track (sizes, chunks, times, sync
samples) and those of movie fragments (track runs), and returns codec, duration and the byte ranges of the sync samples; it reads
no payload. ``read_payload`` reads the samples back through the tables, and digests them.

Nothing that a file claims is allocated before it is checked against the file's length: a container can't hold more samples than
it has bytes, nor boxes deeper than ``DEPTH``.

Edge cases: a null or empty text is one frame of padding; a text of any length is stored whole (64-bit chunk offsets and box sizes
beyond 4 GB); a broken container gives nulls and the reason in ``error``; a timescale of 0 gives a null duration; repeated rows give
equal values; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.llm._text import texts_of

FRAME = 576  # 24 x 24 grey pixels
SIDE = 24
CHUNK = 64  # samples in a chunk
TIMESCALE = 25
#: Boxes that only hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def sync_samples(payload: np.ndarray, change: float = 33.0) -> np.ndarray:
    """1-based numbers of frames that start a scene: the first, and those whose mean step from the frame before is above ``change``."""
    frames = payload.reshape(-1, FRAME)
    step = np.abs(np.diff(frames.astype(np.int16), axis=0)).mean(1)
    return np.concatenate([[1], np.flatnonzero(step > change) + 2])


def container(payload: bytes) -> bytes:
    """The payload (a positive multiple of a frame) as a container."""
    n = len(payload) // FRAME
    sync = sync_samples(np.frombuffer(payload, np.uint8))
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, CHUNK), (chunks, n % CHUNK)] if chunks > 1 else [(1, n)]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(start: int) -> bytes:
        places = start + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * FRAME)
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(">I", chunks), places.astype(">u8").tobytes()),
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3), media)
        movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, track)

    wide = len(payload) + 8 >= 1 << 32
    before = len(head) + len(moov(0)) + (16 if wide else 8)
    size = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join([head, moov(before), size, payload])


DEPTH = 32


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, containers before what they hold, in the order of the file."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(start, len(data) if end is None else end, ())]
    while todo:
        start, end, path = todo.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a long box header is cut short")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} reaches beyond what holds it")
        yield (*path, kind), body, start + size
        todo.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(path) >= DEPTH:
                raise ValueError("boxes are nested too deeply")
            todo.append((body, start + size, (*path, kind)))


@dataclass
class Track:
    codec: str
    timescale: int
    ticks: int
    offset: np.ndarray
    size: np.ndarray
    sync: np.ndarray  # 0-based sample numbers

    @property
    def duration(self) -> float | None:
        return self.ticks / self.timescale if self.timescale else None


def _table(data: memoryview, boxes: dict[bytes, tuple[int, int]], kind: bytes, dtype: str, columns: int, skip: int = 8) -> np.ndarray | None:
    """The rows of a counted table; its count is held against the box."""
    if kind not in boxes:
        return None
    a, b = boxes[kind]
    n = struct.unpack_from(">I", data, a + skip - 4)[0]
    if a + skip + n * columns * np.dtype(dtype).itemsize > b:
        raise ValueError(f"table {kind!r} is cut short")
    return np.frombuffer(data, dtype, n * columns, a + skip).astype(np.int64).reshape(n, columns)


def _samples(data: memoryview, t: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offset, size, sync samples, ticks) from a track's sample tables."""
    a, b = t[b"stsz"]
    if a + 12 > b:
        raise ValueError("table b'stsz' is cut short")
    fixed, n = struct.unpack_from(">II", data, a + 4)
    if n > len(data) or n * fixed > len(data):
        raise ValueError("more samples than the file has bytes")
    size = np.full(n, fixed, np.int64) if fixed else _table(data, t, b"stsz", ">u4", 1, 12).ravel()
    places = _table(data, t, b"co64", ">u8", 1)
    places = _table(data, t, b"stco", ">u4", 1) if places is None else places
    times, groups = _table(data, t, b"stts", ">u4", 2), _table(data, t, b"stsc", ">u4", 3)
    if places is None or times is None or groups is None:
        raise ValueError("a sample table is missing")
    places = places.ravel()
    runs = np.diff(np.append(groups[:, 0], len(places) + 1))
    if (runs < 0).any() or (len(groups) and groups[0, 0] != 1) or runs.sum() != len(places):
        raise ValueError("the chunk table does not cover the chunks")
    per_chunk = np.repeat(groups[:, 1], runs)
    if per_chunk.sum() != n:
        raise ValueError("the chunk table does not cover the samples")
    first = np.cumsum(per_chunk) - per_chunk
    before = np.append(np.cumsum(size) - size, 0)
    offset = np.repeat(places, per_chunk) + before[:-1] - np.repeat(before[np.minimum(first, n)], per_chunk)
    sync = _table(data, t, b"stss", ">u4", 1)
    sync = np.arange(n) if sync is None else sync.ravel() - 1
    ticks = int((times[:, 0] * times[:, 1]).sum())
    return offset, size, sync, ticks


_NOT_SYNC = 1 << 16  # the flag of samples that depend on others


def _fragment(data: memoryview, moof: int, boxes: list[tuple[bytes, int, int]], defaults: dict[int, tuple[int, int, int]]) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]:
    """(track id, [(offset, size, is sync, ticks) of each run]) of a track fragment."""
    track, base, runs, after = 0, moof, [], moof
    duration = size = flags = 0
    for kind, a, b in boxes:
        if a + 8 > b:
            raise ValueError(f"box {kind!r} is cut short")
        head, given = struct.unpack_from(">II", data, a)
        head &= 0xFFFFFF
        if kind == b"tfhd":
            track, place = given, a + 8
            duration, size, flags = defaults.get(track, (0, 0, 0))
            if head & 1:
                base, place = struct.unpack_from(">Q", data, place)[0], place + 8
            place += 4 * bool(head & 2)
            for flag in (8, 16, 32):
                if head & flag:
                    x, place = struct.unpack_from(">I", data, place)[0], place + 4
                    duration, size, flags = (x, size, flags) if flag == 8 else (duration, x, flags) if flag == 16 else (duration, size, x)
            after = base
        elif kind == b"trun":
            n, place = given, a + 8
            if head & 1:
                after, place = base + struct.unpack_from(">i", data, place)[0], place + 4
            first = None
            if head & 4:
                first, place = struct.unpack_from(">I", data, place)[0], place + 4
            fields = [f for f in (0x100, 0x200, 0x400, 0x800) if head & f]
            if n > len(data) or place + 4 * n * len(fields) > b:
                raise ValueError("a track run is cut short")
            table = np.frombuffer(data, ">u4", n * len(fields), place).astype(np.int64).reshape(n, len(fields))
            of = lambda f, default: table[:, fields.index(f)] if f in fields else np.full(n, default, np.int64)  # noqa: B023, E731
            sizes, own = of(0x200, size), of(0x400, flags)
            if first is not None and n:
                own = own.copy()
                own[0] = first
            if int(sizes.sum()) > len(data):
                raise ValueError("more samples than the file has bytes")
            runs.append((after + np.cumsum(sizes) - sizes, sizes, own & _NOT_SYNC == 0, int(of(0x100, duration).sum())))
            after += int(sizes.sum())
    return track, runs


def tracks(blob: bytes) -> list[Track]:
    """The tracks of a container, from its tables alone; samples of movie fragments follow those of the movie's own tables."""
    data = memoryview(blob)
    found: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[tuple[int, list[tuple[bytes, int, int]]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    moof = 0
    for path, a, b in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1][path[-1]] = (a, b)
        elif path == (b"moov", b"mvex", b"trex"):
            track, _, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = (duration, size, flags)
        elif path == (b"moof",):
            moof = a - 8
        elif path == (b"moof", b"traf"):
            fragments.append((moof, []))
        elif path[:2] == (b"moof", b"traf") and path[-1] in (b"tfhd", b"trun"):
            fragments[-1][1].append((path[-1], a, b))
    runs: dict[int, list] = {}
    for start, boxes in fragments:
        track, more = _fragment(data, start, boxes, defaults)
        runs.setdefault(track, []).extend(more)
    out = []
    for t in found:
        a, b = t[b"mdhd"]
        timescale = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        number = struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] == 1 else 12))[0]
        a, b = t[b"stsd"]
        if a + 16 > b:
            raise ValueError("no sample description")
        codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        offset, size, sync, ticks = _samples(data, t)
        for more_offset, more_size, is_sync, more_ticks in runs.get(number, []):
            sync = np.append(sync, np.flatnonzero(is_sync) + len(size))
            offset, size, ticks = np.append(offset, more_offset), np.append(size, more_size), ticks + more_ticks
        if len(offset) and (int(offset.min()) < 0 or int((offset + size).max()) > len(data) or int(size.min()) < 0):
            raise ValueError("a sample lies outside the file")
        if len(sync) and (int(sync.min()) < 0 or int(sync.max()) >= len(size)):
            raise ValueError("a sync sample that is none of the samples")
        out.append(Track(codec, timescale, ticks, offset, size, sync))
    if not out:
        raise ValueError("no track")
    return out


def payload_of(blob: bytes, track: Track) -> bytes:
    """The track's samples in order, read through its tables; neighbouring samples are read at once."""
    if not len(track.offset):
        return b""
    breaks = np.flatnonzero(track.offset[1:] != track.offset[:-1] + track.size[:-1]) + 1
    starts, ends = np.append(0, breaks), np.append(breaks, len(track.offset)) - 1
    total = int(track.size.sum())
    if total > len(blob):
        raise ValueError("samples overlap: more bytes than the file has")
    return b"".join(blob[track.offset[a] : track.offset[b] + track.size[b]] for a, b in zip(starts, ends, strict=True))


def write_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``media`` (the container) in place of the text, and ``n_bytes`` of the unpadded payload."""
    rest = [f for f in docs.schema.fields if f.name not in (column, "media", "n_bytes")]
    schema = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                data, offsets = texts_of(part.column(column))
                media = []
                for i in range(len(part)):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    media.append(container(raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))))
                columns = [part.column(f.name) for f in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


_LONG, _STRING = T.LongType(), T.StringType()
_RANGE = T.ArrayType(T.StructType([T.StructField("offset", _LONG), T.StructField("bytes", _LONG)]))
_ARROW = {_LONG: pa.int64(), _STRING: pa.string(), T.DoubleType(): pa.float64(), _RANGE: pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))}
_PROBED = [("codec", _STRING), ("duration", T.DoubleType()), ("samples", _LONG), ("keyframes", _LONG), ("keyframe_ranges", _RANGE), ("tracks", _LONG), ("media_bytes", _LONG), ("error", _STRING)]
_PAYLOAD = [("payload_bytes", _LONG), ("payload_sha256", _STRING), ("tail_crc32", _LONG), ("media_sha256", _STRING)]
_FAULTS = (ValueError, KeyError, IndexError, OverflowError, struct.error)


def _mapped(media: DataFrame, fields: list[tuple[str, T.DataType]], one, drop_media: bool) -> DataFrame:
    """``media`` with the columns that ``one`` makes of each container; columns of those names give way."""
    names = [n for n, _ in fields]
    rest = [f for f in media.schema.fields if f.name not in names and not (drop_media and f.name == "media")]
    schema = T.StructType([*rest, *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                got = list(zip(*[one(x.as_py()) for x in part.column("media")], strict=True)) or [[]] * len(fields)
                made = [pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(got, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], *made], names=schema.names)

    return media.mapInArrow(run, schema)


def probe_media(media: DataFrame, keep_media: bool = False) -> DataFrame:
    """codec, duration, samples, keyframes and keyframe_ranges (offset, bytes) of the first track, the number of tracks, the size, and
    ``error``, from the tables of the container in ``media``."""

    def one(blob: bytes | None) -> tuple:
        if blob is None:
            return (*[None] * 7, "no container")
        try:
            all_tracks = tracks(blob)
        except _FAULTS as e:
            return (*[None] * 6, len(blob), str(e) or type(e).__name__)
        track = all_tracks[0]
        ranges = [{"offset": a, "bytes": b} for a, b in zip(track.offset[track.sync].tolist(), track.size[track.sync].tolist(), strict=True)]
        return track.codec, track.duration, len(track.size), len(track.sync), ranges, len(all_tracks), len(blob), None

    return _mapped(media, _PROBED, one, not keep_media)


def read_payload(media: DataFrame) -> DataFrame:
    """Size and digests of the first track's samples, read back from ``media``, and the container's own digest; ``media`` is dropped."""

    def one(blob: bytes | None) -> tuple:
        if blob is None:
            return (None,) * 4
        digest = hashlib.sha256(blob).hexdigest()
        try:
            payload = payload_of(blob, tracks(blob)[0])
        except _FAULTS:
            return None, None, None, digest
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), digest

    return _mapped(media, _PAYLOAD, one, True)
