"""Keys of texts that occur again anywhere in the table, found without moving the texts or the keys that don't.

1. A task gathers the 64-bit keys of its rows in chunks of about ``chunk_keys``, sorts each chunk, and sends the distinct keys
   with their counts to shards of the key range, as compressed arrays. A key that a third of all rows have is one entry a chunk.
   Keys are taken to be spread evenly over the range: hashes that were chosen by their size must be scrambled first.
   What belongs to a key (row, place) goes with it if the chunk has the key once.
2. A shard adds up the counts and answers each chunk: which of its keys occur more than once, how often, and what belongs to them.
3. What belongs to keys that a chunk has several times is wanted in any case; it travels past the shards as one value a chunk,
   with the chunk's rows, and meets the answers there.

Chunks are named by partition and number, so ``rows`` must come from files or another source that deals the same rows to the same
partition when a task runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._arrays import pack, ranges, unpack

CHUNK_KEYS = 1_000_000
SHARD_BYTES = 16 << 20
_SENT = "shard int, chunk long, keys binary, owners binary, info binary"
_SENT_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("info", pa.binary())]
)

#: keys, what belongs to each (arrays of the same length; the first counts rows of the third part), a row per text
Extracted = tuple[np.ndarray, list[np.ndarray], pa.RecordBatch]


def _way(chunk: int, shards: int) -> int:
    """The shard that a chunk's rows pass by: neighbours take different ones, whatever the number of shards."""
    return ((chunk >> 32) + (chunk & 0xFFFFFFFF)) % shards


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def with_repeats(
    rows: DataFrame,
    extract: Callable[[pa.RecordBatch], Iterator[Extracted]],
    finish: Callable[[pa.Table, np.ndarray, np.ndarray, list[np.ndarray]], pa.Table],
    schema: str,
    shard_bytes: int = SHARD_BYTES,
    chunk_keys: int = CHUNK_KEYS,
) -> DataFrame:
    """What ``finish`` makes of each chunk: it gets the chunk's text rows and, for each key that occurs more than once in the
    whole table, the key, how often it occurs, and what belongs to it (by key, then in the order of the rows)."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[Extracted] = []
        n = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([x[0] for x in held])
            before = np.cumsum([0, *(len(x[2]) for x in held)])
            owners = [np.concatenate(x) for x in zip(*[x[1] for x in held], strict=True)]
            owners[0] = owners[0] + np.repeat(before[:-1], [len(x[0]) for x in held]).astype(owners[0].dtype)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(at, len(keys))).astype(np.uint32)
            keys = keys[at]
            edges = ranges(keys, shards)
            some = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
            once = counts == 1
            owners = [x[order] for x in owners]
            alone, several = ([x[mask] for x in owners] for mask in (np.repeat(m, counts) for m in (once, ~once)))
            before = np.append(0, np.cumsum(once))[edges]  # of those the chunk has once, how many stand before each range
            blobs = [
                pack(keys[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]], *(x[before[s] : before[s + 1]] for x in alone)) for s in some
            ]
            info = _ipc(pa.Table.from_batches([x[2] for x in held]))
            out = [[*some, _way(chunk, shards)], [chunk] * (len(some) + 1), [*blobs, None]]
            out += [[*[None] * len(some), x] for x in (pack(*several), info)]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SENT_SCHEMA, strict=True)], schema=_SENT_SCHEMA)

        for batch in batches:
            for part in extract(batch):
                held.append(part)
                n += len(part[0])
                if n >= chunk_keys:
                    yield flush()
                    held.clear()
                    chunk, n = chunk + 1, 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        shard = table["shard"][0]
        asked = table.filter(pc.is_valid(table["keys"]))
        parts = [unpack(x.as_buffer().to_pybytes()) for x in asked["keys"]]
        passed = table.filter(pc.is_null(table["keys"]))
        if not parts:
            return passed
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        edges, owners = np.cumsum([0, *(len(p[0]) for p in parts)]), [p[2:] for p in parts]
        del parts
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        total = np.add.reduceat(counts[order].astype(np.uint64), np.flatnonzero(new))
        often = np.empty(len(keys), np.uint32)
        often[order] = np.minimum(total, 0xFFFFFFFF)[np.cumsum(new) - 1]
        answers = []
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            again, own_counts = often[a:b] > 1, counts[a:b]
            found = again[own_counts == 1]
            answers.append(pack(keys[a:b][again], often[a:b][again], own_counts[again], *(x[found] for x in owners[k])))
            owners[k] = None
        none = pa.nulls(len(answers), pa.binary())
        answered = [pa.repeat(shard, len(answers)), asked["chunk"], pa.array(answers, pa.binary()), none, none]
        return pa.concat_tables([passed, pa.table(answered, schema=_SENT_SCHEMA)])

    def gather(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table["owners"]))
        several = unpack(own["owners"][0].as_buffer().to_pybytes())
        info = pa.ipc.open_stream(own["info"][0].as_buffer()).read_all()
        answers = table.filter(pc.is_valid(table["keys"])).sort_by("shard")
        parts = [unpack(x.as_buffer().to_pybytes()) for x in answers["keys"]]
        if not parts:
            return finish(info, np.zeros(0, np.uint64), np.zeros(0, np.uint32), several)
        keys, often, counts, *alone = (np.concatenate(x) for x in zip(*parts, strict=True))
        once = np.repeat(counts == 1, counts)
        owners = []
        for x, y in zip(alone, several, strict=True):
            both = np.empty(len(once), np.promote_types(x.dtype, y.dtype))
            both[once], both[~once] = x, y
            owners.append(both)
        return finish(info, np.repeat(keys, counts), np.repeat(often, counts), owners)

    sent = rows.mapInArrow(send, _SENT)
    return sent.groupBy("shard").applyInArrow(count, _SENT).groupBy("chunk").applyInArrow(gather, schema)
