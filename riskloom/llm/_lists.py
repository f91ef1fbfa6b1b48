"""Lists that tasks look up by the keys of their own texts, so that no text is moved to its list.

Lists are dealt to shards by a hash of their key. A shard is one Arrow file in the shared folder, sorted by that hash; tasks map
it, bisect for the rows of a batch and read those lists only. A batch visits the shards in order and holds one at a time.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._shared import mounted, write_whole

KEY = ["_id", "_hash"]
SHARD_VALUES = 500_000


def place_of() -> Column:
    """The hash of ``KEY`` by which lists are dealt and found; texts that look something up bring it as ``_at``."""
    return F.xxhash64(*KEY).alias("_at")


@dataclass
class Lists:
    folder: str
    shards: int
    fields: list[str]

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        """(row, fields): the values of the lists that the batch's rows have, by row and in the order of its list."""
        at, *key = (batch.column(c).to_numpy() for c in ("_at", *KEY))
        home = at % np.int64(self.shards)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(self.shards + 1))
        rows, out = [np.zeros(0, np.int64)], []
        for shard in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            path = f"{mounted(self.folder)}/{shard:06d}"
            if not os.path.exists(path):  # no list fell to it
                continue
            with pa.memory_map(path) as file:
                stored = pa.ipc.open_file(file).get_batch(0)
                mine = order[edges[shard] : edges[shard + 1]]
                found = _find([stored.column(c).to_numpy() for c in ("_at", *KEY)], [at[mine], *(x[mine] for x in key)])
                mine, found = mine[found >= 0], found[found >= 0]
                lists = stored.column("list")
                begin, n = lists.offsets.to_numpy()[found].astype(np.int64), np.diff(lists.offsets.to_numpy())[found].astype(np.int64)
                take = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
                rows.append(np.repeat(mine, n))
                out.append([lists.values.field(f).to_numpy(zero_copy_only=False)[take] for f in self.fields])
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return row[order], [np.concatenate(x)[order] for x in zip(*out, strict=True)] if out else [row] * len(self.fields)


def _find(stored: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Where each wanted (hash, key) stands among stored ones sorted by hash, -1 where it doesn't. Keys may share a hash."""
    at = np.searchsorted(stored[0], wanted[0])
    out = np.full(len(at), -1)
    left = np.arange(len(at))
    while True:
        left = left[at[left] < len(stored[0])]
        left = left[stored[0][at[left]] == wanted[0][left]]
        if not len(left):
            return out
        same = np.logical_and.reduce([s[at[left]] == w[left] for s, w in zip(stored[1:], wanted[1:], strict=True)])
        out[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1


def write_lists(lists: DataFrame, column: str, values: int, folder: str, shard_values: int = SHARD_VALUES) -> Lists:
    """The lists in ``column`` (arrays of structs, no nulls; one row a key), some ``values`` in all, as files in ``folder``."""
    shards = max(1, -(-values // shard_values))

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        stored = table.drop_columns("shard").sort_by("_at").combine_chunks().to_batches()[0]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, stored.schema) as out:
            out.write_batch(stored)
        write_whole(f"{mounted(folder)}/{shard:06d}", sink.getvalue())
        return pa.table({"shard": pa.array([shard], pa.int32())})

    dealt = lists.select(F.pmod(place_of(), F.lit(shards)).cast("int").alias("shard"), place_of(), *KEY, F.col(column).alias("list"))
    dealt.groupBy("shard").applyInArrow(write, "shard int").collect()
    return Lists(folder, shards, lists.schema[column].dataType.elementType.names)
