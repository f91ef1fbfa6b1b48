"""Best-fit packing with certified bounds (operator 8).

Documents become token ids and one end id; longer ones are cut into pieces of ``capacity`` with the
first piece shorter. A full piece fills a sequence by itself. The others, at most one per document, are
dealt to partitions by hash; each partition packs by best-fit decreasing and compares its bin count
with lower bounds from dual-feasible functions: where they are equal, the partition is certified. While
the whole count is above the bound of all lengths together, pieces in bins with room are exchanged:
those of partitions with a gap, or of all where none is left, are pooled, dealt anew (fewer partitions
each time) and packed again, and the better packing stays. The result carries its certificate. Length
counts (at most ``capacity`` rows) are all that reaches the driver.

Edge cases: a null or empty text is the end id alone; a text of any length is cut, never dropped;
repeated rows are separate documents; of pieces of equal length any may go first, so sequence numbers may differ
between runs, bin counts don't; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm._shared import Scratch, cut

CAPACITY = 1024
END_ID = 2
#: The split of byte-level BPE into words, as its published tokenizers define it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which both tokenizer libraries agree by test; texts with others take the slower library.
_RARE = re.compile("[^\x00-ͯ‐-‧€]")


def _is_plain(file: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE as the fast library does it: that split, no normalizer, and merges in the order of ids."""
    model, split = file.get("model", {}), file.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or file.get("normalizer") or split.get("type") != "ByteLevel":
        return False
    if split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab.get(a + b, -1) for a, b in pairs]
    return all(a < b for a, b in zip([-1, *ids], ids, strict=False)) and len(vocab) - len(ids) <= 256 + len(file.get("added_tokens", []))


@lru_cache(maxsize=4)
def _encoders(path: str):
    """(fast encoder or None, exact tokenizer, special token strings) from a tokenizer file."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if not _is_plain(model):
        return None, Tokenizer.from_file(path), []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = [x["content"] for x in model.get("added_tokens", [])]
    ranks = {bytes(byte_of[c] for c in word): rank for word, rank in model["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(path), special


def encode(text: str, path: str) -> np.ndarray:
    """Ids of the file's tokenizer, as its own library gives them without added special tokens."""
    fast, exact, special = _encoders(path)
    if fast is None or _RARE.search(text) or any(s in text for s in special):
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("row", "doc_id")] + [T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")])


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``row`` (unique per document row), doc_id, piece, start, length, ids_crc32, and ``ids`` on request."""
    schema = T.StructType([*PIECE.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or "", tokenizer), np.uint32(end_id)).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        raw = ids[a:b].tobytes()
                        out.append((seen, doc, k, a, b - a, zlib.crc32(raw), *([raw] if with_ids else [])))
                    seen += 1
                columns = list(zip(*out, strict=True)) if out else [[] for _ in schema.names]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of three families of dual-feasible functions over a table of lengths and their counts."""
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):  # long items count as whole bins, those under e as nothing
        best = max(best, -(-int((np.where(x > capacity - e, capacity, np.where(x < e, 0, x)) * n).sum()) // capacity))
    for k in range(1, 33):  # rounding: floor((k+1) x / C) / k, multiples of C/(k+1) kept
        q, r = np.divmod((k + 1) * x, capacity)
        # in units of 1 / (k (k+1)): a multiple q/(k+1) counts q k, others q (k+1)
        best = max(best, -(-int((np.where(r == 0, q * k, q * (k + 1)) * n).sum()) // (k * (k + 1))))
    for e in range(1, capacity // 2 + 1):  # items over a half fill what the small ones of size e leave
        fits = capacity // e - (capacity - x) // e
        value = np.where(2 * x > capacity, 2 * fits, np.where(2 * x == capacity, capacity // e, np.where(x >= e, 2 * (x // e), 0)))
        best = max(best, -(-int((value * n).sum()) // (2 * (capacity // e))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins): longest first, each into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0  # bit r of `some`: there is a bin with room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            by_room[left].append(b)
            some |= 1 << left
    return where, offset, bins


_PACKED = "row long, length long, bin long, offset long, room long, gap long"


def _pack_round(items: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """Each hash partition packed by itself; ``bin`` is unique over partitions and turns, ``room`` is what its bin leaves, ``gap`` how
    many bins the partition's count is above its own bound (0: certified)."""

    def run(table: pa.Table) -> pa.Table:
        row, length = table["row"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort((row, length))
        row, length = row[order], length[order]
        where, offset, bins = best_fit_decreasing(length, capacity)
        fill = np.bincount(where, length, bins).astype(np.int64)
        base = (turn << 56) + (table["part"][0].as_py() << 32)
        gap = np.full(len(row), bins - lower_bound(*np.unique(length, return_counts=True), capacity))
        return pa.table({"row": row, "length": length, "bin": base + where, "offset": offset, "room": capacity - fill[where], "gap": gap})

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(run, _PACKED)


@dataclass(frozen=True)
class Certificate:
    """The number of bins, and a bound that no packing of the same lengths can go below."""

    bins: int
    bound: int


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, part_items: int = 100_000, turns: int = 6) -> tuple[DataFrame, Certificate]:
    """(row, length, bin, offset, room, gap) for items (row, length < capacity). Exchanges go on until the bound certifies the
    count, a turn over everything in one partition gains nothing, or ``turns`` are over."""
    table = items.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    lengths, counts = table["length"].to_numpy(), table["n"].to_numpy()
    n = int(counts.sum())
    bound = lower_bound(lengths, counts, capacity)
    kept = scratch.keep(_pack_round(items, max(1, math.ceil(n / part_items)), 0, capacity), "packed")
    bins = lambda df: df.select("bin").distinct().count()
    have = bins(kept)
    for turn in range(1, turns + 1):
        if have <= bound:
            break
        chosen = F.expr("room > 0 AND gap > 0")
        size = kept.filter(chosen).count()
        if not size:  # every partition is certified by itself; what is left lies between them
            chosen = F.expr("room > 0")
            size = kept.filter(chosen).count()
        pool = kept.filter(chosen)
        before = bins(pool)
        again = scratch.keep(_pack_round(pool, max(1, math.ceil(size / part_items / 2**turn)), turn, capacity), "packed")
        gain = before - bins(again)
        if gain > 0:
            merged = scratch.keep(kept.filter(~chosen).unionByName(again), "packed")
            scratch.drop(kept)
            kept, have = merged, have - gain
        elif size <= part_items:
            break
        scratch.drop(again)
    return kept, Certificate(have, bound)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """``pieces`` with sequence_id and offset. Full pieces are sequences by themselves (ids from 2**62 on)."""
    with Scratch(pieces.sparkSession) as scratch:
        pieces = cut(pieces)
        items = pieces.filter(F.col("length") < capacity).select("row", "length")
        placed, _ = pack(items, scratch, capacity, **options)
        placed = cut(placed.select("row", F.col("bin").alias("sequence_id"), "offset"))
    short = pieces.filter(F.col("length") < capacity).join(placed, "row")
    own = F.lit(1 << 62) + F.monotonically_increasing_id()
    full = pieces.filter(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", own)
    return short.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids themselves, from pieces that were cut with ``with_ids``. A sequence is of bounded length."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
