"""Removal of repeated byte strings by sorting suffixes (operator 10).

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller doc_id, or earlier
in the same document) goes, judged on the input. The result is exact.

1. Exact copies. The copies of a text lie wholly in strings of its first copy: they need no search, and
   take no part in what follows, since whatever they contain starts earlier in the first copy.
2. Anchors. Among the k-byte strings of a window of ``length`` bytes, the one with the smallest hash
   (leftmost on ties) is its anchor: equal windows have equal anchors at the same place. Each anchor
   stands for the run of windows that chose it. Only anchors whose string occurs at another anchor too
   can have repeated windows; all others are dropped after one count.
3. Suffixes. The anchors that are left are sorted by what follows and by what goes before them, by
   deep-shallow sorting: multikey quicksort on eight-byte characters to a shallow depth, then a blind
   trie for each group whose members still agree. Neighbours' common prefixes come with the order.
4. Windows. Two windows at offset o before their anchors are equal if and only if the texts behind agree
   on length-o bytes and those before agree on o bytes: the common prefixes of both orders say so for all
   offsets. In each class of equal windows all but the earliest are repeats.

Groups of more than ``hot`` anchors are first split by more of what all their windows share: a window that begins between o1
and o2 bytes before the anchor holds o1 bytes before it and length-o2 from it on, whatever it is. So each anchor is dealt to
blocks of offsets with those bytes as the key; members with equal bytes and offsets leave all but the earliest (their windows are
repeats); and blocks are halved until no group is large. The last blocks hold one offset, where equal keys are equal windows.

Edge cases: null and empty texts, and texts under ``length`` bytes, lose nothing; equal rows (same doc_id and text) count as one
document and both keep what it keeps; documents that share a doc_id but differ are ordered by a hash of their text; null ids come
last; an empty table gives no rows; other columns are ignored. A text is read whole, in some 100 bytes of a worker's memory for each
of its own: one of 10 MB takes a GB. ``docs`` must come from files or a checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._lists import Lists, place_of, write_lists
from riskloom.llm._repeated import Extracted, with_repeats
from riskloom.llm._shared import Scratch, cut, remove, sweep
from riskloom.llm._text import BYTE_CODES, mix64, powers, slices, texts_of

LENGTH = 100
GRAM = 40
CHUNK_KEYS = 500_000  # anchors that a task holds before it sends them on
SHALLOW = 2  # eight-byte characters that multikey quicksort reads before the tries take over


# --- anchors -------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash, place, first window, last window) of each anchor of the texts; places count from the text's start."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none, none
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * power[:n], out=total[1:])
    grams = mix64((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    # Hash above, place below: the smallest of a stretch is the leftmost of the smallest hashes.
    bits = max(1, int(n).bit_length())
    keep = np.uint64((1 << 64) - (1 << bits))
    key = (grams & keep) | np.arange(len(grams), dtype=np.uint64)
    span, have = length - gram + 1, 1
    least = key
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start = np.arange(len(least))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    whole = start + length <= offsets[1:][text]
    start, text = start[whole], text[whole]
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    place = (least[start] & ~keep).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(start)) - 1]
    base = offsets[:-1][text[at]]
    return text[at], grams[place[at]], place[at] - base, start[at] - base, last - base


# --- deep-shallow sorting ------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


class _Trie:
    """A blind trie: inner nodes keep only the depth at which their leaves part, and the byte there; leaves hold strings."""

    __slots__ = ("depth", "children", "leaf", "members")

    def __init__(self, depth: int, leaf: bytes) -> None:
        self.depth, self.leaf = depth, leaf
        self.children: dict[int, _Trie] | None = None
        self.members: list[int] = []


def blind_sort(strings: list[bytes], members: list[int]) -> tuple[list[list[int]], list[int]]:
    """(groups of members with equal strings in order, common prefix of each group with the one before).

    An insertion follows branching bytes blindly to some leaf, compares once in full, and puts the new leaf
    where the comparison says. Strings of one length, so none is a proper prefix of another.
    """
    root: _Trie | None = None
    for s, m in zip(strings, members, strict=True):
        if root is None:
            root = _Trie(len(s), s)
            root.members.append(m)
            continue
        node = root
        while node.children is not None:
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        split = _common(s, node.leaf)
        if split == len(s):
            node.members.append(m)
            continue
        new = _Trie(len(s), s)
        new.members.append(m)
        parent, node = None, root
        while node.children is not None and node.depth < split:
            parent, node = node, node.children[s[node.depth]]
        if node.children is not None and node.depth == split:
            node.children[s[split]] = new
            continue
        fork = _Trie(split, node.leaf)
        fork.children = {node.leaf[split]: node, s[split]: new}
        if parent is None:
            root = fork
        else:
            parent.children[s[parent.depth]] = fork
    groups: list[list[int]] = []
    common: list[int] = []
    stack: list[tuple[_Trie, int]] = [(root, 0)] if root else []
    while stack:
        node, before = stack.pop()
        if node.children is None:
            groups.append(node.members)
            common.append(before)
        else:
            inner = sorted(node.children)
            stack += [(node.children[b], before if b == inner[0] else node.depth) for b in reversed(inner)]
    return groups, common


def deep_shallow(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the rows of ``strings`` (n x width bytes) inside groups of equal ``group``.

    ``common[i]`` is the common prefix of order[i] with order[i-1], -1 where a group begins. Multikey quicksort: rows
    are parted three ways by a pivot's eight-byte character; those below and above go on with the same character, those
    equal with the next one. Groups that agree on ``shallow`` characters are finished by blind tries.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    rows = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.append(True, group[rows][1:] != group[rows][:-1])) if n else np.zeros(0, np.int64)
    order, common = np.empty(n, np.int64), np.full(n, -2, np.int64)
    blob = [None] * n

    def text(i: int) -> bytes:
        if blob[i] is None:
            blob[i] = strings[i].tobytes()
        return blob[i]

    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
        if b - a == 1:
            order[a] = rows[a]
            common[a] = -1
            continue
        todo = [(rows[a:b], 0)]
        at = a
        while todo:
            part, depth = todo.pop()
            if len(part) == 1:
                order[at] = part[0]
                at += 1
            elif depth >= min(shallow, words.shape[1]) or len(part) <= 8:
                members = part.tolist()
                groups, inner = blind_sort([text(i) for i in members], members)
                for g, c in zip(groups, inner, strict=True):
                    order[at : at + len(g)] = g
                    common[at + 1 : at + len(g)] = width
                    if at > a and c:  # a known common prefix inside this trie
                        common[at] = c
                    at += len(g)
            else:
                w = words[part, depth]
                pivot = np.partition(w, len(w) // 2)[len(w) // 2]
                below, same, above = part[w < pivot], part[w == pivot], part[w > pivot]
                todo += [(x, d) for x, d in ((above, depth), (same, depth + 1), (below, depth)) if len(x)]
        common[a] = -1
        for i in (np.flatnonzero(common[a:b] == -2) + a).tolist():  # where parts of the quicksort meet
            common[i] = _common(text(order[i - 1]), text(order[i]))
    return order, common


def repeated_windows(group: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset): windows that start ``offset`` bytes before the anchor of ``row`` and are not the earliest of their class.

    ``after`` holds the bytes from the anchor on, ``before`` those before it, last byte first; ``low``..``high`` are the
    offsets of the row's own windows; ``rank`` orders rows by place in the corpus.
    """
    forward, forward_common = deep_shallow(after, group)
    backward, backward_common = deep_shallow(before, group)
    n = len(group)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    rows_out, offsets_out = [], []
    for o in range(int(low.min()) if n else 0, int(high.max()) + 1 if n else 0):
        own = np.flatnonzero((low <= o) & (high >= o))
        if len(own) < 2:
            continue
        right[forward] = np.cumsum(forward_common < length - o)
        left[backward] = np.cumsum(backward_common < o)
        kind = right[own] * np.int64(n + 1) + left[own]
        order = np.lexsort((rank[own], kind))
        kind = kind[order]
        again = np.flatnonzero(kind[1:] == kind[:-1]) + 1
        rows_out.append(own[order[again]])
        offsets_out.append(np.full(len(again), o))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(offsets_out)


# --- on Spark ------------------------------------------------------------------------------------

_KEY = ["_id", "_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("_hash"))


_FOUND = "_id long, _hash long, found array<struct<place:long,low:int,high:int,often:long>>"


def _repeated_anchors(texts: DataFrame, length: int, gram: int, **sizes) -> DataFrame:
    """(_id, _hash, found): the anchors of each text whose string is at another anchor too, with how often it is there."""

    def extract(batch: pa.RecordBatch) -> Iterator[Extracted]:
        data, offsets = texts_of(batch.column("text"))
        for i, j in slices(offsets, 1 << 18):
            text, gram_hash, place, first, last = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
            wide = np.uint32 if not len(place) or place.max() < 1 << 32 else np.uint64
            owners = [text.astype(np.uint32), place.astype(wide), (place - last).astype(np.uint16), (place - first).astype(np.uint16)]
            # An anchor has the smallest hash of its window, and small ones would nearly all fall to the first shard.
            yield mix64(gram_hash), owners, pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in _KEY], names=_KEY)

    def finish(info: pa.Table, keys: np.ndarray, often: np.ndarray, owners: list[np.ndarray]) -> pa.Table:
        row, place, low, high = owners
        order = np.lexsort((place, row))
        edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(info)))]).astype(np.int32)
        columns = [place.astype(np.int64), low.astype(np.int32), high.astype(np.int32), often.astype(np.int64)]
        found = pa.StructArray.from_arrays([pa.array(x[order]) for x in columns], names=["place", "low", "high", "often"])
        lists = pa.ListArray.from_arrays(pa.array(edges), found)
        some = pa.array(np.diff(edges) > 0)
        return info.append_column("found", lists).filter(some)

    return with_repeats(texts, extract, finish, _FOUND, **{"chunk_keys": CHUNK_KEYS} | sizes)


_CONTEXT = "_id long, _hash long, gram long, place long, low int, high int, before binary, after binary"


def _contexts(texts: DataFrame, lists: Lists, large: bool, length: int, gram: int) -> DataFrame:
    """The bytes around each anchor in the texts' lists that is ``large`` or not: as many before it as its windows reach, and behind.
    Rows that are equal give equal contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - gram
        for batch in batches:
            row, (place, low, high, is_large) = lists.of(batch)
            wanted = np.flatnonzero(is_large == large)
            if not len(wanted):
                continue
            data, offsets = texts_of(batch.column("text"))
            ids, hashes = (batch.column(c).to_numpy() for c in _KEY)
            for i, j in slices(offsets):
                own = wanted[slice(*np.searchsorted(row[wanted], [i, j]))]
                raw = np.zeros(offsets[j] - offsets[i] + reach + length, np.uint8)
                raw[reach:-length] = data[offsets[i] : offsets[j]]
                behind, ahead = (np.lib.stride_tricks.sliding_window_view(raw, n) for n in (reach, length))
                for a in range(0, len(own), 10_000):
                    w = own[a : a + 10_000]
                    p = offsets[row[w]] - offsets[i] + place[w]
                    before, after = behind[p][:, ::-1].copy(), ahead[p + reach]
                    before[np.arange(reach) >= high[w, None]] = 0
                    after[np.arange(length) >= length - low[w, None]] = 0
                    # Windows reach at least ``gram`` bytes behind the anchor, so its string is there whole.
                    gram_hash = mix64((BYTE_CODES[after[:, :gram]] * powers(gram)[0]).sum(1, dtype=np.uint64)).view(np.int64)
                    fixed = lambda x: pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row[w]]), pa.array(hashes[row[w]]), pa.array(gram_hash), pa.array(place[w]), pa.array(low[w].astype(np.int32)), pa.array(high[w].astype(np.int32)), fixed(before), fixed(after)],
                        names=["_id", "_hash", "gram", "place", "low", "high", "before", "after"],
                    )

    return texts.mapInArrow(run, _CONTEXT)


def _spans(ids: np.ndarray, hashes: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive window starts of a document as (first, last)."""
    order = np.lexsort((window, hashes, ids))
    ids, hashes, window = ids[order], hashes[order], window[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (window[1:] > window[:-1] + 1)
    at = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(hashes[at]), pa.array(window[at]), pa.array(window[np.append(at[1:], len(ids)) - 1]) if len(at) else pa.array([], pa.int64())], names=["_id", "_hash", "first", "last"])


_SPANS = "_id long, _hash long, first long, last long"


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of whole groups: partitions hold whole groups; each is worked off in bounded pieces of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            ids, hashes, gram, place, low, high = (table[c].to_numpy() for c in ("_id", "_hash", "gram", "place", "low", "high"))
            n = len(ids)
            before, after = (texts_of(table[c])[0].reshape(n, -1) for c in ("before", "after"))
            order = np.lexsort((place, hashes, ids))
            same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (ids, hashes, place, low)])
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            if same.any():  # contexts of equal rows: one is left
                kept = np.sort(order[np.append(True, ~same)])
                ids, hashes, gram, place, low, high, rank, before, after = (x[kept] for x in (ids, hashes, gram, place, low, high, rank, before, after))
            row, offset = repeated_windows(gram, before, after, low, high, rank, length)
            return _spans(ids[row], hashes[row], place[row] - offset)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 100_000:  # the last group may go on in the next batch (rows come sorted by group)
                table = pa.Table.from_batches(held)
                gram = table["gram"].to_numpy()
                cut_at = int(np.searchsorted(gram, gram[-1], "left"))
                if cut_at:
                    yield solve(table.slice(0, cut_at))
                    table = table.slice(cut_at)
                held, rows = table.to_batches(), len(table)
        if rows:
            yield solve(pa.Table.from_batches(held))

    return contexts.sortWithinPartitions("gram").mapInArrow(run, _SPANS)


def _split_large(contexts: DataFrame, length: int, gram: int, hot: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(contexts in groups of at most ``hot``, spans of windows found to be repeats on the way) for groups of any size."""
    reach = length - gram
    size = 1 << max(0, reach.bit_length() - 1)
    me, same = F.struct(*_KEY, "place"), ["gram", "low", "high", "before", "after"]
    small, spans, pieces = [], [], contexts
    while True:
        blocks = F.sequence((F.col("low") / size).cast("int"), (F.col("high") / size).cast("int"))
        pieces = pieces.withColumn("_block", F.explode(blocks))
        pieces = pieces.withColumn("low", F.greatest("low", F.col("_block") * size))
        pieces = pieces.withColumn("high", F.least("high", (F.col("_block") + 1) * size - 1))
        held = [F.expr(f"substring(before, 1, _block * {size})"), F.expr(f"substring(after, 1, {length + 1} - least({reach + 1}, (_block + 1) * {size}))")]
        pieces = pieces.withColumn("gram", F.xxhash64("gram", "_block", *held)).drop("_block")
        pieces = pieces.withColumn("before", F.expr(f"rpad(substring(before, 1, high), {reach}, X'00')"))
        pieces = pieces.withColumn("after", F.expr(f"rpad(substring(after, 1, {length} - low), {length}, X'00')"))
        pieces = scratch.keep(pieces, "pieces")
        sweep(contexts.sparkSession)  # the texts that the first pieces came from
        leaders = scratch.keep(pieces.groupBy(*same).agg(F.min(me).alias("leader")), "leaders")
        others = pieces.join(leaders, same).filter(me != F.col("leader"))
        spans.append(scratch.keep(others.select(*_KEY, (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low")).alias("last")), "others"))
        scratch.drop(pieces)
        # One row a class goes on, however many equal rows its first text has.
        left = leaders.select("*", "leader.*").select(*contexts.columns)
        if size == 1:  # equal keys were equal windows: one is left of each
            return [*small, left], spans
        large = scratch.keep(left.groupBy("gram").count().filter(F.col("count") > hot).select("gram"), "large")
        small.append(left.join(large, "gram", "left_anti").select(*contexts.columns))
        if large.isEmpty():
            return small, spans
        pieces, size = left.join(large, "gram", "left_semi").select(*contexts.columns), size // 2


def _result(texts: DataFrame, lists: Lists, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the texts that have a list of window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, (first, last) = lists.of(batch)
            if not len(row):
                continue
            data, offsets = texts_of(batch.column("text"))
            rows, begin = np.unique(row, return_index=True)
            removed, spans, digests = [], [], []
            for i, a, b in zip(rows.tolist(), begin.tolist(), np.append(begin[1:], len(row)).tolist(), strict=True):
                own = data[offsets[i] : offsets[i + 1]]
                steps = np.zeros(len(own) + 1, np.int64)
                np.add.at(steps, first[a:b], 1)
                np.add.at(steps, last[a:b] + length, -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(np.diff(offsets)[rows]), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("doc_id", *_KEY, place_of(), "text").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 20_000, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row. ``hot``: anchors of one string beyond which a group is
    split before it is sorted."""
    spark = docs.sparkSession
    rows = _keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    size = F.octet_length("text")
    searched = rows.filter(size >= length)
    with Scratch(spark) as scratch:
        # 1. Exact copies: the first of each text stays in the search. Only short keys are shuffled.
        digest = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
        keys = scratch.keep(rows.select("doc_id", *_KEY, size.cast("long").alias("n_bytes"), digest.alias("_sha")), "keys")
        first = keys.filter(F.col("n_bytes") >= length).groupBy("_sha").agg(F.min(F.struct(*_KEY)).alias("k"), F.count("*").alias("copies"))
        first = scratch.keep(first, "first")
        # 2. Anchors that occur in other texts, or twice in their own. A string of a text with copies is there as often as they are.
        found = scratch.keep(_repeated_anchors(searched.select(*_KEY, "text"), length, gram, **sizes), "anchors")
        sweep(spark)
        led = found.join(first.select("k._id", "k._hash", "copies"), _KEY).dropDuplicates(_KEY)
        led = led.select(*_KEY, F.filter("found", lambda x: x["often"] > F.col("copies")).alias("found")).filter("size(found) > 0")
        kind = "short" if length < 1 << 15 else "int"
        narrow = lambda x: F.struct(x["place"].alias("place"), x["low"].cast(kind).alias("low"), x["high"].cast(kind).alias("high"), (x["often"] > hot).alias("large"))
        led = scratch.keep(led.select(*_KEY, F.transform("found", narrow).alias("found")), "led")
        scratch.drop(found)
        of_all = lambda x: F.coalesce(F.sum(x), F.lit(0))
        n, n_large = led.agg(of_all(F.size("found")), of_all(F.size(F.filter("found", lambda x: x["large"])))).first()
        lists = write_lists(led, "found", n, scratch.folder("lists"))
        scratch.drop(led)
        keyed = searched.select(*_KEY, place_of(), "text")
        # 3. and 4.
        parts, spans = [_contexts(keyed, lists, False, length, gram)], []
        if n_large:
            more, spans = _split_large(_contexts(keyed, lists, True, length, gram), length, gram, hot, scratch)
            parts += more
            sweep(spark)
        usual = parts[0]
        for part in parts[1:]:
            usual = usual.unionByName(part)
        settled = _sorted_groups(usual.repartition(max(1, -(-n // 100_000)), "gram"), length)
        for part in spans:
            settled = settled.unionByName(part)
        spans = scratch.keep(settled.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
        remove(spark, lists.folder)
        sweep(spark)
        lists = write_lists(spans, "spans", spans.agg(of_all(F.size("spans"))).first()[0], scratch.folder("lists"))
        # A copy of an earlier text goes whole; texts without repeats stay as they are; only the rest is read again.
        marked = keys.join(first.select("_sha", "k"), "_sha", "left").join(spans.select(*_KEY, F.lit(True).alias("_some")), _KEY, "left")
        copy = F.col("k").isNotNull() & (F.struct(*_KEY) != F.col("k"))
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        plain = marked.filter(copy | F.col("_some").isNull()).select(
            "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.when(copy, one).otherwise(zero).alias("n_spans"),
            F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex("_sha"))).alias("kept_sha256"),
        )
        return cut(plain.unionByName(_result(searched, lists, length)))
