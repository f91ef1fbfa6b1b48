"""Language-model scores from an interpolated modified Kneser-Ney model of n-grams (operator 1), of order 3 or 2.

Counting moves compressed sorted arrays between Spark tasks; a task's arrays are bounded by the size of its shard (``shard_bytes``
of text). Scoring moves nothing: workers map the model's files and look up what their own texts need.

1. Words. Tasks count the distinct word hashes of their texts; shards of the hash range add them up and write sorted hash arrays
   with counts to the shared folder. A word's id is its place in that order.
2. Longest n-grams. Tasks count distinct (context, word) keys; shards by a hash of both add them up and write sorted hash arrays
   with counts. A frequent word or context is spread over all shards.
3. Shorter ones (order 3). Each shard of step 2 adds up, per context, the followers with count 1, 2, 3 or more and their total, and
   per pair of last words the number of distinct words before it; shards by a hash of the pair add those up and write sorted hash
   arrays of both.
4. Single words. The same sums once more, per word, over ranges of ids: arrays by id.
5. Scores. In one pass over the texts, a worker looks up the distinct n-grams of a slice by their sorted hashes in the mapped
   arrays, and returns a row per text.

Nothing but a few scalars and one row per shard reaches the driver. A shard stores 40 bits of an n-gram's hash, in buckets by the
first 16 of them: what is not in the model is taken for something else about once in 2**40 / (keys of a shard) lookups, some 3 in a
million of them at the usual size.

p(w | u v) = max(c(u v w) - D(c), 0) / c(u v .) + g(u v) p(w | v); the shorter distributions likewise, from the numbers of distinct
words before their n-grams in place of counts; p(w) goes over into the uniform distribution over the vocabulary and one unknown
word. Discounts of each length follow the counts of counts; where those are too thin, 0.5, 1 and 1.5 hold. A text begins with
order - 1 begin marks, which are never predicted.

Edge cases: null and empty texts are the end token alone; words not seen in training are the unknown word; without training texts
every token is as likely as any other; repeated rows are scored apart; equal counts need no order; an empty table gives no rows; other
columns are ignored. A text is read whole, in some 100 bytes of a worker's memory for each of its own: one of 10 MB takes a GB.
"""

from __future__ import annotations

import os
import shutil
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._arrays import pack, ranges, unpack
from riskloom.llm._shared import cut, mounted, new_folder, remainder, sweep, write_whole
from riskloom.llm._text import Words, mix64, slices, texts_of

END = np.uint64(0x5DEECE66D)  # the hash that stands for the end of a text
SHARD_BYTES = 22 << 20
FLUSH = 3_000_000  # keys that a task holds before it sends them on
ORDER = 3
_LOW = np.uint64(0xFFFFFFFF)
_HOME = np.uint64(0xA0761D6478BD642F)

Shared = tuple[np.ndarray, ...]


# --- counting in arrays --------------------------------------------------------------------------


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): an order that sorts by the keys, first one first, and where groups of equal keys begin in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        ordered = k[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _added(keys: Shared, values: Shared) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct sorted keys, and the sums of their values."""
    if not len(keys[0]):
        return list(keys), [v.astype(np.uint64) for v in values]
    order, at = _groups(*keys)
    return [k[order[at]] for k in keys], [np.add.reduceat(v[order].astype(np.uint64), at) for v in values]


def _small(x: np.ndarray) -> np.ndarray:
    """In four bytes, if they suffice."""
    return x.astype(np.uint32) if not len(x) or int(x.max()) < 1 << 32 else x


def _blobs(column) -> list[list[np.ndarray]]:
    return [unpack(x.as_buffer().to_pybytes()) for x in column]


def _rows(shards: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _dealt(home: np.ndarray, shards: int, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The arrays' parts for each shard, in the arrays' own order."""
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(shards + 1))
    some = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
    return some, [pack(*(x[order[edges[s] : edges[s + 1]]] for x in arrays)) for s in some]


def _home(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards of n-grams, by other bits than those they are sorted by."""
    return (mix64(hashes ^ _HOME) % np.uint64(shards)).astype(np.int32)


def _hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of (context, word)."""
    return mix64(mix64(context + _HOME) * np.uint64(3) + word.astype(np.uint64))


def _followers(n: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Total, and the numbers of 1, 2, 3 or more, of counts in groups."""
    of = lambda x: np.add.reduceat(x.astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
    return [of(n), of(n == 1), of(n == 2), of(n >= 3)]


def _count_of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([len(n), *((n == k).sum() for k in (1, 2, 3, 4))], np.uint64)


def _token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with an end after each text, tokens per text)."""
    words = Words(data, offsets)
    counts = words.counts + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = words.hash
    return out, counts


# --- the model's files ---------------------------------------------------------------------------


def _parts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash's bucket (16 bits), and the next 16 and 8 bits."""
    high, low = hashes >> np.uint64(32) & np.uint64(0xFFFF), hashes >> np.uint64(24) & np.uint64(0xFF)
    return (hashes >> np.uint64(48)).astype(np.int64), high.astype(np.uint16), low.astype(np.uint8)


def _write_keys(folder: str, name: str, hashes: np.ndarray) -> None:
    """Sorted hashes: where each bucket begins, and the rest of each key."""
    buckets, high, low = _parts(hashes)
    write_whole(f"{folder}/{name}.offset", np.searchsorted(buckets, np.arange((1 << 16) + 1)).astype("<u4").tobytes())
    write_whole(f"{folder}/{name}.high", high.astype("<u2").tobytes())
    write_whole(f"{folder}/{name}.low", low.tobytes())


def _write_counts(folder: str, name: str, n: np.ndarray) -> None:
    """Counts in a byte each; the few larger ones in a list of their own."""
    large = np.flatnonzero(n >= 255)
    write_whole(f"{folder}/{name}.count", np.minimum(n, 255).astype(np.uint8).tobytes())
    write_whole(f"{folder}/{name}.large", np.column_stack([large, n[large]]).astype("<u8").tobytes())


def _write_codes(folder: str, name: str, columns: list[np.ndarray]) -> None:
    """Rows of small numbers as codes of the distinct rows."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        mixed = mix64(mixed * np.uint64(3) + x.astype(np.uint64))
    _, first, code = np.unique(mixed, return_index=True, return_inverse=True)
    kind = "<u2" if len(first) < 1 << 16 else "<u4"
    write_whole(f"{folder}/{name}.code{kind[-1]}", code.astype(kind).tobytes())
    write_whole(f"{folder}/{name}.rows", np.column_stack([x[first] for x in columns]).astype("<u8").tobytes())


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    path = os.path.join(folder, name)
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


#: Arrays that a worker holds mapped at once: each takes a file descriptor, and a shard has some twelve.
OPEN_ARRAYS = 256


class Files:
    """The arrays of a model's folder, mapped when first used; beyond ``OPEN_ARRAYS`` the one that was not used for longest is closed.
    Shards are visited in order, so a model of any number of shards needs no more; what is mapped again is in the page cache."""

    def __init__(self, folder: str) -> None:
        self.folder = mounted(folder)
        self.open: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()

    def get(self, name: str, kind: str) -> np.ndarray:
        if (name, kind) not in self.open:
            if len(self.open) >= OPEN_ARRAYS:
                self.open.popitem(last=False)
            self.open[name, kind] = _mapped(self.folder, name, kind)
        self.open.move_to_end((name, kind))
        return self.open[name, kind]

    def find(self, name: str, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes in the shard ``name``, -1 where they are not: bisection of all of them at once, inside their buckets."""
        offset, high, low = self.get(f"{name}.offset", "<u4"), self.get(f"{name}.high", "<u2"), self.get(f"{name}.low", "u1")
        if not len(high):
            return np.full(len(hashes), -1)
        bucket, want, tail = _parts(hashes)
        at, last = offset[bucket].astype(np.int64), len(high) - 1
        end = stop = offset[bucket + 1].astype(np.int64)
        for _ in range(int((end - at).max(initial=0)).bit_length()):
            middle = at + stop >> 1
            right = (at < stop) & (high[np.minimum(middle, last)] < want)
            at, stop = np.where(right, middle + 1, at), np.where(right | (at >= stop), stop, middle)
        out = np.full(len(hashes), -1)
        left = np.arange(len(hashes))
        while len(left):  # a few keys of a bucket share the 16 bits
            left = left[(at[left] < end[left]) & (high[np.minimum(at[left], last)] == want[left])]
            hit = low[at[left]] == tail[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
        return out

    def counts(self, name: str, hashes: np.ndarray) -> np.ndarray:
        at = self.find(name, hashes)
        out = np.zeros(len(hashes), np.int64)
        hit = np.flatnonzero(at >= 0)
        out[hit] = self.get(f"{name}.count", "u1")[at[hit]]
        large = self.get(f"{name}.large", "<u8").reshape(-1, 2)
        top = hit[out[hit] == 255]
        if len(top):
            out[top] = large[np.searchsorted(large[:, 0], at[top].astype(np.uint64)), 1]
        return out

    def coded(self, name: str, hashes: np.ndarray, width: int) -> np.ndarray:
        at = self.find(name, hashes)
        out = np.zeros((len(hashes), width), np.int64)
        hit = np.flatnonzero(at >= 0)
        if len(hit):
            code = self.get(f"{name}.code2", "<u2")
            code = code if len(code) else self.get(f"{name}.code4", "<u4")
            out[hit] = self.get(f"{name}.rows", "<u8").reshape(-1, width)[code[at[hit]]]
        return out


def _by_shard(hashes: np.ndarray, shards: int, look: Callable[[int, np.ndarray], np.ndarray], width: int = 1) -> np.ndarray:
    """What ``look(shard, hashes)`` gives for each of sorted hashes."""
    home = _home(hashes, shards)
    order = np.argsort(home, kind="stable")  # inside a shard they stay sorted
    edges = np.searchsorted(home[order], np.arange(shards + 1))
    out = np.zeros((len(hashes), width), np.int64)
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        own = order[edges[s] : edges[s + 1]]
        out[own] = look(s, hashes[own]).reshape(len(own), width)
    return out


_THIN = (0.5, 1.0, 1.5)


@dataclass
class Model:
    """Where the arrays are, and the scalars: everything else is mapped from files."""

    folder: str
    order: int
    shards: int
    bases: list[int]  # first id of each vocabulary shard; the last entry is the vocabulary's size
    tokens: int
    id_range: int
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=lambda: {1: _THIN, 2: _THIN, 3: _THIN})  # by length
    kinds: int = 0  # distinct pairs: the total of the shortest distribution
    spare: float = 1.0  # weight of the uniform distribution

    @property
    def size(self) -> int:
        return self.bases[-1]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys with count 1, 2, 3, 4."""
    if min(n) <= 0:
        return _THIN
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3))  # type: ignore[return-value]


class Vocabulary:
    """Ids of word hashes by binary search in the mapped arrays."""

    def __init__(self, model: Model, files: Files) -> None:
        self.model, self.files = model, files

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, training counts) of sorted distinct hashes; unknown words get the id after the begin mark, and 0."""
        ids, counts = np.full(len(hashes), self.model.size + 1, np.uint64), np.zeros(len(hashes), np.uint64)
        edges = ranges(hashes, self.model.shards)
        for s in range(self.model.shards):
            a, b = edges[s], edges[s + 1]
            n = self.model.bases[s + 1] - self.model.bases[s]
            if a == b or not n:
                continue
            own = self.files.get(f"words-{s:05d}.hash", "<u8")
            at = np.minimum(np.searchsorted(own, hashes[a:b]), n - 1)
            hit = own[at] == hashes[a:b]
            ids[a:b][hit] = at[hit].astype(np.uint64) + np.uint64(self.model.bases[s])
            counts[a:b][hit] = self.files.get(f"words-{s:05d}.count", "<u8")[at[hit]]
        return ids, counts


@dataclass
class Tokens:
    """The tokens of some texts: their contexts and words as ids, training counts of the words, and tokens per text."""

    context: np.ndarray
    word: np.ndarray
    seen: np.ndarray
    counts: np.ndarray


def _tokens(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Tokens:
    hashes, counts = _token_hashes(data, offsets)
    distinct, place = np.unique(hashes, return_inverse=True)
    ids, seen = vocabulary.find(distinct)
    word = ids[place]
    begin = np.uint64(vocabulary.model.size)
    starts = np.cumsum(counts) - counts
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[starts] = begin
    context = before
    if vocabulary.model.order == 3:
        second = np.empty_like(word)
        second[1:] = before[:-1]
        second[starts] = begin
        context = second << np.uint64(32) | before
    return Tokens(context, word, seen[place], counts)


# --- training ------------------------------------------------------------------------------------

_PART = "shard int, blob binary"
_STATS = -1  # the shard to which counts of counts go


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts ``docs`` (text) and writes the model's arrays to ``folder`` in the shared folder."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ngrams")
    texts = docs.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> list[pa.RecordBatch]:
            (keys,), (n,) = _added((np.concatenate([k for k, _ in held]),), (np.concatenate([n for _, n in held]),))
            held.clear()
            edges = ranges(keys, shards)
            some = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
            return _rows(some, [pack(keys[edges[s] : edges[s + 1]], _small(n[edges[s] : edges[s + 1]])) for s in some]).to_batches()

        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for i, j in slices(offsets):
                held.append(np.unique(_token_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True))
                if sum(len(k) for k, _ in held) > FLUSH:
                    yield from send()
        if held:
            yield from send()

    def add_words(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        parts = _blobs(table["blob"])
        (keys,), (n,) = _added((np.concatenate([p[0] for p in parts]),), (np.concatenate([p[1] for p in parts]),))
        at = mounted(folder)
        write_whole(f"{at}/words-{s:05d}.hash", keys.astype("<u8").tobytes())
        write_whole(f"{at}/words-{s:05d}.count", n.astype("<u8").tobytes())
        return pa.table({"shard": pa.array([s], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    words = texts.mapInArrow(count_words, _PART).groupBy("shard").applyInArrow(add_words, "shard int, words long, tokens long").collect()
    sizes = [0] * shards
    for row in words:
        sizes[row["shard"]] = row["words"]
    bases = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    if bases[-1] >= (1 << 32) - 2:
        raise ValueError("more than 2**32 distinct words")
    model = Model(folder, order, shards, bases, sum(r["tokens"] for r in words), max(1 << 16, -(-(bases[-1] + 2) // shards)))
    if not model.tokens:
        return model
    id_ranges = -(-(model.size + 2) // model.id_range)

    def count_longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model, Files(folder))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> list[pa.RecordBatch]:
            context, word = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, at = _groups(context, word)
            n = np.diff(np.append(at, len(order))).astype(np.uint32)
            context, word = context[order[at]], word[order[at]].astype(np.uint32)
            return _rows(*_dealt(_home(_hash(context, word), shards), shards, context, word, n)).to_batches()

        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for i, j in slices(offsets):
                t = _tokens(vocabulary, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((t.context, t.word))
                if sum(len(k) for k, _ in held) > FLUSH:
                    yield from send()
        if held:
            yield from send()

    def to_words(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[list[int], list[bytes]]:
        """For pairs of ids sorted by the first: per id, followers and predecessors, dealt to the ranges of ids."""
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        first = [context[at], *(_small(x) for x in _followers(n, at))]
        words, preceded = np.unique(word.astype(np.uint64), return_counts=True)
        marks = np.arange(id_ranges + 1) * model.id_range
        ce, we = np.searchsorted(first[0], marks), np.searchsorted(words, marks)
        some = np.flatnonzero((ce[1:] > ce[:-1]) | (we[1:] > we[:-1])).tolist()
        return some, [pack(*(x[ce[r] : ce[r + 1]] for x in first), words[we[r] : we[r + 1]], preceded[we[r] : we[r + 1]].astype(np.uint32)) for r in some]

    def stats_row(length: int, n: np.ndarray) -> bytes:
        return pack(np.append(np.uint64(length), _count_of_counts(n)))

    def add_longest(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        parts = _blobs(table["blob"])
        (context, word), (n,) = _added(tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1)), (np.concatenate([p[2] for p in parts]),))
        del parts
        hashes = _hash(context, word)
        by_hash = np.argsort(hashes)
        _write_keys(mounted(folder), f"longest-{s:05d}", hashes[by_hash])
        _write_counts(mounted(folder), f"longest-{s:05d}", n[by_hash])
        del hashes, by_hash
        if order == 2:
            some, out = to_words(context, word, n)
            return _rows([*some, _STATS], [*out, stats_row(2, n)])
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        pairs = context[at]
        some, out = _dealt(_home(_hash(pairs >> np.uint64(32), pairs & _LOW), shards), shards, pairs, *(_small(x) for x in _followers(n, at)))
        last, before = np.unique((context & _LOW) << np.uint64(32) | word, return_counts=True)
        more, also = _dealt(_home(_hash(last >> np.uint64(32), last & _LOW), shards), shards, last, before.astype(np.uint32))
        return _rows([*some, *more, _STATS], [*out, *also, stats_row(3, n)])

    def add_pairs(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        if s == _STATS:
            return _rows([_STATS] * len(table), table["blob"].to_pylist())
        parts = _blobs(table["blob"])
        followed, preceded = [p for p in parts if len(p) == 5], [p for p in parts if len(p) == 2]
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *(p[0] for p in followed), *(p[0] for p in preceded)])
        n = sum(len(p[0]) for p in followed)
        columns = [np.concatenate([none, *(p[k] for p in followed), np.zeros(len(keys) - n, np.uint64)]) for k in range(1, 5)]
        before = np.concatenate([np.zeros(n, np.uint64), *(p[1] for p in preceded)])
        del parts, followed, preceded
        (pairs,), values = _added((keys,), (before, *columns))
        hashes = _hash(pairs >> np.uint64(32), pairs & _LOW)
        by_hash = np.argsort(hashes)
        _write_keys(mounted(folder), f"pairs-{s:05d}", hashes[by_hash])
        _write_codes(mounted(folder), f"pairs-{s:05d}", [x[by_hash] for x in values])
        own = values[0] > 0
        some, out = to_words(pairs[own] >> np.uint64(32), pairs[own] & _LOW, values[0][own])
        return _rows([*some, _STATS], [*out, stats_row(2, values[0][own])])

    def add_ids(table: pa.Table) -> pa.Table:
        r = table["shard"][0].as_py()
        if r == _STATS:
            return _rows([_STATS] * len(table), table["blob"].to_pylist())
        base, n = r * model.id_range, model.id_range
        arrays = [np.zeros(n, np.uint64) for _ in range(5)]
        for before, total, one, two, more, words, preceded in _blobs(table["blob"]):
            i = (before - np.uint64(base)).astype(np.int64)
            for x, part in zip(arrays, (total, one, two, more), strict=False):
                x[i] += part
            arrays[4][(words - np.uint64(base)).astype(np.int64)] += preceded
        at = mounted(folder)
        for name, x in zip(("total", "one", "two", "more", "preceded"), arrays, strict=True):
            write_whole(f"{at}/{name}-{r:05d}", x.astype("<u8").tobytes())
        p = arrays[4]
        return _rows([_STATS], [pack(np.append(np.append(np.uint64(1), _count_of_counts(p[p > 0])), np.uint64((p >= 3).sum())))])

    sent = texts.mapInArrow(count_longest, _PART).groupBy("shard").applyInArrow(add_longest, _PART)
    if order == 3:
        sent = sent.groupBy("shard").applyInArrow(add_pairs, _PART)
    counted: dict[int, np.ndarray] = {}
    for row in sent.groupBy("shard").applyInArrow(add_ids, _PART).toLocalIterator():
        (x,) = unpack(bytes(row["blob"]))
        counted[int(x[0])] = counted.get(int(x[0]), 0) + x[1:].astype(np.int64)
    for length, n in counted.items():
        model.discounts[length] = _discounts(n[1:5].tolist())
    model.kinds = int(counted[2][0])
    single = counted[1]
    model.spare = sum(d * k for d, k in zip(model.discounts[1], (single[1], single[2], single[5]), strict=True)) / model.kinds
    sweep(spark)
    return model


# --- scoring -------------------------------------------------------------------------------------


class Scorer:
    """log10 probabilities of tokens, from mapped arrays."""

    def __init__(self, model: Model) -> None:
        self.model, self.files = model, Files(model.folder)
        self.vocabulary = Vocabulary(model, self.files)

    def _by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """The array ``name`` at sorted ids."""
        out = np.zeros(len(ids))
        home = (ids // np.uint64(self.model.id_range)).astype(np.int64)
        edges = np.searchsorted(home, np.arange((home.max() if len(home) else -1) + 2))
        for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            x = self.files.get(f"{name}-{r:05d}", "<u8")
            if len(x):
                own = slice(edges[r], edges[r + 1])
                out[own] = x[(ids[own] - np.uint64(r * self.model.id_range)).astype(np.int64)]
        return out

    def _taken(self, n: np.ndarray, length: int) -> np.ndarray:
        return np.maximum(n - np.array([0.0, *self.model.discounts[length]])[np.minimum(n, 3).astype(np.int64)], 0)

    def _left(self, total, one, two, more, length: int) -> np.ndarray:
        """What the discounts of a context leave to the shorter distribution."""
        left = sum(d * x for d, x in zip(self.model.discounts[length], (one, two, more), strict=True))
        return np.where(total > 0, left / np.maximum(total, 1), 1.0)

    def _single(self, word: np.ndarray) -> np.ndarray:
        m = self.model
        ids, back = np.unique(word, return_inverse=True)
        return (self._taken(self._by_id("preceded", ids), 1) / max(1, m.kinds) + m.spare / (m.size + 1))[back]

    def _pairs(self, hashes: np.ndarray) -> np.ndarray:
        """(words before, total, one, two, more) of pairs by sorted hashes."""
        return _by_shard(hashes, self.model.shards, lambda s, h: self.files.coded(f"pairs-{s:05d}", h, 5), 5)

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        m = self.model
        hashes, first, back = np.unique(_hash(context, word), return_index=True, return_inverse=True)
        context, word = context[first], word[first]
        longest = _by_shard(hashes, m.shards, lambda s, h: self.files.counts(f"longest-{s:05d}", h))[:, 0]
        before = context & _LOW
        ids, at = np.unique(before, return_inverse=True)
        stats = [self._by_id(name, ids)[at] for name in ("total", "one", "two", "more")]
        p = self._left(*stats, 2) * self._single(word)
        if m.order == 2:
            p += self._taken(longest, 2) / np.maximum(stats[0], 1)
        else:
            last, at = np.unique(_hash(before, word), return_inverse=True)
            p += self._taken(self._pairs(last)[:, 0][at], 2) / np.maximum(stats[0], 1)
            pairs, at = np.unique(_hash(context >> np.uint64(32), before), return_inverse=True)
            stats = [x[at] for x in self._pairs(pairs)[:, 1:].T]
            p = self._taken(longest, 3) / np.maximum(stats[0], 1) + self._left(*stats, 3) * p
        return np.log10(p)[back]


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row; base_score adds one to the training counts of single tokens."""
    whole = model.tokens + model.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for i, j in slices(offsets):
                t = _tokens(scorer.vocabulary, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.cumsum(t.counts) - t.counts
                sums = [np.log10((t.seen + 1.0) / whole), scorer.log10(t.context, t.word)]
                base, own = (np.add.reduceat(x, at) for x in sums)
                known = np.add.reduceat((t.seen > 0).astype(np.int64), at)
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(t.counts.astype(np.int64)), pa.array(known), pa.array(base), pa.array(own)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCORED)


def train_and_score(docs: DataFrame, modulus: int = 7, held_out: int = 2, **options) -> DataFrame:
    """Scores every row by a model of those whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``; the model's files go
    once the scores are kept."""
    model = train(docs.filter(remainder("doc_id", modulus) != held_out), **options)
    scored = cut(score(docs, model))
    shutil.rmtree(mounted(model.folder), ignore_errors=True)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select(
        "doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"),
    )
