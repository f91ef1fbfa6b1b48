"""SimHash near-duplicates by bit-sliced comparison (operator 13).

A text's fingerprint has 64 bits; a bit is 1 where more than half of the text's 3-word shingles (repeats included) have it in
their XXH64 (seed 42). Fingerprints that differ in at most ``RADIUS`` bits link; components are exact.

1. Equal fingerprints are one row from the first shuffle on, so exact copies of any number are never compared.
2. Candidates. Two fingerprints within three bits agree on one of four bands of their bits, so a row per band is dealt by what
   it has there. A group of more than ``REFINE`` rows is split again: its members agree on the band, differ in three of the
   other bits at most, and so agree on one of four bands of those. After ``LEVELS`` such steps 16 bits are left, and a group
   cannot have more than 2**16 different members. Groups are bounded by that arithmetic, with no cap and no pair left out.
3. Comparison. A task lays out the rows of its groups 64 to a machine word, one word array per bit (planes stored vertically).
   One row against 64 is an exclusive or per plane; carry-save counters (ones, twos, and a bit for "four or more") add 64
   distances at once. After every eight planes the words of which all 64 have four or more are abandoned.
4. Each task merges what it finds and gives back one link per row and group at most; ``components`` joins them.

Edge cases: null, empty and wordless texts have fingerprint zero and link like any other; with one or two words the whole
sequence is the shingle; very long texts are hashed in stretches of ``STRETCH`` bytes, and only a single word is ever held whole;
ties (a bit set in exactly half the shingles) give 0; repeated rows are rows of their own with equal results; a null doc_id
counts for no smallest id (a component of null ids only has a null component_id); an empty table gives an empty one; columns
besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch, cut
from riskloom.llm._text import texts_of
from riskloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
STRETCH = 1 << 20
BANDS = RADIUS + 1
#: A larger group is split by a further band; the last level's groups have at most 2**16 members anyway.
REFINE, LEVELS = 8_192, 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints --------------------------------------------------------------------------------


def shingle_hashes(text: bytes, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, in arrays of a stretch's."""
    at, words, seen = 0, [], 0
    while at < len(text):
        end = _SPACE.search(text, at + stretch)
        end = end.start() if end else len(text)
        words += text[at:end].translate(_LOWER).split()
        at = end
        found = zip(*(words[k:] for k in range(SHINGLE)), strict=False)
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in found]
        if hashes:
            yield np.array(hashes, np.uint64)
        seen += len(hashes)
        words = words[-(SHINGLE - 1) :]
    if not seen and words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


_BYTE_PLACE = np.arange(8, dtype=np.int64) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, stretch: int = STRETCH) -> int:
    """Of each byte place the values are counted, then the bits: a histogram of 2,048 cells whatever the length."""
    cells, n = np.zeros(2048, np.int64), 0
    for hashes in shingle_hashes(text, stretch):
        cells += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE).ravel(), minlength=2048)
        n += len(hashes)
    bits = (2 * (cells.reshape(8, 256) @ _BYTE_BITS).ravel() > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): each text's fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column("text"))
            found = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


# --- bands ---------------------------------------------------------------------------------------


def band_masks(levels: int = LEVELS, bits: int = 64) -> list[list[int]]:
    """Of each level the bits that a group agrees on, by path: path 4p + k adds the k-th band of what path p leaves open."""
    out = [[0]]
    for _ in range(levels):
        step = []
        for mask in out[-1]:
            left = [b for b in range(bits) if not mask >> b & 1]
            step += [mask | sum(1 << b for b in band.tolist()) for band in np.array_split(left, BANDS)]
        out.append(step)
    return out[1:]


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(path, key, print) of rows (path, print): one for each further band. Keys of different bits that collide only cost comparisons."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    mask: Column = F.get(F.array(*[F.lit(m).cast("long") for m in signed]), F.col("path"))
    paths = rows.select(F.explode(F.transform(F.array(*map(F.lit, range(BANDS))), lambda k: F.col("path") * BANDS + k)).alias("path"), "print")
    return paths.select("path", F.xxhash64("path", F.col("print").bitwiseAND(mask)).alias("key"), "print")


# --- comparison ----------------------------------------------------------------------------------


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane b holds bit b of rows 64 w to 64 w + 63; places after the last row are 0."""
    full = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    full[: len(prints)] = prints
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_pairs(planes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) at distance three or less, i in a word of ``left`` and j in the word of ``right`` at the same place."""
    row = np.tile(np.arange(64, dtype=np.uint64), len(left))
    left, right = np.repeat(left, 64), np.repeat(right, 64)
    ones, twos, over = (np.zeros(len(row), np.uint64) for _ in range(3))
    for k in range(0, 64, 2):
        first, second = (planes[b][right] ^ (np.uint64(0) - (planes[b][left] >> row & np.uint64(1))) for b in (k, k + 1))
        half = ones ^ first
        carry = ones & first | half & second
        ones = half ^ second
        over |= twos & carry
        twos ^= carry
        if k % 8 == 6:
            open_ = np.flatnonzero(over != _ALL)
            if 2 * len(open_) <= len(over):
                row, left, right, ones, twos, over = (x[open_] for x in (row, left, right, ones, twos, over))
                if not len(open_):
                    break
    some = np.flatnonzero(over != _ALL)
    cell, column = np.nonzero(np.unpackbits((~over[some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at = some[cell]
    return left[at] * 64 + row[at].astype(np.int64), right[at] * 64 + column


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (places that point at a smaller or equal one, roots at themselves) after links i-j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def linked_rows(keys: np.ndarray, prints: np.ndarray, pairs_at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(print, print) links that connect what is near inside groups of equal keys (sorted)."""
    n = len(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(starts[1:], n)
    starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
    if not len(starts):
        return prints[:0], prints[:0]
    planes, label = bit_planes(prints), np.arange(n)
    for left, right in _word_pairs(starts >> 6, (ends - 1) >> 6, pairs_at_once):
        i, j = near_pairs(planes, left, right)
        real = (i != j) & (i < n) & (j < n)
        label = _merge(label, i[real], j[real])
    linked = np.flatnonzero(label != np.arange(n))
    return prints[linked], prints[label[linked]]


def _word_pairs(first: np.ndarray, last: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words that some group spans, ``at_once`` at a time: of groups inside two words in one go, of larger ones one after the other."""
    small = last - first <= 1
    a, b = first[small], last[small]
    near = np.unique(np.concatenate([np.column_stack(x) for x in ((a, a), (a, b), (b, b))]), axis=0)
    for k in range(0, len(near), at_once):
        yield near[k : k + at_once, 0], near[k : k + at_once, 1]
    for f, t in zip(first[~small], last[~small], strict=True):
        for w in range(f, t + 1):
            for k in range(w, t + 1, at_once):
                right = np.arange(k, min(k + at_once, t + 1))
                yield np.full(len(right), w), right


def _links(rows: DataFrame, at_least: int = 1 << 16) -> DataFrame:
    """(a, b) links inside the groups of rows (key, print). A task holds ``at_least`` rows and the rest of the last group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, prints):
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in linked_rows(keys, prints.view(np.uint64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("key", "print")))
            if sum(len(k) for k, _ in held) >= at_least:
                keys, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                cut_at = int(np.searchsorted(keys, keys[-1]))
                if cut_at:
                    yield found(keys[:cut_at], prints[:cut_at])
                held = [(keys[cut_at:], prints[cut_at:])]
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.select("key", "print").repartition("key").sortWithinPartitions("key", "print")
    return dealt.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, scratch: Scratch, refine: int = REFINE) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (print) within the radius; tables of ``scratch``."""
    masks = band_masks()
    rows, out = prints.select(F.lit(0).alias("path"), "print"), None
    for level in range(LEVELS):
        dealt = _dealt(rows, masks[level])
        large = None
        if level + 1 < LEVELS:
            large = scratch.keep(dealt.groupBy("key").count().filter(F.col("count") > refine).select("key"), "large")
            if large.isEmpty():
                large = None
        small = dealt if large is None else dealt.join(large, "key", "left_anti")
        found = scratch.keep(_links(small), "links")
        out = found if out is None else out.unionByName(found)
        if large is None:
            return out
        rows = scratch.keep(dealt.join(large, "key", "left_semi").select("path", "print"), "again")
    return out


def near_duplicates(docs: DataFrame, refine: int = REFINE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(fingerprints(docs), "prints")
        classes = scratch.keep(rows.groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")), "classes")
        label = components(links(classes, scratch, refine), scratch)
        placed = classes.join(label, classes["print"] == label["node"], "left").withColumn("root", F.coalesce("component", "print"))
        least = placed.filter("component IS NOT NULL").groupBy("root").agg(F.min("first_doc").alias("least"))
        # Only fingerprints of several rows, or with links, need a look-up; the others' component is the row itself.
        shared = placed.filter("copies > 1 OR component IS NOT NULL").join(least, "root", "left")
        shared = shared.select("print", F.coalesce("least", "first_doc").alias("component_id"), F.lit(True).alias("held"))
        found = rows.join(shared, "print", "left")
        own = F.when(F.col("held"), F.col("component_id")).otherwise(F.col("doc_id"))
        shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
        return cut(found.select("doc_id", shown.alias("fingerprint"), own.alias("component_id")))
