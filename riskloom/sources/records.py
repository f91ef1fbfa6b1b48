"""Records of CSV files whose texts hold line breaks, read by many tasks a file.

A quote opens or closes a text, so whether a split begins inside one follows from the number of quotes before it:

1. Spark's text source deals each file out in splits of whole lines. One pass counts the quotes of each split (in the JVM).
2. The driver adds the counts up along each file: one bit a split, inside a text or not.
3. Each split then puts its lines together to records on its own, from the first line that begins one.
4. Only a record that crosses a split boundary is in pieces: those few meet in a shuffle. No such record, no shuffle.

Quotes inside a text are doubled; a quote inside a field without quotes is an error of the file (it turns inside out what follows,
and the width of some row fails). Lines end in a line feed, with or without a carriage return; those inside texts stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, THROUGH, TAIL = range(4)  # a record, or the part of one at a split's begin, over the whole split, at its end
_PIECE = "file string, split long, kind int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return spark.read.option("lineSep", "\n").text(path).select("value", *place)


def _along(lines: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, bool]], list[str]]:
    """For each (file, split): whether it begins, and ends, inside a text; and the distinct first lines of the files.

    Per split only numbers are added up, so no task sorts its lines: a sort that spills would not keep them in the file's order.
    A first line is known by its hash and then looked up."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    line = F.xxhash64("value")
    rows = lines.groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd"), F.first(line).alias("line")).collect()
    out, heads = {}, set()
    for _, splits in groupby(sorted(rows, key=lambda r: (r["file"], r["split"])), key=lambda r: r["file"]):
        inside = False
        for k, r in enumerate(splits):
            if k == 0:
                heads.add(r["line"])
            out[r["file"], r["split"]] = (inside, inside != bool(r["odd"]))
            inside = inside != bool(r["odd"])
    # Good files have one header in up to four forms (with a mark of its encoding, with a carriage return): a few are enough to tell.
    return out, [lines.filter(line == h).select("value").first()[0] for h in sorted(heads)[:5]]


class _Split:
    """The records of one split, from its lines in order."""

    def __init__(self, file: str, split: int, inside: bool, first: bool) -> None:
        self.place, self.inside, self.head, self.skip = (file, split), inside, inside, first
        self.parts: list[str] = []

    def add(self, lines: pa.Array) -> Iterator[tuple[int, pa.Array | list[str]]]:
        """(kind, records) that are complete after these lines."""
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) & 1
        before = np.append(self.inside, after[:-1])
        begin = np.flatnonzero(before == 0)
        self.parts += lines[: begin[0] if len(begin) else len(lines)].to_pylist()
        if len(begin) == 0 and after[-1]:
            self.inside = True
            return
        if self.inside:
            yield HEAD if self.head else WHOLE, ["\n".join(self.parts)]
            self.parts, self.head = [], False
        size = np.diff(np.append(begin, len(lines)))
        done = np.ones(len(begin), bool)
        done[-1:] = not after[-1]
        done[:1] &= not (self.skip and len(begin))
        self.skip &= not len(begin)
        yield WHOLE, lines.take(pa.array(begin[done & (size == 1)]))
        for at, n in zip(begin[done & (size > 1)], size[done & (size > 1)], strict=True):
            yield WHOLE, ["\n".join(lines[at : at + n].to_pylist())]
        if after[-1]:
            self.parts = lines[begin[-1] :].to_pylist()
        self.inside = bool(after[-1])

    def end(self) -> Iterator[tuple[int, list[str]]]:
        if self.inside:
            yield THROUGH if self.head else TAIL, ["\n".join(self.parts)]


def _pieces(lines: DataFrame, inside: dict[tuple[str, int], tuple[bool, bool]]) -> DataFrame:
    """(file, split, kind, record): records and parts of records; the first record of each file, its header, is left out."""
    first = {file: min(s for f, s in inside if f == file) for file in {f for f, _ in inside}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shown(split: _Split, found) -> Iterator[pa.RecordBatch]:
            for kind, records in found:
                n = len(records)
                if n:
                    columns = [pa.array([split.place[0]] * n), pa.array([split.place[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(records, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "split", "kind", "record"])

        split = None
        for batch in batches:
            value, file, at = (batch.column(c) for c in ("value", "file", "split"))
            codes, starts = file.dictionary_encode().indices.to_numpy(), at.to_numpy()
            edges = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]))) if len(batch) else []
            for a, b in zip(edges, [*edges[1:], len(batch)], strict=False):
                place = (file[a].as_py(), at[a].as_py())
                if split is None or split.place != place:
                    if split is not None:
                        yield from shown(split, split.end())
                    split = _Split(*place, inside[place][0], first[place[0]] == place[1])
                yield from shown(split, split.add(value[a:b]))
        if split is not None:
            yield from shown(split, split.end())

    return lines.mapInArrow(run, _PIECE)


def records(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(record) of all files at ``path`` without their headers, and the header. Files with different headers raise an error."""
    lines = _lines(spark, path)
    inside, heads = _along(lines)
    heads = {h.removeprefix("﻿").removesuffix("\r") for h in heads}
    if len(heads) != 1:
        raise ValueError(f"no file, or files with different headers, at {path}: {sorted(heads)[:3]}")
    header = heads.pop()
    if header.count('"') % 2:
        raise ValueError(f"a header over several lines at {path}")
    pieces = _pieces(lines, inside)
    whole = pieces.filter(F.col("kind") == WHOLE).select("record")
    if any(at_end for _, at_end in inside.values()):
        # A record in pieces: a tail, what goes through, a head. Per file there are two pieces a split at most.
        along = Window.partitionBy("file").orderBy("split", "kind")
        parts = pieces.filter(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == TAIL).cast("long")).over(along))
        joined = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("split", "kind", "record"))).alias("x"))
        # Of one split the tail belongs to the next record, so inside a record each split has one piece.
        whole = whole.unionByName(joined.select(F.array_join("x.record", "\n").alias("record")))
    whole = whole.select(F.regexp_replace("record", "\r$", "").alias("record"))
    return whole.filter("record <> ''"), header


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with a header, as strings: empty fields are null, quoted ones are empty texts; a row of another width
    fails the read."""
    rows, header = records(spark, path)
    # Spark takes a field for null that reads as its null value. By default that is the empty text, quoted or not; here no text is.
    options = {"mode": "FAILFAST", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": f"null-{uuid.uuid4().hex}", "emptyValue": ""}
    names = spark.createDataFrame([(header,)], "h string").select(F.from_csv("h", ", ".join(f"c{k} string" for k in range(header.count(",") + 1)), {"quote": '"', "escape": '"'})).first()[0]
    names = [n for n in names if n is not None]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return rows.select(F.from_csv("record", schema, options).alias("x")).select("x.*")
