"""Hard negatives by k-means inverted lists with stored radii (operator 12). Results are exact.

Every row's components become whole numbers; scores are whole inner products. Centroids are fitted on at most ``SAMPLE`` rows
(a documented sample, chosen by hash); every row is then put into the list of its nearest centroid. Lists are dealt in ranges of
(list, row), so a list of any size falls into several segments of bounded size; a segment is a stretch of a file in the shared
folder that workers map into memory, and its entry in the directory has the largest distance from the centroid among its own
rows. The directory has a row per list and file, not per vector.

For an anchor q, no row of a segment scores more than q.centroid + |q| radius (Cauchy-Schwarz), nor less than q.centroid - |q|
radius. Segments are visited by falling upper bound. For positives the visit ends when the bound is strictly below the fifth
score (a tie may still bring a smaller id). For negatives each positive has a window of scores: segments wholly outside all
windows are skipped, and the visit ends when the bound is strictly below the fifth score, or the lower end, of each window. Bounds
are widened by more than their rounding error. A task works off its anchors one by one; it holds one mapped segment's block,
never the rows of a label or list.

Products are added in 32 or 64 bit floats where the norms prove each partial sum to be exact, else in Python's integers.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; missing components of shorter
vectors count as 0, an empty vector scores 0 with all; a null vec_id is no anchor, is never divisible by 7, and comes last among
ties; rows with equal ids or vectors are rows of their own; an anchor without another row of its label has no rows; a negative
positive_score has no negatives (its window is empty); scores beyond a long raise an error; an empty table gives an empty one;
columns besides vec_id, embedding and label are not looked at.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch, cut, mounted, new_folder, remove, write_whole

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Rows that centroids are fitted on at most, and their bytes; centroids at most; rounds.
SAMPLE, SAMPLE_BYTES, LISTS, ROUNDS = 32_768, 64 << 20, 1_024, 8
FILE_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20
OPEN_FILES = 16


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, vector): rows that take part, with the shifted labels and the vector as doubles."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole-number components, one vector a row, 0 after the end of shorter ones."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = np.floor(SCALE * column.flatten().to_numpy())
    return out


def k_means(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids; the first ones are rows spread over the sample, and one without rows stays where it is."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        home = nearest(sample, centroids)[0]
        count = np.bincount(home, minlength=lists)
        order = np.argsort(home, kind="stable")
        some = np.flatnonzero(count)
        sums = np.add.reduceat(sample[order], (np.cumsum(count) - count)[some], axis=0)
        centroids[some] = sums / count[some, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it (rounded up)."""
    home = np.argmin((centroids * centroids).sum(1) - 2 * (x @ centroids.T), axis=1)
    return home, np.sqrt(((x - centroids[home]) ** 2).sum(1)) * (1 + 1e-9)


@dataclass
class Index:
    """Centroids, and the segments as arrays: file number, first row in it, rows, list, radius, largest norm, least and last label."""

    width: int
    centroids: np.ndarray
    files: list[str]
    file: np.ndarray
    first: np.ndarray
    rows: np.ndarray
    list: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    least: np.ndarray
    last: np.ndarray


_SEGMENT = "path string, first long, rows long, list int, radius double, norm double, least long, last long"


def _file_parts(table: pa.Table, width: int) -> tuple[list[bytes], np.ndarray]:
    """A file: 8 bytes with the size of a component, then vectors, then ids, known ids, labels and row numbers."""
    x = matrix(table["vector"].combine_chunks(), width)
    kind = np.float32 if np.abs(x).max(initial=0) < 1 << 24 else np.float64
    ids = table["vec_id"].combine_chunks()
    parts = [np.array([np.dtype(kind).itemsize]), x.astype(kind), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), table["label"].to_numpy(), table["row"].to_numpy()]
    return [np.ascontiguousarray(p).tobytes() for p in parts], np.sqrt((x * x).sum(1))


def build(rows: DataFrame, folder: str, scratch: Scratch, lists: int | None = None, file_bytes: int = FILE_BYTES) -> Index:
    """Fits centroids on the sample and writes all ``rows`` into lists under ``folder``."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(1, width)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    chosen = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) <= F.lit((1 << 20) * 1.1 * most / max(1, n))
    sample = matrix(rows.filter(chosen).select("vector").limit(most).toArrow()["vector"].combine_chunks(), width)
    lists = max(1, min(lists or max(1, isqrt(n) // 2), LISTS, len(sample), SAMPLE_BYTES // (8 * width)))
    centroids = k_means(sample, lists) if len(sample) else np.zeros((1, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * (width + lists)))
        for batch in batches:
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                home, far = nearest(matrix(part.column("vector"), width), centroids)
                yield part.append_column("list", pa.array(home.astype(np.int32))).append_column("far", pa.array(far))

    placed = scratch.keep(rows.mapInArrow(assign, "row long, vec_id long, label long, vector array<double>, list int, far double"), "lists")
    files = max(1, -(-n * width * 8 // file_bytes))
    target = mounted(folder)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        path = os.path.join(target, f"{uuid.uuid4().hex}.lists")
        parts, norm = _file_parts(table, width)
        write_whole(path, *parts)
        home, far, label = (table[c].to_numpy() for c in ("list", "far", "label"))
        at = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        size = np.diff(np.append(at, len(home)))
        columns = [pa.array([path] * len(at)), pa.array(at), pa.array(size), pa.array(home[at])]
        columns += [pa.array(f.reduceat(x, at)) for f, x in ((np.maximum, far), (np.maximum, norm), (np.minimum, label), (np.maximum, label))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "first", "rows", "list", "radius", "norm", "least", "last"])

    dealt = placed.repartitionByRange(files, "list", "label", "row").sortWithinPartitions("list", "label", "row")
    found = dealt.mapInArrow(store, _SEGMENT).toArrow()
    scratch.drop(placed)
    paths = sorted(set(found["path"].to_pylist()))
    number = {p: k for k, p in enumerate(paths)}
    file = np.array([number[p] for p in found["path"].to_pylist()], np.int64)
    return Index(width, centroids, paths, file, *(found[c].to_numpy() for c in ("first", "rows", "list", "radius", "norm", "least", "last")))


class Searcher:
    """Visits an index's segments for one anchor at a time. ``visited`` and ``offered`` count rows scored and rows there were."""

    def __init__(self, index: Index) -> None:
        self.index, self.open, self.visited, self.offered = index, OrderedDict(), 0, 0

    def _file(self, number: int):
        if number not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)
            x = self.index
            mapped = np.memmap(x.files[number], np.uint8, "r")
            item = int(mapped[:8].view(np.int64)[0])
            n = (len(mapped) - 8) // (item * x.width + 32)
            at = 8 + n * x.width * item
            vectors = mapped[8:at].view(np.float32 if item == 4 else np.float64).reshape(n, x.width)
            self.open[number] = (vectors, *(mapped[at + 8 * n * k : at + 8 * n * (k + 1)].view(np.int64) for k in range(4)))
        self.open.move_to_end(number)
        return self.open[number]

    def _scores(self, segment: int, q: np.ndarray, length: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of (scores, ids, known ids, labels, rows) of a segment."""
        x = self.index
        vectors, *rest = self._file(int(x.file[segment]))
        first, end = int(x.first[segment]), int(x.first[segment] + x.rows[segment])
        step = max(1, BLOCK_BYTES // (8 * x.width))
        most = length * float(x.norm[segment])
        for k in range(first, end, step):
            at = slice(k, min(k + step, end))
            v = vectors[at]
            if most < 1 << 24 and v.dtype == np.float32:
                score = (v @ q.astype(np.float32)).astype(np.int64)
            elif most < 1 << 53:
                score = (v.astype(np.float64) @ q).astype(np.int64)
            else:
                whole = [int(c) for c in q]
                score = np.array([sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in v.tolist()], np.int64)
            self.visited += len(score)
            yield score, *(r[at] for r in rest)

    def _bounds(self, q: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        x = self.index
        middle = (x.centroids @ q)[x.list]
        spread = length * x.radius
        spread = spread + 1e-12 * x.width * (np.abs(middle) + length * (x.radius + x.norm)) + 1e-9
        return middle + spread, middle - spread

    def positives(self, q: np.ndarray, label: int, row: int) -> list[tuple]:
        """The first rows of the anchor's label, as (-score, id unknown, id)."""
        x, length, best = self.index, float(np.sqrt((q * q).sum())), []
        high, _ = self._bounds(q, length)
        self.offered += int(x.rows.sum())
        for s in np.argsort(-high, kind="stable"):
            if len(best) == POSITIVES and high[s] < -best[-1][0]:
                break
            if x.least[s] <= label <= x.last[s]:
                for score, ids, known, labels, rows in self._scores(s, q, length):
                    best = _first(best, POSITIVES, np.flatnonzero((labels == label) & (rows != row)), score, ids, known)
        return best

    def negatives(self, q: np.ndarray, label: int, scores: list[int]) -> list[list[tuple]]:
        """For each positive score the first rows of other labels in its window, as (-score, id unknown, id)."""
        x, length = self.index, float(np.sqrt((q * q).sum()))
        high, low = self._bounds(q, length)
        windows = [(-(-4 * p // 5), p) for p in scores]
        best: list[list[tuple]] = [[] for _ in windows]
        need = [a if a <= b else None for a, b in windows]  # what a score must reach to matter; None: no score can
        self.offered += int(x.rows.sum())
        for s in np.argsort(-high, kind="stable"):
            wanted = [k for k, least in enumerate(need) if least is not None and high[s] >= least]
            if not wanted:
                break
            wanted = [k for k in wanted if low[s] <= windows[k][1]]
            if not wanted or x.least[s] == x.last[s] == label:
                continue
            for score, ids, known, labels, _ in self._scores(s, q, length):
                for k in wanted:
                    hit = np.flatnonzero((score >= need[k]) & (score <= windows[k][1]) & (labels != label))
                    if len(hit):
                        best[k] = _first(best[k], NEGATIVES, hit, score, ids, known)
                        if len(best[k]) == NEGATIVES:
                            need[k] = max(need[k], -best[k][-1][0])
        return best


def _first(best: list[tuple], k: int, at: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> list[tuple]:
    """The first k of ``best`` and the rows ``at``: by score, then id, unknown ids last."""
    if len(at) > 8 * k:  # ties of the k-th score stay
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[at], 1 - known[at], -score[at]))[:k]]
    return sorted(best + [(-int(score[i]), 1 - int(known[i]), int(ids[i])) for i in at])[:k]


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(embeddings: DataFrame, every: int = 100, **options) -> DataFrame:
    """``_RESULT`` rows for the anchors: rows whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    folder = new_folder(spark, "lists")
    with Scratch(spark) as scratch:
        rows = scratch.keep(taking_part(embeddings), "vectors")
        index = build(rows, folder, scratch, **options)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(index)
            for batch in batches:
                ids, labels, numbers = (batch.column(c).to_numpy() for c in ("vec_id", "label", "row"))
                for k in range(len(batch)):
                    q = matrix(batch.column("vector").slice(k, 1), index.width)[0]
                    ahead = searcher.positives(q, int(labels[k]), int(numbers[k]))
                    behind = searcher.negatives(q, int(labels[k]), [-p[0] for p in ahead])
                    out = [(int(ids[k]), None if p[1] else p[2], r, None if x[1] else x[2], -p[0], -x[0]) for p, found in zip(ahead, behind, strict=True) for r, x in enumerate(found, 1)]
                    if out:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        # The work is in the visits, not in the bytes: a fixed number of tasks, which Spark doesn't merge for being small.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        anchors = rows.filter(F.col("vec_id") % every == 0).repartition(tasks, F.xxhash64("row"))
        found = cut(anchors.mapInArrow(search, _RESULT))
    remove(spark, folder)
    return found


#: The same by all pairs.
SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(COALESCE(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor, anchor_id, r AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST) QUALIFY row_number() OVER w <= {NEGATIVES}"""
