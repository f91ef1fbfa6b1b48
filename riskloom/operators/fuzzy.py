"""Look-alike names: five similarity metrics, a weighted score, and the join that finds pairs above a score.

The match is exact: names are held against a bounded set of targets in blocks; a bound on the score drops most pairs, and the rest
are scored over arrays of pairs at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The metrics' weights in percent, in their order.
WEIGHTS = {"levenshtein": 20, "osa": 25, "jaro_winkler": 25, "keyboard": 15, "prefix": 15}
LENGTH_GAP = 0.3
#: Keyboard rows with the place of their first key and the row's depth.
KEY_ROWS = (("1234567890-", 0.0, 0.0), ("qwertyuiop", 0.25, 1.0), ("asdfghjkl", 0.5, 2.0), ("zxcvbnm", 0.75, 3.0), ("_", 10.5, 0.0))
KEYS = {c: (x + i, y) for row, x, y in KEY_ROWS for i, c in enumerate(row)}
FAR_KEY = 5.0


def _rounded(x: float) -> int:
    """Half away from zero, kept within 0 to 100."""
    return max(0, min(100, math.floor(x + 0.5)))


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + (x != y))
            row.append(best)
        two, one = one, row
    return one[-1]


def osa_similarity(a: str, b: str) -> int:
    longest = max(len(a.encode()), len(b.encode()))
    return 100 if not longest else _rounded((1 - osa_distance(a, b) / longest) * 100)


def jaro_winkler_similarity(a: str, b: str) -> int:
    if not a and not b:
        return 100
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    matched_a, places = [], []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if free[j] == x), None)
        if j is not None:
            free[j] = ""
            matched_a.append(x)
            places.append(j)
    m = len(places)
    if not m:
        jaro = 0.0
    else:
        swaps = sum(x != b[j] for x, j in zip(matched_a, sorted(places), strict=True)) / 2
        jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return _rounded((jaro + lead * 0.1 * (1 - jaro)) * 100)


def _key_distance(x: str, y: str) -> float:
    p, q = KEYS.get(x.lower() if x.isascii() else x), KEYS.get(y.lower() if y.isascii() else y)
    return math.dist(p, q) if p and q else FAR_KEY


def keyboard_similarity(a: str, b: str) -> int:
    apart = [_key_distance(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if len(a) != len(b):
        gap, longest = abs(len(a) - len(b)), max(len(a), len(b))
        near = 1 - (sum(apart) + 2 * gap) / (5 * longest)
        return _rounded((near * 0.7 + (1 - gap / longest) * 0.3) * 100)
    if not apart:
        return 100
    return _rounded(((1 - sum(apart) / (5 * len(apart))) * 0.5 + (1 - len(apart) / len(a)) * 0.5) * 100)


def combined_score(scores: dict[str, int]) -> int:
    return sum(scores[k] * w for k, w in WEIGHTS.items()) // 100


# --- Column forms --------------------------------------------------------------------------------


def _longest(a: Column, b: Column) -> Column:
    return F.greatest(F.octet_length(a), F.octet_length(b))


def levenshtein_score(a: Column, b: Column) -> Column:
    return F.when(_longest(a, b) == 0, 100).otherwise(F.floor((1 - F.levenshtein(a, b) / _longest(a, b)) * 100 + 0.5)).cast("int")


def common_prefix(a: Column, b: Column, most: int = 128) -> Column:
    """Code points that two texts start with alike. The longest prefix by halving: a prefix that matches bounds the shorter ones."""
    shorter = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(shorter, F.lit(0))), lambda k: F.left(a, k) == F.left(b, k))), F.lit(0))


def prefix_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    lead = common_prefix(a, b)
    score = F.floor((lead / longest + F.when(lead >= 3, 0.1).otherwise(0.0)) * 100 + 0.5)
    return F.when(longest == 0, 100).otherwise(F.least(score, F.lit(100))).cast("int")


# --- the three metrics over arrays of pairs --------------------------------------------------------


def _codes(names: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with 0, lengths) of names, a row each."""
    length = names.str.len().to_numpy(np.int64)
    width = int(length.max(initial=0))
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(names), width), np.uint32)
    out[np.arange(width) < length[:, None]] = flat
    return out, length


def _round(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 100).astype(np.int32)


def osa_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``osa_distance`` of many pairs: all columns of a row of the table at once."""
    n, width = b.shape
    steps = np.arange(width + 1, dtype=np.int32)
    one = np.broadcast_to(steps, (n, width + 1)).copy()
    two, out, rows = one, np.where(la == 0, lb, 0).astype(np.int32), np.arange(n)
    for i in range(1, a.shape[1] + 1):
        differs = (a[:, i - 1, None] != b).astype(np.int32)
        row = np.empty_like(one)
        row[:, 0] = i
        row[:, 1:] = np.minimum(one[:, 1:] + 1, one[:, :-1] + differs)
        if i > 1 and width > 1:
            swapped = (a[:, i - 1, None] == b[:, :-1]) & (a[:, i - 2, None] == b[:, 1:])
            row[:, 2:] = np.where(swapped, np.minimum(row[:, 2:], two[:, :-2] + differs[:, 1:]), row[:, 2:])
        row = np.minimum.accumulate(row - steps, axis=1) + steps  # an insertion costs one for each column on
        done = la == i
        out[done] = row[rows[done], lb[done]]
        two, one = one, row
    return out


def jaro_winkler_similarities(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, rows = len(a), np.arange(len(a))
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    at = np.arange(b.shape[1])
    free = at < lb[:, None]
    hit = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        near = free & (b == a[:, i, None]) & (np.abs(at - i) <= reach[:, None]) & (i < la)[:, None]
        found = near.any(1) if b.shape[1] else np.zeros(n, bool)
        hit[:, i] = found
        free[rows[found], near[found].argmax(1)] = False
    taken = (at < lb[:, None]) & ~free
    m = hit.sum(1)
    most = min(a.shape[1], b.shape[1])
    first = np.take_along_axis(a, np.argsort(~hit, axis=1, kind="stable"), 1)[:, :most]
    second = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable"), 1)[:, :most]
    swaps = ((first != second) & (np.arange(most) < m[:, None])).sum(1) / 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / some) / 3, 0.0)
    lead = np.zeros(n, np.int64)
    going = np.ones(n, bool)
    for k in range(min(4, most)):
        going &= (k < la) & (k < lb) & (a[:, k] == b[:, k])
        lead += going
    return np.where((la == 0) & (lb == 0), 100, _round((jaro + lead * 0.1 * (1 - jaro)) * 100))


_KEYBOARD = np.array([[_key_distance(chr(x), chr(y)) for y in range(129)] for x in range(129)])  # 128: any key that is not on it


def keyboard_similarities(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    total, differ = np.zeros(len(a)), np.zeros(len(a), np.int64)
    for k in range(min(a.shape[1], b.shape[1])):
        x, y = a[:, k], b[:, k]
        apart = (x != y) & (k < la) & (k < lb)
        total += np.where(apart, _KEYBOARD[np.minimum(x, 128), np.minimum(y, 128)], 0.0)
        differ += apart
    gap, longest = np.abs(la - lb), np.maximum(np.maximum(la, lb), 1)
    other = _round(((1 - (total + 2 * gap) / (5 * longest)) * 0.7 + (1 - gap / longest) * 0.3) * 100)
    some = np.maximum(differ, 1)
    same = _round(((1 - total / (5 * some)) * 0.5 + (1 - differ / np.maximum(la, 1)) * 0.5) * 100)
    return np.where(gap > 0, other, np.where(differ == 0, 100, same)).astype(np.int32)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("osa", "jaro_winkler", "keyboard")]))
def _array_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pair = (*_codes(a), *_codes(b))
    longest = np.maximum(*(x.str.encode("utf-8").str.len().to_numpy(np.int64) for x in (a, b)))
    osa = np.where(longest == 0, 100, _round((1 - osa_distances(*pair) / np.maximum(longest, 1)) * 100))
    return pd.DataFrame({"osa": osa, "jaro_winkler": jaro_winkler_similarities(*pair), "keyboard": keyboard_similarities(*pair)})


def all_scores(pairs: DataFrame, a: str, b: str, min_score: int = 0) -> DataFrame:
    """``pairs`` with the five metrics and ``combined`` of columns a and b; pairs under ``min_score`` are dropped."""
    x, y = F.col(a), F.col(b)
    rows = pairs.withColumn("levenshtein", levenshtein_score(x, y)).withColumn("prefix", prefix_score(x, y))
    if min_score:
        # A swap is two plain edits, so the swap-aware distance is at least half the plain one; the others are at most 100.
        osa_most = F.least(F.lit(100.0), F.floor((1 - F.ceil(F.levenshtein(x, y) / 2) / _longest(x, y)) * 100 + 0.5))
        rows = rows.filter(20 * F.col("levenshtein") + 25 * osa_most + 25 * 100 + 15 * 100 + 15 * F.col("prefix") >= 100 * min_score)
    rows = rows.withColumn("_s", _array_scores(x, y)).select("*", "_s.*").drop("_s")
    rows = rows.withColumn("combined", F.floor(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0)) / 100).cast("int"))
    return rows.filter(F.col("combined") >= min_score)


# --- the matcher -----------------------------------------------------------------------------------

_BAG, _UNARY = 64, 3  # cells that characters fall into by their code, and how many of a cell are told apart


class Bags:
    """The characters of names as bits, a name a row: bit c of word k is set where more than k characters fall into cell c. What two
    names share is then at most the number of bits they share, and of what goes beyond ``_UNARY`` the smaller part."""

    def __init__(self, codes: np.ndarray, length: np.ndarray) -> None:
        cell = np.where(np.arange(codes.shape[1]) < length[:, None], codes % _BAG, _BAG)
        flat = cell + np.arange(len(codes))[:, None] * (_BAG + 1)
        counts = np.bincount(flat.ravel().astype(np.int64), minlength=len(codes) * (_BAG + 1)).reshape(len(codes), _BAG + 1)[:, :_BAG]
        self.words = [np.packbits(counts > k, axis=1, bitorder="little").view(np.uint64).ravel() for k in range(_UNARY)]
        self.rest = np.maximum(counts - _UNARY, 0).sum(1).astype(np.uint32)

    def shared(self, own: slice, other: Bags, row: int) -> np.ndarray:
        """Characters that names ``own`` share with a name of ``other`` at most."""
        bits = np.zeros(own.stop - own.start, np.uint8)
        for mine, theirs in zip(self.words, other.words, strict=True):
            if theirs[row]:
                bits += np.bitwise_count(mine[own] & theirs[row])
        return bits + np.minimum(self.rest[own], other.rest[row]) if other.rest[row] else bits


def _distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of many pairs: as ``osa_distances``, without swaps."""
    n, width = b.shape
    steps = np.arange(width + 1, dtype=np.int32)
    one = np.broadcast_to(steps, (n, width + 1))
    out, rows = np.where(la == 0, lb, 0).astype(np.int32), np.arange(n)
    for i in range(1, a.shape[1] + 1):
        row = np.empty((n, width + 1), np.int32)
        row[:, 0] = i
        row[:, 1:] = np.minimum(one[:, 1:] + 1, one[:, :-1] + (a[:, i - 1, None] != b))
        one = np.minimum.accumulate(row - steps, axis=1) + steps
        done = la == i
        out[done] = one[rows[done], lb[done]]
    return out


def bit_distances(places: np.ndarray, row: np.ndarray, la: np.ndarray, letters: np.ndarray, lb: np.ndarray, swaps: bool) -> np.ndarray:
    """Levenshtein distances, or with ``swaps`` optimal string alignment, of many pairs, a column of the table as one machine word a pair
    (Myers' bit vectors, Hyyro's term for swaps). ``places[row, letter]`` has a bit for each place of the letter in the first name, of
    1 to 64 letters; ``letters`` are those of the second."""
    one, top = np.uint64(1), (la - 1).astype(np.uint64)
    up, down = np.full(len(row), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(row), np.uint64)
    distance, out = la.astype(np.int32), np.where(lb == 0, la, 0).astype(np.int32)
    diagonal = before = np.zeros(len(row), np.uint64)
    for j in range(letters.shape[1]):
        match = places[row, letters[:, j]]
        swapped = (~diagonal & match) << one & before if swaps and j else np.uint64(0)
        diagonal = ((match & up) + up ^ up) | match | down | swapped
        right, left = down | ~(diagonal | up), diagonal & up
        distance = distance + (right >> top & one).astype(np.int32) - (left >> top & one).astype(np.int32)
        right, left = right << one | one, left << one
        up, down, before = left | ~(diagonal | right), right & diagonal, match
        ends = lb == j + 1
        out[ends] = distance[ends]
    return out


def _prefix(lead: np.ndarray, longest: np.ndarray) -> np.ndarray:
    score = np.minimum(np.floor((lead / np.maximum(longest, 1) + np.where(lead >= 3, 0.1, 0.0)) * 100 + 0.5), 100)
    return np.where(longest == 0, 100, score).astype(np.int32)


class Targets:
    """The names that all others are held against, by byte length, with their character counts."""

    def __init__(self, table: pa.Table) -> None:
        names = table["name"].to_pandas()
        size = names.str.encode("utf-8").str.len().to_numpy(np.int64)
        order = np.argsort(size, kind="stable")
        self.size, self.names = size[order], names.to_numpy()[order]
        self.ids, self.downloads = table["id"].to_numpy()[order], table["downloads"].to_numpy()[order]
        self.codes, self.length = _codes(names.iloc[order])
        self.bags = Bags(self.codes, self.length)
        self.alphabet = np.unique(self.codes)
        self.letters = np.searchsorted(self.alphabet, self.codes)
        self.columns = np.ascontiguousarray(self.codes.T[:3])
        self.kinds, kind = np.unique(np.stack([self.length, self.size], 1), axis=0, return_inverse=True)
        self.kind, self.rooms = kind.ravel(), {}

    def room(self, length: int, size: int, min_score: int) -> Room:
        """What names of these lengths need. Few lengths occur, so it is worked out once for each."""
        if (length, size, min_score) not in self.rooms:
            self.rooms[length, size, min_score] = Room(self, length, size, min_score)
        return self.rooms[length, size, min_score]

    def near(self, names: Names, i: int, min_score: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets in the length band of name i whose score can reach ``min_score`` by what the names have in common at most, the most
        that Jaro-Winkler can be, and the common prefix. What the bits alone rule out, most of the band, is never looked at letter by letter."""
        room = self.room(int(names.length[i]), int(names.size[i]), min_score)
        common = self.bags.shared(room.band, names.bags, i)
        letters, possible, alike = names.codes[i, : names.length[i]], common >= room.need[0], True
        for need, column, letter in zip(room.need[1:], self.columns, letters, strict=False):
            alike = alike & (column[room.band] == letter)
            possible |= alike & (common >= need)
        some = np.flatnonzero(possible)
        own, common = room.band.start + some, common[some]
        kind = self.kind[own]
        same = np.zeros((len(own), min(len(letters), self.codes.shape[1]) + 1), bool)
        np.equal(self.codes[own, : same.shape[1] - 1], letters[: same.shape[1] - 1], out=same[:, :-1])
        lead = np.minimum(same.argmin(1), self.length[own])
        jaro = room.jaro[kind, common]
        winkler = (jaro + np.minimum(lead, 4) * 0.1 * (1 - jaro)) * 100 + 1
        good = np.flatnonzero(room.fixed[kind, common] + 25 * winkler + 15 * _prefix(lead, room.wide[kind]) >= 100 * min_score)
        return own[good], winkler[good], lead[good]


class Room:
    """For names of one length: the targets in their length band, the fewest common characters with which each can reach the score (by
    whether the names begin with none, one, two, or three and more letters alike), and by kind of target (length and size) and number
    of common characters the most of what doesn't depend on the common prefix."""

    def __init__(self, targets: Targets, length: int, size: int, min_score: int) -> None:
        a = np.searchsorted(targets.size, int(size * (1 - LENGTH_GAP)) - 1)
        b = np.searchsorted(targets.size, int(size / (1 - LENGTH_GAP)) + 1, "right")
        theirs, sizes = targets.kinds[:, 0, None], targets.kinds[:, 1, None]
        most = np.minimum(theirs, length)
        common = np.minimum(np.arange(most.max(initial=0) + 1), most)
        longest = np.maximum(np.maximum(sizes, size), 1)
        # Every edit and swap changes the bag of characters by one at most; matches are common characters.
        edits = 1 - (np.maximum(theirs, length) - common) / longest
        self.jaro = np.where(common > 0, (common / max(length, 1) + common / np.maximum(theirs, 1) + 1) / 3, 0.0)
        apart, wide = np.abs(theirs - length), np.maximum(np.maximum(theirs, length), 1)
        keys = np.where(apart > 0, (1 - 2 * apart / (5 * wide)) * 0.7 + (1 - apart / wide) * 0.3, 1.0)
        self.fixed, self.wide = 45 * (edits * 100 + 1) + 15 * (keys * 100 + 1), wide.ravel()
        winkler = lambda lead: 25 * ((self.jaro + lead * 0.1 * (1 - self.jaro)) * 100 + 1)
        begins = [winkler(k) + 15 * _prefix(np.array(k), wide) for k in range(3)] + [winkler(4) + 15 * 100]
        inside = np.abs(sizes - size) / longest <= LENGTH_GAP
        self.band, self.need = slice(int(a), int(b)), []
        for begin in begins:  # more in common is never less of a score
            enough = (self.fixed + begin >= 100 * min_score) & inside
            need = np.where(enough.any(1), enough.argmax(1), np.iinfo(np.int64).max)[targets.kind[a:b]]
            # As narrow as the counts of bits where that can hold it: no name has 255 letters in common then.
            self.need.append(np.minimum(need, 255).astype(np.uint8) if most.max(initial=0) < 255 else need)


class Names:
    """A batch of names: ids, downloads, code points, byte lengths, bags, and the places of each letter of an alphabet as bits."""

    def __init__(self, batch: pa.RecordBatch, alphabet: np.ndarray) -> None:
        names = batch.column("name").to_pandas()
        self.names = names.to_numpy()
        self.ids, self.downloads = (batch.column(c).fill_null(0).to_numpy() for c in ("id", "downloads"))
        self.codes, self.length = _codes(names)
        self.size, self.bags = names.str.encode("utf-8").str.len().to_numpy(np.int64), Bags(self.codes, self.length)
        self.places = np.zeros((len(names), max(1, len(alphabet))), np.uint64)
        for j in range(min(64, self.codes.shape[1]) if len(alphabet) else 0):
            letter = np.minimum(np.searchsorted(alphabet, self.codes[:, j]), len(alphabet) - 1)
            row = np.flatnonzero((alphabet[letter] == self.codes[:, j]) & (j < self.length))
            self.places[row, letter[row]] |= np.uint64(1 << j)


def _scored(names: Names, targets: Targets, x: np.ndarray, y: np.ndarray, winkler: np.ndarray, lead: np.ndarray, min_score: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Those of the pairs (x, y) that reach ``min_score``, and their metrics. The cheap metrics come first; after each, pairs go that
    cannot reach the score with what is known (a swap is two plain edits)."""
    kept, scores = np.arange(len(x)), {}

    def pair() -> tuple[np.ndarray, ...]:
        return names.codes[x[kept]], names.length[x[kept]], targets.codes[y[kept]], targets.length[y[kept]]

    def narrow(most: np.ndarray) -> None:
        nonlocal kept
        good = np.flatnonzero(most >= 100 * min_score)
        kept = kept[good]
        for k in scores:
            scores[k] = scores[k][good]

    def distances(swaps: bool) -> np.ndarray:
        p = pair()
        fits = (p[1] > 0) & (p[1] <= 64)
        if not fits.all():  # longer than a machine word: by tables
            return osa_distances(*p) if swaps else _distances(*p)
        return bit_distances(names.places, x[kept], p[1], targets.letters[y[kept]], p[3], swaps)

    size = lambda: np.maximum(np.maximum(names.size[x[kept]], targets.size[y[kept]]), 1)
    scores["prefix"] = _prefix(lead, np.maximum(names.length[x], targets.length[y]))
    edits = distances(False)
    rate = lambda d: np.where(d == 0, 100, _round((1 - d / size()) * 100))
    scores["levenshtein"] = rate(edits)
    known = 20 * scores["levenshtein"].astype(np.int64) + 15 * scores["prefix"] + 25 * rate(-(-edits // 2)) + 25 * winkler
    narrow(known + 15 * 100)
    scores["keyboard"] = keyboard_similarities(*pair())
    narrow(known[kept] + 15 * scores["keyboard"])
    scores["osa"] = rate(distances(True))
    known = 20 * scores["levenshtein"].astype(np.int64) + 15 * scores["keyboard"] + 15 * scores["prefix"] + 25 * scores["osa"]
    narrow(known + 25 * winkler[kept])
    scores["jaro_winkler"] = jaro_winkler_similarities(*pair())
    scores["combined"] = sum(scores[k].astype(np.int64) * w for k, w in WEIGHTS.items()) // 100
    narrow(100 * scores["combined"])
    return kept, scores


#: Pairs that are scored in one go.
PAIRS_AT_ONCE = 20_000
_FOUND = "package_id long, similar_id long, name string, similar_name string, combined int, " + ", ".join(f"{k} int" for k in WEIGHTS)


def lookalikes(packages: DataFrame, top: int = 10_000, min_score: int = 75, task_names: int = 1_000) -> DataFrame:
    """Pairs of a package (id, name, downloads) with one of the ``top`` most downloaded whose names are alike.

    Both in the top: only the pair that starts at the less downloaded one. The targets are a query set of bounded size (``top`` names,
    some 300 KB at 10,000); every task holds its own names against them in blocks, so only the names are shuffled, and only pairs that a bound
    from lengths, common characters and the common prefix lets through are scored.
    """
    named = packages.filter("name IS NOT NULL").select(F.col("id").cast("long"), "name", F.col("downloads").cast("long"))
    table = named.orderBy(F.desc("downloads"), "id").limit(top).toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = Targets(table)
        known = np.sort(targets.ids)
        for batch in (b.slice(k, task_names) for b in batches for k in range(0, len(b), task_names)):
            names = Names(batch, targets.alphabet)
            in_top = np.isin(names.ids, known)
            held: list[tuple[np.ndarray, ...]] = []
            pairs = 0
            for i in range(len(batch)):
                near, *known_of = targets.near(names, i, min_score)
                other = (targets.ids[near] != names.ids[i]) & (targets.names[near] != names.names[i])
                if in_top[i]:
                    other &= targets.downloads[near] > names.downloads[i]
                near, *known_of = (c[other] for c in (near, *known_of))
                held.append((np.full(len(near), i), near, *known_of))
                pairs += len(near)
                if pairs >= PAIRS_AT_ONCE or i == len(batch) - 1:
                    x, y, winkler, lead = (np.concatenate(c) for c in zip(*held, strict=True))
                    held, pairs = [], 0
                    kept, scores = _scored(names, targets, x, y, winkler, lead, min_score)
                    x, y = x[kept], y[kept]
                    columns = [pa.array(names.ids[x]), pa.array(targets.ids[y]), pa.array(names.names[x], pa.string()), pa.array(targets.names[y], pa.string())]
                    columns += [pa.array(scores[k].astype(np.int32)) for k in ("combined", *WEIGHTS)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])

    # The work is in the comparisons, not in the bytes: tasks of ``task_names`` names, however few bytes those are.
    return named.repartition(max(1, math.ceil(named.count() / task_names))).mapInArrow(run, _FOUND)
