"""N-gram Jaccard join with token-combination prefixes (operator 6).

A text's set holds the 64-bit hashes of its distinct five-word shingles; two texts link when their sets' Jaccard similarity is
at least 3/4. Sets are equal when 128 bits of them and their sizes agree. Up to those hashes the join is exact:

1. Frequencies. One pass shingles all texts; shards of the hash range count in how many texts each shingle occurs, and tell
   each text which of its shingles others have too (``_repeated``). A set with more than a quarter of its shingles to itself
   has no partner and goes no further. Equal sets are one entity from there on, so exact copies are never compared.
2. Order. Shingles are ordered by frequency, then hash. Those of one entity alone come first and take up places in its prefix.
3. Signatures. Partners of sizes n and m share at least t = ceil(3(n+m)/7) shingles, so the first that they share stands at a
   place of at most n-t in one and m-t in the other. If it is rare, it alone is a signature. If it is frequent, all that they
   share are: these fall into g subclasses, the prefix is extended by g, partners then share g+1 of them in their prefixes,
   so two in one subclass, and the pairs of a subclass are the signatures. g follows the set's size class (a power of two);
   a set whose partners may be in the next size class emits that one's signatures as well. Signatures grow in proportion to n.
   The place gives each signature ``high``, the largest partner that it can still stand for.
4. Verification without all pairs of a group: in each signature's group one pivot, the set with the fewest shingles of its own,
   is compared with the others that sizes and places allow. Links merge components; groups inside one component are done. After
   ``pivots`` rounds, what stands outside the main component of its group is compared with what sizes and places still allow
   there. A pair that links is either compared or already in one component, so no link is lost.

Edge cases: null, empty and wordless texts have the empty set and link with nothing; texts under five words have one shingle,
the whole sequence; repeated rows are equal sets; null ids never name a component unless all its ids are null; other columns
are ignored; ties of frequency go by the shingle's hash; an empty table gives no rows. A text is read whole, in some 100 bytes of a
worker's memory for each of its own: one of 10 MB takes a GB. ``docs`` must come from files or a checkpoint (a task that runs again must see the same rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._repeated import Extracted, with_repeats
from riskloom.llm._shared import Scratch, cut, sweep
from riskloom.llm._text import Words, mix64, slices, texts_of
from riskloom.llm.components import components

SHINGLE = 5
#: A shingle in at least so many texts is of the frequent class. Places prune the groups of single shingles better than those of
#: combinations, and pivots keep groups of any size linear, so combinations are for groups that are large even for that.
FREQUENT = 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets)
    h, first = words.hash, words.first
    n = len(h)
    s = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        s = mix64(s * np.uint64(3) + h[k : k + len(s)] + _STEP)
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            own = np.sort(s[a : b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix64(x * np.uint64(3) + h[k] + _STEP)
            out.append(x)
        else:
            out.append(h[:0])
    return out


def _identities(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each set, from sums over its elements; ``keys`` holds the sets one after the other."""
    out = [np.zeros(len(n), np.uint64) for _ in range(2)]
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        for x, salt in zip(out, (_STEP, _OTHER), strict=True):
            mixed = mix64(keys * salt + salt)
            folded = np.add.reduceat(mixed, at) + np.bitwise_xor.reduceat(mixed, at) * np.uint64(31)
            x[some] = mix64(folded + n[some].astype(np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


# --- which shingles are shared, and by how many ----------------------------------------------------

_MEMBER = "doc_id long, text_hash long, e1 long, e2 long, n int, shingles array<long>, often array<int>"


def _extract(batch: pa.RecordBatch) -> Iterator[Extracted]:
    data, offsets = texts_of(batch.column("text"))
    for i, j in slices(offsets):
        sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate(sets)
        e1, e2 = _identities(keys, n)
        info = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")] + [pa.array(e1), pa.array(e2), pa.array(n.astype(np.int32))]
        yield keys, [np.repeat(np.arange(j - i, dtype=np.uint32), n)], pa.RecordBatch.from_arrays(info, names=["doc_id", "text_hash", "e1", "e2", "n"])


def _members(info: pa.Table, keys: np.ndarray, often: np.ndarray, owners: list[np.ndarray]) -> pa.Table:
    """A row per text; those with enough shared shingles for some partner carry them, equal sets of the chunk once."""
    row = owners[0]
    n = info["n"].to_numpy().astype(np.int64)
    shared = np.bincount(row, minlength=len(n))
    wanted = (4 * shared >= 3 * n) & (n > 0)
    at = np.flatnonzero(wanted)
    same = np.column_stack([info[c].to_numpy()[at] for c in ("e1", "e2")])
    wanted[:] = False
    wanted[at[np.unique(same, axis=0, return_index=True)[1]]] = True
    order = np.argsort(row, kind="stable")
    order = order[wanted[row[order]]]
    edges = pa.array(np.concatenate([[0], np.cumsum(np.where(wanted, shared, 0))]).astype(np.int32))
    often = np.minimum(often, (1 << 31) - 1).astype(np.int32)
    lists = [pa.ListArray.from_arrays(edges, pa.array(x[order]), mask=pa.array(~wanted)) for x in (keys.view(np.int64), often)]
    return info.append_column("shingles", lists[0]).append_column("often", lists[1])


# --- signatures ----------------------------------------------------------------------------------


def _subclasses(size_class: int) -> int:
    return max(1, (1 << size_class) // 16)


def signatures(s: np.ndarray, often: np.ndarray, n: int, alone: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, high) of a set of ``n`` shingles, ``alone`` of which no other set has; ``s`` are the others in their order,
    ``often`` their frequencies. ``high``: the largest partner that the signature can stand for."""
    most = 4 * n // 3
    base = n - -(-3 * n // 4) + 1 - alone  # places that the prefix leaves for shared ones
    if base <= 0 or n < 2:  # a partner of a one-shingle set is equal to it
        return s[:0], np.zeros(0, np.int64)
    rare = int(np.searchsorted(often[:base], frequent))
    reach = lambda place: np.minimum(most, (4 * n - 7 * place) // 3)
    found, high = [mix64(s[:rare])], [reach(alone + np.arange(rare))]
    if rare < min(base, len(s)):
        for size_class in {n.bit_length() - 1, most.bit_length() - 1}:
            g = _subclasses(size_class)
            wide = s[rare : base + g]
            kind = mix64(wide + np.uint64(7)) % np.uint64(g)
            order = np.argsort(kind, kind="stable")
            wide, kind = wide[order], kind[order]
            for step in range(1, len(wide)):  # pairs at distance `step` in the same subclass
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                x, y = wide[step:][same], wide[:-step][same]
                later = alone + rare + order[step:][same]  # the order inside a subclass is that of places
                found.append(mix64(mix64(np.minimum(x, y) + np.uint64(size_class + 100)) * np.uint64(3) + np.maximum(x, y)))
                high.append(reach(later - g))
    return np.concatenate(found), np.concatenate(high)


def _index(sets: DataFrame, frequent: int) -> DataFrame:
    """(sig, id, n, high, own): a row per signature; ``own`` is the share of shingles that no other set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, alone = (batch.column(c).to_numpy() for c in ("id", "n", "alone"))
            shingles, often = batch.column("shingles"), batch.column("often")
            got = [
                signatures(shingles[i].values.to_numpy().view(np.uint64), often[i].values.to_numpy(), int(n[i]), int(alone[i]), frequent)
                for i in range(len(batch))
            ]
            many = [len(sig) for sig, _ in got]
            if sum(many):
                sig, high = (np.concatenate(x) for x in zip(*got, strict=True))
                keep = 4 * high >= 3 * np.repeat(n, many)
                own = np.repeat(alone / n, many)
                columns = [sig.view(np.int64), np.repeat(ids, many), np.repeat(n, many).astype(np.int32), high.astype(np.int32), own.astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=["sig", "id", "n", "high", "own"])

    return sets.mapInArrow(run, "sig long, id long, n int, high int, own float")


# --- the join ------------------------------------------------------------------------------------

FEW_PAIRS = 200_000  # ids of so many pairs (3 MB) may be broadcast


def _fits(a: str, b: str) -> Column:
    """Sizes and places allow that the two rows of a signature link."""
    return (F.col(f"{a}.n") <= F.col(f"{b}.high")) & (F.col(f"{b}.n") <= F.col(f"{a}.high"))


def _pairs(found: DataFrame) -> DataFrame:
    a, b = F.col("p.id"), F.col("e.id")
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have 100 * intersection >= 75 * union. Shingles that no other set has don't count."""
    if pairs.count() <= FEW_PAIRS:  # then only their sets are moved
        ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("_i", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("_i") >= 75 * (F.col("na") + F.col("nb") - F.col("_i"))).select("a", "b")


def _star(index: DataFrame, turn: int) -> DataFrame:
    """Pairs of each group's pivot with the others that fit."""
    order = F.col("own") if not turn else F.xxhash64("id", F.lit(turn))
    row = F.struct("id", "n", "high", *(["comp"] if turn else []))
    pivots = index.groupBy("sig").agg(F.min(F.struct(order.alias("o"), row.alias("r"))).alias("p"), F.count("*").alias("many"))
    pivots = pivots.filter("many > 1").select("sig", F.col("p.r").alias("p"))
    apart = F.col("p.comp") != F.col("e.comp") if turn else F.col("p.id") != F.col("e.id")
    return _pairs(index.select("sig", row.alias("e")).join(pivots, "sig").filter(apart & _fits("p", "e")))


def _outside(index: DataFrame) -> DataFrame:
    """Pairs of rows outside their group's main component with rows of other components that fit."""
    row = F.struct("id", "n", "high", "comp")
    main = index.groupBy("sig", "comp").count().groupBy("sig").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    few = index.join(main, "sig").filter("comp <> main").select("sig", row.alias("p"))
    return _pairs(few.join(index.select("sig", row.alias("e")), "sig").filter((F.col("p.comp") != F.col("e.comp")) & _fits("p", "e")))


def _components(sets: DataFrame, pivots: int, frequent: int, scratch: Scratch) -> DataFrame | None:
    """(id, comp) of the sets that link with others; None if none does."""
    index = scratch.keep(_index(sets, frequent), "signatures")
    links = label = None
    for turn in range(pivots + 1):
        if label is None:
            alive = index.withColumn("comp", F.col("id"))
        else:
            alive = index.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
            ends = alive.groupBy("sig").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a <> _b").select("sig")
            alive = scratch.keep(alive.join(ends, "sig").select("sig", "id", "n", "high", "own", "comp"), "alive")
            if alive.isEmpty():
                break
        pairs = scratch.keep(_star(alive, turn) if turn < pivots else _outside(alive), "pairs")
        new = scratch.keep(_linked(pairs, sets), "links")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        label = components(links, scratch)
    return label


def link_components(docs: DataFrame, pivots: int = 2, frequent: int = FREQUENT, **sizes) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    with Scratch(spark) as scratch:
        members = scratch.keep(with_repeats(rows, _extract, _members, _MEMBER, **sizes), "members")
        sweep(spark)
        same = members.filter("n > 0").groupBy("e1", "e2", "n")
        entities = same.agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"),
            F.first("shingles", True).alias("shingles"), F.first("often", True).alias("often"),
        )
        entities = scratch.keep(entities.withColumn("id", F.monotonically_increasing_id()), "entities")
        narrow = scratch.keep(members.select("doc_id", "text_hash", "e1", "e2", "n"), "members")
        scratch.drop(members)
        # What is in more texts than the set's own copies, in the order of frequency, then hash.
        both = F.arrays_zip("often", "shingles")
        shared = F.array_sort(F.filter(both, lambda x: x["often"] > F.col("copies")))
        sets = entities.filter("shingles IS NOT NULL").withColumn("_s", shared).filter("4 * size(_s) >= 3 * n")
        sets = sets.select("id", "n", (F.col("n") - F.size("_s")).alias("alone"), F.col("_s.shingles").alias("shingles"), F.col("_s.often").alias("often"))
        sets = scratch.keep(sets, "sets")
        label = _components(sets, pivots, frequent, scratch)
        own = entities.select("e1", "e2", "n", "id", "first_doc")
        if label is None:
            placed = own.withColumnRenamed("first_doc", "component_id")
        else:
            own = own.join(label, own["id"] == label["node"], "left").withColumn("comp", F.coalesce("component", "id"))
            smallest = own.filter("component IS NOT NULL").groupBy("comp").agg(F.min("first_doc").alias("least"))
            placed = own.join(smallest, "comp", "left").withColumn("component_id", F.coalesce("least", "first_doc"))
        found = narrow.join(placed.select("e1", "e2", "n", "component_id"), ["e1", "e2", "n"], "left")
        return cut(found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, and of repeated rows of it (equal text) one. Rows without
    words stay; null ids go where their component has another."""
    found = link_components(docs, **options).filter("n_shingles > 0")
    key = ["doc_id", "text_hash"]
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key).distinct()
    twice = found.groupBy(*key).count().filter("count > 1").select(*key)
    own = lambda other: (docs["doc_id"].cast("long").eqNullSafe(other["doc_id"])) & (F.xxhash64(docs["text"]) == other["text_hash"])
    left = docs.join(gone, own(gone), "left_anti")
    twice = cut(twice.join(gone, key, "left_anti"))
    if twice.isEmpty():
        return left
    return left.join(twice, own(twice), "left_anti").unionByName(left.join(twice, own(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
