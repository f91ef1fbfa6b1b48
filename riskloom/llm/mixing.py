"""Mixing sources to target weights (operator 3), with DataFrame functions only.

1. Sizes: words per document; a document falls into blocks of ``block_words`` consecutive words.
2. Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the total; a
   target stops at ``max_passes`` times its source's size and the excess goes to the others by weight.
   This is one water level: sources sorted by cap/weight, and the first whose share at the level of
   the remaining ones stays under its cap sets it.
3. Draws: a source's blocks stand in a pseudo-random order (a hash of content and seed). Whole passes
   take every block; the last pass takes blocks from the front of that order until the target is met,
   cutting the last one to the word, so no two draws of a pass share a word and each source meets its
   target to within half a word. Places in the order come from counts per hash bucket plus a row
   number in the bucket, so a source of any size is never ordered in one task.
4. Shards: the sources' block quotas are split down a binary tree. At each node the left child's
   quotas are a multivariate hypergeometric draw (conditional univariate draws, inverted from the
   mode), exactly as if all draws had been shuffled and dealt. A shard then takes its count of the
   next draws of each source, and is shuffled by its own hash.

The windows over sources run in one task, and one row holds an array of their quotas: sources are few (thousands at most).

Edge cases: null or wordless texts have size 0 and are never drawn (``materialise`` passes them on unchanged); a null source is a
source of its own; repeated rows (equal id, text and source) are kept apart by number; an empty table gives an empty
mix; other columns are ignored by ``draw`` and carried along by ``materialise``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch, cut

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["_doc", "_hash", "_copy"]


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn("_hash", F.xxhash64("text", "source"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a key that any rerun finds again: id, hash of content, and a number for fully equal rows."""
    return rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy("_hash")))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def targets(sources: DataFrame, max_passes: int = 3) -> DataFrame:
    """(source, source_size, blocks) with ``target``: the water-filling of step 2. One row per source."""
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_level", F.col("source").asc_nulls_last())
    rows = sources.withColumn("_weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    rows = rows.withColumn("_cap", F.lit(float(max_passes)) * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_weight"))
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_share", left / F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    met = F.min(F.when(F.col("_share") <= F.col("_level"), F.struct("_level", "_share"))).over(Window.partitionBy())
    return rows.withColumn("target", F.least("_cap", F.coalesce(met["_share"], F.lit(0.0)) * F.col("_weight"))).drop("_weight", "_cap", "_level", "_share")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once and its expression written once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """How many of ``draws`` from ``total`` hit the ``good`` ones, by inversion of ``u`` in the order mode, mode+1, ..., mode-1, ...

    Steps stop 9 standard deviations (and 24 more) from the mode; the mass beyond is under 1e-15.
    """

    def grow(p: Column, k: Column) -> Column:  # p(k+1) / p(k)
        return (p["good"] - k) * (p["draws"] - k) / ((k + 1) * (p["total"] - p["good"] - p["draws"] + k + 1))

    def shrink(p: Column, k: Column) -> Column:  # p(k-1) / p(k)
        return k * (p["total"] - p["good"] - p["draws"] + k) / ((p["good"] - k + 1) * (p["draws"] - k + 1))

    def steps(n: Column) -> Column:
        return F.slice(F.sequence(F.lit(0), n.cast("int")), F.lit(2), n.cast("int"))

    def side(p: Column, n: Column, ratio, sign: int) -> Column:
        """The mass of n steps away from the mode, in units of the mode's."""
        state = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))

        def step(a: Column, i: Column) -> Column:
            w = a["w"] * ratio(p, p["mode"] + sign * (i - 1))
            return F.struct(w.alias("w"), (a["s"] + w).alias("s"))

        return F.aggregate(steps(n), state, step)["s"]

    def picked(p: Column, n: Column, ratio, sign: int, rest: Column) -> Column:
        """Steps away from the mode until the mass ``rest`` is used up."""
        state = F.struct(F.lit(1.0).alias("w"), rest.alias("r"), F.lit(0).alias("k"))

        def step(a: Column, i: Column) -> Column:
            w = a["w"] * ratio(p, p["mode"] + sign * (i - 1))
            return F.struct(w.alias("w"), (a["r"] - w).alias("r"), (a["k"] + (a["r"] >= 0).cast("int")).alias("k"))

        return F.aggregate(steps(n), state, step)["k"]

    def settle(p: Column) -> Column:
        above, below = side(p, p["up"], grow, 1), side(p, p["down"], shrink, -1)

        def choose(m: Column) -> Column:
            at = p["u"] * (1 + m["above"] + m["below"])
            high = picked(p, p["up"], grow, 1, at - 1)
            low = picked(p, p["down"], shrink, -1, at - 1 - m["above"])
            return F.when(at < 1, p["mode"]).when(at < 1 + m["above"], p["mode"] + high).otherwise(p["mode"] - low)

        return _let(F.struct(above.alias("above"), below.alias("below")), choose)

    def placed(p: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), p["draws"] + p["good"] - p["total"]), F.least(p["good"], p["draws"])
        mode = F.greatest(low, F.least(high, F.floor((p["draws"] + 1) * (p["good"] + 1) / (p["total"] + 2)).cast("double")))
        part = p["good"] / F.greatest(p["total"], F.lit(1.0))
        reach = F.ceil(9 * F.sqrt(p["draws"] * part * (1 - part)) + 24).cast("double")
        own = [p[x].alias(x) for x in ("u", "good", "total", "draws")]
        return _let(F.struct(*own, mode.alias("mode"), reach.alias("reach"), low.alias("low"), high.alias("high")), lambda q: _let(F.struct(*[q[x].alias(x) for x in ("u", "good", "total", "draws", "mode")], F.least(q["high"] - q["mode"], q["reach"]).alias("up"), F.least(q["mode"] - q["low"], q["reach"]).alias("down")), settle))

    drawn = _let(F.struct(u.alias("u"), good.cast("double").alias("good"), total.cast("double").alias("total"), draws.cast("double").alias("draws")), placed)
    return F.when((draws <= 0) | (good <= 0), 0).when(good >= total, draws).otherwise(drawn).cast("long")


def splitting_tree(quotas: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """(shard, taken: array in the order of ``quotas.quota``) from one row with ``quota``: array<long>. ``shards`` is a power of two."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "quota")
    for level in range(int(math.log2(shards))):
        if level and level % 3 == 0:  # subtrees go on side by side, and the plan stays short
            nodes = scratch.keep(nodes.repartition(min(1 << level, 1024), "node"))
        state = F.struct(total(F.col("quota")).alias("n"), F.floor(total(F.col("quota")) / 2).cast("long").alias("d"), F.array().cast("array<bigint>").alias("out"))

        def deal(a: Column, x: Column) -> Column:
            hit = hypergeometric(_uniform(F.lit(seed), F.col("node"), F.size(a["out"])), x, a["n"], a["d"])
            return F.struct((a["n"] - x).alias("n"), (a["d"] - hit).alias("d"), F.concat(a["out"], F.array(hit)).alias("out"))

        # The draw is read through an explode, so it is made once for both children.
        split = nodes.select("node", "quota", F.explode(F.array(F.aggregate("quota", state, deal)["out"])).alias("left"))
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quota", "left", lambda a, b: a - b).alias("quota")),
        )
        nodes = split.select(F.explode(both).alias("x")).select("x.node", "x.quota")
    return nodes.select((F.col("node") - shards).alias("shard"), F.col("quota").alias("taken"))


def draw(docs: DataFrame, scratch: Scratch, block_words: int = 512, max_passes: int = 3, shard_blocks: int = 16_384, bucket_blocks: int = 4_000, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sized, draws).

    ``sized``: a row per document with its key, doc_id, source, size, source_size, target. ``draws``: a row per drawn
    block with the document's key, source, ``pass``, ``first_word``, ``words``, ``shard`` and ``place`` (sort key in the shard).
    """
    spark = docs.sparkSession
    sized = scratch.keep(_numbered(_hashed(docs).select("_doc", "_hash", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))))
    n_blocks = F.ceil(F.col("size") / block_words).cast("long")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(n_blocks).alias("source_blocks"))
    plan = targets(sources, max_passes).withColumn("_want", F.floor(F.col("target") + 0.5).cast("long"))
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_want") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    plan = scratch.keep(plan.withColumn("_part", F.col("_want") - F.col("_whole") * F.col("source_size")))
    blocks_in_all = plan.agg(F.coalesce(F.sum("source_blocks"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(blocks_in_all / bucket_blocks))

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    blocks = sized.filter("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    blocks = blocks.select(*KEY, "source", (F.col("block") * block_words).alias("first_word"), F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).alias("words"))
    blocks = blocks.withColumn("_order", F.xxhash64(F.lit(seed), *KEY, "first_word")).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_order", 24), F.lit(buckets)))
    # Places in a source's order: what lies in earlier buckets, then the place in the own bucket.
    per_bucket = blocks.groupBy("source", "_bucket").agg(F.count("*").alias("_n"), F.sum("words").alias("_w"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("source", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", *KEY, "first_word")
    placed = blocks.withColumn("_n", F.row_number().over(inside) - 1).withColumn("_w", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    placed = placed.join(before, same(placed, before) & (placed["_bucket"] == before["_bucket"])).select(*KEY, placed["source"], "first_word", "words", (F.col("_n0") + F.col("_n")).alias("_rank"), (F.col("_w0") + F.col("_w")).alias("_start"))
    want = plan.select("source", "source_blocks", "_whole", "_part")
    drawn = placed.join(want, same(placed, want)).select(*KEY, placed["source"], "first_word", "words", "_rank", "_start", "source_blocks", "_whole", "_part")
    last = F.greatest(F.lit(0).cast("long"), F.least("words", F.col("_part") - F.col("_start")))
    passes = F.col("_whole") + (last > 0).cast("long")
    drawn = drawn.filter(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    drawn = scratch.keep(drawn.select(*KEY, "source", "first_word", F.when(F.col("pass") < F.col("_whole"), F.col("words")).otherwise(last).alias("words"), "pass", (F.col("pass") * F.col("source_blocks") + F.col("_rank")).alias("_draw")))

    quotas = drawn.groupBy("source").agg(F.count("*").alias("n"))
    total = quotas.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = 1 << max(0, math.ceil(math.log2(max(1, total / shard_blocks))))
    row = quotas.agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("q")).select(F.col("q.n").alias("quota"), F.col("q.source").alias("names"))
    tree = splitting_tree(row, shards, seed, scratch).crossJoin(row.select("names")).select("shard", F.explode(F.arrays_zip("names", "taken")).alias("x")).select("shard", F.col("x.names").alias("source"), F.col("x.taken").alias("taken"))
    upto = Window.partitionBy("source").orderBy("shard")
    leaves = scratch.keep(tree.withColumn("_to", F.sum("taken").over(upto)).withColumn("_from", F.col("_to") - F.col("taken")).filter("taken > 0"))
    granule = 4096  # draws of a source meet the leaves over the same stretch of 4,096 draws: an equi-join
    leaves = leaves.withColumn("_granule", F.explode(F.sequence(F.floor(F.col("_from") / granule), F.floor((F.col("_to") - 1) / granule))))
    drawn = drawn.withColumn("_granule", F.floor(F.col("_draw") / granule))
    dealt = drawn.join(leaves, same(drawn, leaves) & (drawn["_granule"] == leaves["_granule"]) & (drawn["_draw"] >= leaves["_from"]) & (drawn["_draw"] < leaves["_to"]))
    draws = dealt.select(*KEY, drawn["source"], "pass", "first_word", "words", "shard", F.xxhash64(F.lit(seed + 1), "shard", drawn["source"], "_draw").alias("place"))
    sizes = plan.select("source", "source_size", "target")
    sized = sized.join(sizes, same(sized, sizes), "left").select(*KEY, "doc_id", sized["source"], "size", "source_size", "target")
    return sized, draws


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards: what the mix takes of each document."""
    with Scratch(docs.sparkSession) as scratch:
        sized, draws = draw(docs, scratch, **options)
        taken = draws.groupBy(*KEY).agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"))
        zero = F.lit(0).cast("long")
        columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("n_shards", zero).alias("n_shards")]
        return cut(sized.join(taken, KEY, "left").select(*columns))


def materialise(docs: DataFrame, keep_wordless: bool = True, **options) -> DataFrame:
    """The mix as documents: a row per document and pass with the words taken (their white space kept), all columns of
    ``docs``, and ``mix_shard`` (of the first block) with ``mix_place`` to sort it by.

    Documents without words have nothing to draw; ``keep_wordless`` passes them on once, unchanged, with null places. Texts are
    shuffled once, to meet what is taken of them; only rows that are equal in id, text and source move once more, to be numbered.
    """
    with Scratch(docs.sparkSession) as scratch:
        sized, draws = draw(docs, scratch, **options)
        repeated = cut(sized.filter("_copy > 1").select("_doc", "_hash").distinct())
        runs = F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("_runs")
        runs = draws.groupBy(*KEY, "pass").agg(runs, F.min(F.struct("shard", "place")).alias("_at"), F.sum("words").alias("_taken"))
        runs = cut(runs.drop("pass"))
    carried = [c for c in docs.columns if c not in ("text", "mix_shard", "mix_place")]
    # The input's own columns travel in a struct, whatever their names are.
    rows = _hashed(docs.select(F.struct(*carried).alias("_row"), "doc_id", "text", "source"))
    if repeated.isEmpty():
        met = rows.join(runs.drop("_copy"), ["_doc", "_hash"])
    else:
        once = runs.join(repeated, ["_doc", "_hash"], "left_anti").drop("_copy")
        many = _numbered(rows.join(repeated, ["_doc", "_hash"], "left_semi")).join(runs, KEY).drop("_copy")
        met = rows.join(once, ["_doc", "_hash"]).unionByName(many)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))

    def run(r: Column) -> Column:
        return F.slice(F.col("_words"), (r["first_word"] + 1).cast("int"), r["words"].cast("int"))

    chosen = F.array_join(F.flatten(F.transform("_runs", run)), "")
    met = met.withColumn("_words", words).withColumn("text", F.when(F.col("_taken") == F.size("_words"), F.col("text")).otherwise(chosen))
    kept = [F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("mix_shard", "mix_place")]
    mixed = met.select(*kept, F.col("_at.shard").alias("mix_shard"), F.col("_at.place").alias("mix_place"))
    if not keep_wordless:
        return mixed
    bare = docs.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).drop("mix_shard", "mix_place")
    return mixed.unionByName(bare.withColumns({c: F.lit(None).cast("long") for c in ("mix_shard", "mix_place")}))
