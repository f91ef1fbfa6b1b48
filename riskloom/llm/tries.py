"""Conversation prefix trie by prefix-doubling naming (operator 11).

``rebuilt`` conversations share heads; each distinct sequence of the first d turns is a node. No sequence is ever put together:

1. Turns get places by distributed numbering (``numbering``), so a conversation of any length is dealt over many tasks. Distinct
   (role, text) pairs, known by SHA-256, get dense names 1, 2, ...
2. Blocks. In round k every aligned block of 2**(k+1) turns is a pair of names of its halves, and distinct pairs get dense names
   again: equal names, equal turns. Rounds are logarithmic in the longest conversation, and block tables halve in size.
3. Prefixes. The first d turns are the blocks of d's binary digits. A prefix whose lowest digit is 2**k is the prefix without that
   digit and one block of that size; from the largest size down each prefix is named once, as a distinct (depth, name, block).
4. Nodes are groups of (depth, name). Members of a deeper prefix are among those of a shallower, so the smallest member of a node
   is that of a stretch of nodes below it too: nodes fall into one chain per smallest member. Sums over subtrees are sums over
   chains (each added up in stretches) and over the tree of chains (by doubling: rounds logarithmic in its depth).

Edge cases: a null role or text is empty; turns are ordered by turn (null first), equal turns by role, then by the first 256
characters of the text, then by the SHA-256 of role and text; repeated rows are turns of their own; rows with a null conv_id belong
to no conversation; negative ids: ``c - c % 100`` with SQL's remainder, of the sign of c; very long texts only count by their
digest and length; an empty table has no conversation and no node; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch, cut
from riskloom.operators.numbering import dense_names, numbered

STRIDE, HEADS = 100, 6
#: Nodes of a chain that one window adds up.
STRETCH = 4_096


def _kept(scratch: Scratch, purpose: str):
    return lambda df: scratch.keep(df, purpose)


def turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, digest, chars): the original turns, places from 0; a table of ``scratch``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 256).alias("head"),
        digest.alias("digest"), F.char_length(text).cast("long").alias("chars"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("digest")]
    placed = numbered(rows, order, _kept(scratch, "turns"), "at").select("conv_id", "at", "digest", "chars")
    start = placed.groupBy("conv_id").agg(F.min("at").alias("start"))
    return scratch.keep(placed.join(start, "conv_id").select("conv_id", (F.col("at") - F.col("start")).alias("place"), "digest", "chars"), "places")


def rebuilt(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, digest, chars) of the rebuilt conversations, and all (conv_id, turns); tables of ``scratch``.

    Only the first five turns of every hundredth conversation are looked up, by at most a hundred others each."""
    base = F.col("conv_id") - F.col("conv_id") % STRIDE
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.alias("base"), h.alias("h"))
    convs = scratch.keep(convs, "conversations")
    heads = own.filter((F.col("place") < HEADS - 1) & (F.col("conv_id") % STRIDE == 0)).withColumnRenamed("conv_id", "base")
    lent = F.least(F.col("h"), F.coalesce("m", F.lit(0)))
    there = own.filter(F.col("conv_id") % STRIDE == 0).groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("m"))
    convs = convs.join(there, "base", "left").select("conv_id", "base", "h", "n", lent.alias("lent"))
    convs = scratch.keep(convs, "conversations")
    front = convs.join(heads, "base").filter("place < lent").select("conv_id", "place", "digest", "chars")
    back = own.join(convs.select("conv_id", "h", "lent"), "conv_id").filter("place >= h")
    back = back.select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "digest", "chars")
    length = convs.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
    return scratch.keep(front.unionByName(back), "rebuilt"), length


def _renamed(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with the dense name of their key in place of it."""
    names = dense_names(rows.select(*key), _kept(scratch, "names"))
    return rows.join(names, key).drop(*key)


def prefixes(sequence: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, name): of all prefixes of sequences (conv_id, place, digest); equal name at equal depth: equal turns."""
    blocks = [scratch.keep(_renamed(sequence.select("conv_id", F.col("place").alias("i"), "digest"), ["digest"], scratch), "block")]
    while True:
        even = F.col("i") % 2 == 0
        half = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i"))
        pairs = half.agg(F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right")).filter("right IS NOT NULL")
        pairs = scratch.keep(pairs, "pairs")
        if pairs.isEmpty():
            break
        blocks.append(scratch.keep(_renamed(pairs, ["left", "right"], scratch), "block"))
    done = None
    for k in range(len(blocks) - 1, -1, -1):
        last = blocks[k].filter("i % 2 = 0").select("conv_id", ((F.col("i") + 1) * (1 << k)).alias("depth"), F.col("name").alias("block"))
        first = last.filter(F.col("depth") == 1 << k).select("conv_id", "depth", F.col("block").alias("name"))
        if done is None:
            done = first
            continue
        longer = last.filter(F.col("depth") > 1 << k).withColumn("_before", F.col("depth") - (1 << k))
        front = done.select("conv_id", F.col("depth").alias("_before"), F.col("name").alias("front"))
        longer = scratch.keep(longer.join(front, ["conv_id", "_before"]).drop("_before"), "longer")
        named = _renamed(longer.withColumn("_d", F.col("depth")), ["_d", "front", "block"], scratch)
        done = done.unionByName(first).unionByName(scratch.keep(named.select("conv_id", "depth", "name"), "prefixes"))
    return done


def nodes(sequence: DataFrame, length: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(depth, name, conv_id, n_convs, chars, parent, n_children) and the members (conv_id, depth, name) of full length. The root's name is 0."""
    root = length.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))
    named = scratch.keep(prefixes(sequence, scratch).unionByName(root), "named")
    chars = sequence.select("conv_id", (F.col("place") + 1).alias("depth"), "chars")
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    rows = named.join(above, ["conv_id", "depth"], "left").join(chars, ["conv_id", "depth"], "left")
    of = rows.groupBy("depth", "name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.coalesce(F.max("chars"), F.lit(0)).alias("chars"),
    )
    table = scratch.keep(of, "nodes")
    below = table.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    table = table.join(below, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    up = table.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    table = scratch.keep(table.join(up, ["depth", "parent"], "left"), "nodes")
    full = named.join(length.withColumnRenamed("turns", "depth"), ["conv_id", "depth"])
    return table, full


SUMS = ("n_leaves", "saved_tokens")


def _chain_totals(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, sums) over each chain and all that hang below it, of chains (conv_id, above, sums). Doubling: in round k a chain adds
    what the chains 2**k steps below it hold, which is all that is up to 2**(k+1) - 1 steps below."""
    table = scratch.keep(chains.select("conv_id", "above", *SUMS), "chains")
    while not table.filter("above IS NOT NULL").isEmpty():
        below = table.filter("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(*[F.sum(c).alias(f"_{c}") for c in SUMS])
        higher = table.select(F.col("conv_id").alias("above"), F.col("above").alias("_above"))
        step = table.join(below, "conv_id", "left").join(higher, "above", "left")
        step = step.select("conv_id", F.col("_above").alias("above"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS])
        table = scratch.keep(step, "chains")
    return table.select("conv_id", *SUMS)


def _sums_below(values: DataFrame, scratch: Scratch) -> DataFrame:
    """``values`` with the sums over their chain from each depth down, in stretches of ``STRETCH`` nodes."""
    values = values.withColumn("_s", F.floor(F.col("depth") / STRETCH))
    parts = values.groupBy("conv_id", "_s").agg(*[F.sum(c).alias(f"_p_{c}") for c in SUMS])
    later = Window.partitionBy("conv_id").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    after = parts.select("conv_id", "_s", *[F.coalesce(F.sum(f"_p_{c}").over(later), F.lit(0)).alias(f"_p_{c}") for c in SUMS])
    inside = Window.partitionBy("conv_id", "_s").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = values.select("conv_id", "_s", "depth", *[F.sum(c).over(inside).alias(c) for c in SUMS])
    return summed.join(after, ["conv_id", "_s"]).select("conv_id", "depth", *[(F.col(c) + F.col(f"_p_{c}")).cast("long").alias(c) for c in SUMS])


def subtree_sums(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of each node's subtree; a node is known by its smallest member and depth."""
    own = table.select(
        "conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    own = scratch.keep(own, "values")
    top = F.min_by("parent_conv_id", "depth")
    chains = own.groupBy("conv_id").agg(top.alias("above"), (F.min("depth") - 1).alias("hangs"), *[F.sum(c).alias(c) for c in SUMS])
    chains = scratch.keep(chains, "chains")
    total = _chain_totals(chains, scratch)
    hung = chains.filter("above IS NOT NULL").select("conv_id", "above", "hangs").join(total, "conv_id")
    hung = hung.groupBy(F.col("above").alias("conv_id"), F.col("hangs").alias("depth")).agg(*[F.sum(c).alias(f"_{c}") for c in SUMS])
    values = own.join(hung, ["conv_id", "depth"], "left").select("conv_id", "depth", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS])
    return _sums_below(values, scratch)


def end_hashes(full: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256): of each node where conversations end. Ids arrive in order and go into the digest as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def closed(found):
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names=["depth", "name", "ends_sha256"])

        for batch in batches:
            found = []
            for depth, name, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "conv_id")), strict=True):
                if (depth, name) == node:
                    digest.update(b",%d" % conv)
                else:
                    if node is not None:
                        found.append((*node, digest.hexdigest()))
                    node, digest = (depth, name), hashlib.sha256(b"%d" % conv)
            yield closed(found)
        if node is not None:
            yield closed([(*node, digest.hexdigest())])

    rows = full.select("depth", "name", "conv_id").repartition("depth", "name").sortWithinPartitions("depth", "name", "conv_id")
    return rows.mapInArrow(run, "depth long, name long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node."""
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    with Scratch(conversations.sparkSession) as scratch:
        sequence, length = rebuilt(turns(conversations, scratch), scratch)
        length = scratch.keep(length, "lengths")
        table, full = nodes(sequence, length, scratch)
        found = table.join(subtree_sums(table, scratch), ["conv_id", "depth"]).join(end_hashes(full), ["depth", "name"], "left")
        return cut(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *SUMS, F.coalesce("ends_sha256", nothing).alias("ends_sha256")))


#: The same by lists of turns; crc32 is worked out bit by bit.
SQL = f"""
WITH ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS t FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(t, ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, CAST(4294967295 AS BIGINT))) % {HEADS} AS h
  FROM ids),
own AS (
  SELECT conv_id, list({{'r': COALESCE(role, ''), 't': COALESCE(text, '')}} ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
whole AS (
  SELECT o.conv_id, list_concat(COALESCE(b.turns[1:h], []), o.turns[h + 1:]) AS turns
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {STRIDE}),
p AS (SELECT conv_id, len(turns) AS n, unnest(generate_series(0, len(turns))) AS depth, turns FROM whole),
q AS (SELECT conv_id, n, depth, sha256(CAST(turns[1:depth] AS VARCHAR)) AS k, sha256(CAST(turns[1:depth - 1] AS VARCHAR)) AS above, COALESCE(length(turns[depth].t), 0) AS chars FROM p),
node AS (
  SELECT k, depth, CASE WHEN depth > 0 THEN any_value(above) END AS above, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MAX(chars) AS chars,
    sha256(COALESCE(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM q GROUP BY k, depth),
child AS (SELECT above AS k, depth - 1 AS depth, COUNT(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, COALESCE(child.n, 0) AS n_children FROM node LEFT JOIN child USING (k, depth)),
below AS (
  SELECT a.k, a.depth, COUNT(*) FILTER (WHERE d.n_children = 0) AS n_leaves, CAST(SUM((d.n_convs - 1) * d.chars) AS BIGINT) AS saved_tokens
  FROM full_node d JOIN q ON q.conv_id = d.conv_id AND q.depth <= d.depth JOIN full_node a ON a.k = q.k AND a.depth = q.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
FROM full_node f JOIN below b USING (k, depth) LEFT JOIN full_node u ON u.k = f.above AND u.depth = f.depth - 1"""
