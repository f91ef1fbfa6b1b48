"""Dependency graphs as edge tables (src, dst): bounded expansion, closure, strong components, cycle breaking, waves.

Loops run on the driver, one Spark job a step; each step's table is written to the shared folder, so a lost executor costs a
re-read, not the whole chain, and tables go when their loop is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.numbering import numbered
from riskloom.operators.tables import Scratch, cut


def bounded_tree(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth, path): every path of at most ``depth`` edges from each root that meets no node twice.

    Roots are filtered before the expansion; the levels are unrolled joins, so no recursion limit applies.
    """
    level = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"))
    out = level
    for k in range(1, depth + 1):
        step = level.join(edges, level["node"] == edges["src"]).filter(~F.array_contains(F.col("path"), F.col("dst")))
        level = step.select("root", F.col("dst").alias("node"), F.lit(k).alias("depth"), F.array_append("path", F.col("dst")).alias("path"))
        out = out.unionAll(level)
    return out


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def closure(edges: DataFrame, roots: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """(id): the roots and all that they reach. Each step joins the frontier only, and keeps what it adds as a table of its own."""
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.keep(_plain(edges), "edges")
        parts = [scratch.keep(roots.select("id").distinct(), "reached")]
        for _ in range(max_steps):
            step = parts[-1].join(edges, parts[-1]["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
            new = scratch.keep(step.join(_together(parts), "id", "left_anti"), "reached")
            if new.isEmpty():
                return cut(_together(parts))
            parts.append(new)
    raise RuntimeError("closure is not complete after the allowed steps")


def _plain(edges: DataFrame) -> DataFrame:
    """Distinct edges between two different nodes."""
    return edges.select("src", "dst").filter("src <> dst").distinct()


def scan_order(edges: DataFrame, packages: DataFrame, root: int) -> DataFrame:
    """(position, id): a package's closure in the order of scanning it: what it depends on, most downloaded first, itself last."""
    reached = closure(edges, packages.filter(F.col("id") == root).select("id")).join(packages.select("id", "downloads"), "id")
    rows = reached.withColumn("_last", F.col("id") == root)
    return numbered(rows, ["_last", F.desc_nulls_last("downloads"), "id"], cut).select("position", "id")


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id), without loops to the node itself."""
    return edges.filter("src <> dst").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def _peeled(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that only have incoming, or only outgoing, ones: those are in no cycle."""
    ends, starts = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")


def _highest(edges: DataFrame, turn: int, scratch: Scratch, max_steps: int = 10_000) -> DataFrame:
    """(id, before, after): of all nodes that reach a node (itself included), and of all that it reaches, the one that comes first by a
    hash. A step takes over the mark of each neighbour and the mark of the marked node, so marks travel in leaps."""
    ways = edges.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"))
    ways = scratch.keep(ways.unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"))), "ways")
    top = F.struct(F.xxhash64("id", F.lit(turn)).alias("hash"), F.col("id"))
    table = scratch.keep(ways.select("way", F.col("a").alias("id")).union(ways.select("way", "b")).distinct().withColumn("top", top), "marks")
    for _ in range(max_steps):
        own = table.select("way", "id", "top", F.col("top").alias("held"))
        none = F.lit(None).cast(table.schema["top"].dataType).alias("held")
        heard = ways.join(table.withColumnRenamed("id", "a"), ["way", "a"]).select("way", F.col("b").alias("id"), "top", none)
        leap = table.select("way", "id", F.col("top.id").alias("k")).join(table.withColumnRenamed("id", "k"), ["way", "k"]).select("way", "id", "top", none)
        new = own.unionAll(heard).unionAll(leap).groupBy("way", "id").agg(F.max("top").alias("top"), F.max("held").alias("held"))
        new = scratch.keep(new, "marks")
        table = new.drop("held")
        if new.filter("top <> held").isEmpty():
            mark = lambda way: F.max(F.when(F.col("way") == way, F.col("top.id")))
            return scratch.keep(table.groupBy("id").agg(mark(0).alias("before"), mark(1).alias("after")), "marked")
    raise RuntimeError("marks are not settled after the allowed steps")


def strong_components(edges: DataFrame, max_turns: int = 1_000) -> DataFrame:
    """(id, component) of the nodes that are in cycles: nodes that reach each other have the smallest id among them as component.

    A turn marks each node with the first node (by a hash that is new each turn) that reaches it and the first that it reaches.
    Where both are the same node, the nodes with that mark are a component, and are done. Nodes of one component have equal marks,
    so edges between different marks are in no cycle and go. Each turn settles a component of every connected rest, and splits
    what comes before it, after it and beside it; turns grow with the logarithm of the number of nodes.
    """
    with Scratch(edges.sparkSession) as scratch:
        left, done = scratch.keep(_plain(edges), "edges"), []
        for turn in range(max_turns):
            left = scratch.keep(_peeled(_peeled(left)), "edges")
            if left.isEmpty():
                break
            marks = _highest(left, turn, scratch)
            done.append(marks.filter("before = after").select("id", F.col("before").alias("root")))
            rest = marks.filter("before <> after")
            ends = [rest.select(*[F.col(c).alias(c if c != "id" else end) for c in rest.columns]) for end in ("src", "dst")]
            left = left.join(ends[0], "src").join(ends[1], ["dst", "before", "after"]).select("src", "dst")
        else:
            raise RuntimeError("components are not settled after the allowed turns")
        if not done:
            return cut(edges.select(F.col("src").cast("long").alias("id"), F.col("src").cast("long").alias("component")).limit(0))
        found = _together(done)
        names = found.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("n")).filter("n > 1")
        return cut(found.join(names, "root").select("id", "component"))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): inside each strong component the edges to a larger id. Without them no cycle is left, and no other edge goes."""
    parts = strong_components(edges)
    ends = [parts.select(F.col("id").alias(end), "component") for end in ("src", "dst")]
    return _plain(edges).filter("dst > src").join(ends[0], "src").join(ends[1], ["dst", "component"]).select("src", "dst")


def break_cycles(edges: DataFrame) -> DataFrame:
    """An acyclic subset, without ``cycle_edges``. Which edges go depends on the ids alone, not on any order of visits."""
    return _plain(edges).join(cycle_edges(edges), ["src", "dst"], "left_anti")


#: Rounds of setting aside nodes that nothing depends on, before paths are doubled among the others.
RIMS = 2


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, wave): 0 for nodes that depend on nothing, else one more than the latest wave among what they depend on (edges must be
    acyclic: see ``break_cycles``). Nodes of one wave can be worked on side by side.

    A wave is the length of the longest path down from a node. Tables of which nodes paths of exactly 1, 2, 4, ... edges connect
    come from joining each with itself; then each node's length is found digit by digit: from where its paths of the length so far
    end, does any go on for 2**k edges more? Jobs grow with the logarithm of the longest path. Nodes that nothing depends on need
    no paths of their own: they are set aside first (``RIMS`` times) and take one more than their latest neighbour at the end. In a
    registry most packages are such, and paths run among the few that others use.
    """
    with Scratch(edges.sparkSession) as scratch:
        rings = [scratch.keep(inside(edges, nodes).distinct(), "edges")]
        for _ in range(RIMS):
            used = rings[-1].select(F.col("dst").alias("src")).distinct()
            rings.append(scratch.keep(rings[-1].join(used, "src", "left_semi").select("src", "dst"), "edges"))
        core = rings.pop()
        most, paths = core.select("src").distinct().count(), [core]
        while True:
            more = paths[-1].select("src", F.col("dst").alias("k")).join(paths[-1].withColumnRenamed("src", "k"), "k").select("src", "dst").distinct()
            more = scratch.keep(more, "paths")
            if more.isEmpty():
                break
            if 1 << len(paths) > most:
                raise ValueError("the edges have a cycle")
            paths.append(more)
        at = core.select(F.col("src").alias("id"), F.col("src").alias("end"), F.lit(0).cast("long").alias("wave")).distinct()
        for k in range(len(paths) - 1, -1, -1):
            went = at.join(paths[k].withColumnRenamed("src", "end"), "end").select("id", F.col("dst").alias("end"), (F.col("wave") + (1 << k)).alias("wave"))
            went = scratch.keep(went.distinct(), "went")
            at = scratch.keep(went.unionByName(at.join(went.select("id").distinct(), "id", "left_anti").select("id", "end", "wave")), "ends")
        known = at.select("id", "wave").distinct()
        for k in range(len(rings) - 1, -1, -1):
            ids = rings[k - 1].select(F.col("dst").alias("id")).distinct() if k else nodes.select("id").distinct()
            low = rings[k].select(F.col("src").alias("id"), "dst").join(known.withColumnRenamed("id", "dst"), "dst", "left")
            low = low.groupBy("id").agg((F.coalesce(F.max("wave"), F.lit(0)) + 1).alias("_above"))
            known = ids.join(known, "id", "left").join(low, "id", "left").select("id", F.coalesce("wave", "_above", F.lit(0)).cast("long").alias("wave"))
            known = scratch.keep(known, "waves")
        return cut(known)
