"""Connected components of an edge table by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch

#: A task of a round works off so many edges; a small table is not dealt over all shuffle partitions, with a file for each.
TASK_EDGES = 200_000


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that (a, b) edges reach from each node on an edge; a table of ``scratch``.

    Every round a node takes the smallest label among its neighbours' and its own, then the label of its label; rounds grow with
    the logarithm of the longest path. Each round's table is written to the shared folder, and the one before goes. Hot nodes
    only meet in a min(), which Spark combines before the shuffle.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = scratch.keep(edges.select("a", "b").unionByName(back).filter("a <> b").distinct(), "edges")
    tasks = max(1, -(-both.count() // TASK_EDGES))
    first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.col("a").alias("held"))
    table = scratch.keep(first.coalesce(tasks), "labels")
    none = F.lit(None).cast("long").alias("held")
    for _ in range(max_rounds):
        labels = table.select("node", "component")
        own = labels.select("node", "component", F.col("component").alias("held"))
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component", none)
        above = labels.select(F.col("node").alias("k"), "component")
        up = labels.select("node", F.col("component").alias("k")).join(above, "k").select("node", "component", none)
        heard = own.unionAll(heard).unionAll(up).groupBy("node")
        new = heard.agg(F.min("component").alias("component"), F.max("held").alias("held"))
        new = scratch.keep(new.coalesce(tasks), "labels")
        scratch.drop(table)
        table = new
        if new.filter("component < held").isEmpty():
            scratch.drop(both)
            return new.select("node", "component")
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
