"""GRF-01: links and nodes whose loss splits a network, and what it falls apart into.

All from one breadth-first forest. A link outside it joins two nodes of which neither is above the other, and closes a circle
over the lowest node above both. For each node, ``low`` is the least depth of such meeting nodes over all outside links that
end in its subtree: its link upward is a bridge if nothing reaches past the node itself, and shares a circle with the link above if something
reaches past its parent. Links that share circles are a block, by components over links; a node between blocks is a cut node.

Meeting nodes come from ancestors at doubling distances, subtree values from pointer doubling: joins and aggregations in as many rounds as the logarithm
of the forest's depth. Only the forest itself takes a join for each hop of the longest shortest path. No adjacency or component is ever held together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.operators import graph
from meshlake.sources.shared import forget, keep

COMBINE: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),  # least and greatest pass over nulls
    "max": (F.max, F.greatest),
}


def subtree_totals(tree: DataFrame, **values: tuple[str, Column]) -> DataFrame:
    """node and for each name the sum, min or max of a column over the node's subtree; tree has node and parent (null at roots).

    After round k a row holds the total of its descendants at less than 2^k hops and the ancestor at 2^k hops.
    """
    level = keep(tree.select("node", F.col("parent").alias("up"), *(c.alias(name) for name, (_, c) in values.items())))
    while True:
        live = level.where("up IS NOT NULL")
        if live.isEmpty():
            return level.drop("up")
        gains = live.groupBy(F.col("up").alias("node")).agg(*(COMBINE[how][0](name).alias(f"_{name}") for name, (how, _) in values.items()))
        further = level.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        joined = level.join(further, "up", "left").join(gains, "node", "left")
        above = keep(joined.select("node", F.col("_up").alias("up"), *(COMBINE[how][1](F.col(name), F.col(f"_{name}")).alias(name) for name, (how, _) in values.items())))
        forget(level)
        level = above


def ancestors(tree: DataFrame) -> tuple[DataFrame, int]:
    """node, depth, u0, u1, ...: the ancestors 1, 2, 4, ... hops above (the root's own where there are fewer), and how many columns."""
    table, k = keep(tree.select("node", "depth", F.coalesce("parent", "node").alias("u0"))), 0
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    while 2 << k <= deepest:
        above = table.select(F.col("node").alias(f"u{k}"), F.col(f"u{k}").alias(f"u{k + 1}"))
        table, k = keep(table.join(above, f"u{k}")), k + 1
    return table, k + 1


def meeting_depths(tree: DataFrame, outside: DataFrame) -> DataFrame:
    """a, b, meet: the depth of the lowest node above both ends of every link outside a breadth-first forest."""
    table, n = ancestors(tree)

    def end(name: str) -> DataFrame:
        return table.select(F.col("node").alias(name), F.col("depth").alias(f"{name}_depth"), *(F.col(f"u{k}").alias(f"{name}{k}") for k in range(n)))

    at = outside.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
    met = at.join(end("x"), "x").join(end("y"), "y")  # the ends of such a link are on one level or on two next to each other
    at = met.select("a", "b", F.when(F.col("x_depth") > F.col("y_depth"), F.col("x0")).otherwise(F.col("x")).alias("x"), F.when(F.col("y_depth") > F.col("x_depth"), F.col("y0")).otherwise(F.col("y")).alias("y"))
    for k in reversed(range(n)):
        met = keep(at).join(end("x"), "x").join(end("y"), "y")
        differ = F.col(f"x{k}") != F.col(f"y{k}")
        at = met.select("a", "b", *(F.when(differ, F.col(f"{c}{k}")).otherwise(F.col(c)).alias(c) for c in "xy"))
    met = at.join(end("x").select("x", "x_depth"), "x")
    return met.select("a", "b", (F.col("x_depth") - 1).alias("meet"))


def analysed(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, parent, depth, root, low, size (of the subtree), least (its smallest node), all (nodes of the component), block (of the link upward, null at roots); pairs has low and high, without repeats."""
    labels = graph.components(nodes, pairs)
    roots = labels.select(F.col("component").alias("node")).distinct()
    tree = keep(graph.depths(pairs, roots).join(labels.withColumnRenamed("component", "root"), "node"))
    inside = tree.where("parent IS NOT NULL").select(F.least("node", "parent").alias("low"), F.greatest("node", "parent").alias("high"))
    outside = pairs.select("low", "high").join(inside, ["low", "high"], "left_anti").select(F.col("low").alias("a"), F.col("high").alias("b"))
    outside = keep(meeting_depths(tree, outside))
    ends = outside.select(F.col("a").alias("node"), "meet").union(outside.select("b", "meet")).groupBy("node").agg(F.min("meet").alias("meet"))
    values = subtree_totals(tree.join(ends, "node", "left"), low=("min", F.coalesce("meet", "depth")), size=("sum", F.lit(1).cast("long")), least=("min", F.col("node")))
    tree = keep(tree.join(values, "node"))
    above = tree.select(F.col("node").alias("parent"), F.col("depth").alias("parent_depth"))
    joined = tree.join(above, "parent").where("low < parent_depth").select(F.least("node", "parent").alias("low"), F.greatest("node", "parent").alias("high"))
    around = joined.union(outside.select(F.least("a", "b"), F.greatest("a", "b")))
    blocks = graph.components(tree.where("parent IS NOT NULL").select("node"), around).withColumnRenamed("component", "block")
    sizes = tree.where("parent IS NULL").select("root", F.col("size").alias("all"))
    return keep(tree.join(blocks, "node", "left").join(sizes, "root"))


def bridges(found: DataFrame) -> DataFrame:
    """low, high, low_side, high_side: links whose loss splits a component, and the nodes left on either side; found comes from ``analysed``."""
    rest = F.col("all") - F.col("size")
    lower = F.col("node") < F.col("parent")
    return found.where("parent IS NOT NULL AND low >= depth").select(
        F.least("node", "parent").alias("low"), F.greatest("node", "parent").alias("high"),
        F.when(lower, F.col("size")).otherwise(rest).alias("low_side"), F.when(lower, rest).otherwise(F.col("size")).alias("high_side"),
    )


def cut_parts(found: DataFrame) -> DataFrame:
    """node, part, size: for every node whose loss splits its component, the parts that remain, named by their smallest node."""
    below = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), "block").agg(F.min("least").alias("part"), F.sum("size").alias("size"))
    own = found.select("node", F.col("root"), F.col("all"), F.col("block").alias("own"), F.col("parent").isNull().alias("top"))
    below = below.join(own, "node").where("own IS NULL OR block <> own")
    sides = below.select("node", "part", "size")
    above = below.groupBy("node").agg(F.first("root").alias("part"), (F.first("all") - 1 - F.sum("size")).alias("size"), F.first("top").alias("top")).where("NOT top").drop("top")
    parts = sides.union(above)
    cuts = parts.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    return parts.join(cuts, "node", "left_semi")
