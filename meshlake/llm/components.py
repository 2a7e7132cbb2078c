"""Connected components of a graph given as a table of links, by alternating star contractions.

Every round links each node's larger neighbours to the smallest node around it, then each node's smaller
neighbours likewise, until the links no longer change: then they form stars around the smallest node of each
component. A round is two aggregations and two joins; the aggregates are written first, so that Spark can split
a hub's rows in the join. Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.scratch import forget, keep


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link.

    links has the integer columns ``a`` and ``b``; direction, repeats, nulls and links of a node to itself don't matter.
    Each half of a round gives one link for each that it takes, so the table never grows.
    """
    larger, smaller = F.greatest("a", "b").cast("long"), F.least("a", "b").cast("long")
    edges = keep(links.where("a <> b").select(larger.alias("a"), smaller.alias("b")))
    while not _stars(edges):
        # large star: a node's larger neighbours go to the smallest node around it
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = edges.withColumnRenamed("b", "u").join(least, "u").select("a", F.col("m").alias("b"))
        large = keep(large)
        # small star: its smaller neighbours, and itself
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = keep(small)
        forget(edges)
        forget(large)
        edges = small
    nodes = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x"))
    return nodes.groupBy("x.node").agg(F.min("x.component").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or linked with one centre only."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))).alias("x"))
    ends = sides.groupBy("x.node").agg(F.min("x.to").alias("low"), F.max("x.to").alias("high"), F.count("*").alias("n"), F.count("x.to").alias("out"))
    return ends.where("low <> high OR (out > 0 AND out < n)").isEmpty()
