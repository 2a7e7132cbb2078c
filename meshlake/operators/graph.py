"""Graph operators on link tables (GRF-01..06, GRF-09..11, JON-16): everything is joins and aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.sources.shared import forget, keep


def undirected(links: DataFrame, a: str, b: str) -> DataFrame:
    """GRF-06: one row for each linked pair (low, high) with the number of parallel links; links of a node to itself go."""
    return links.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.count("*").alias("links"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair as two rows (node, other)."""
    return pairs.select(F.inline(F.array(F.struct(F.col("low").alias("node"), F.col("high").alias("other")), F.struct(F.col("high").alias("node"), F.col("low").alias("other")))))


def degrees(pairs: DataFrame) -> DataFrame:
    """GRF-05: the number of distinct neighbours of each node; pairs has each pair once, as ``undirected`` gives them, so nothing is made distinct again."""
    return both_ways(pairs).groupBy("node").agg(F.count("*").alias("degree"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """GRF-02: node, component: the smallest node that it reaches; nodes without links are their own.

    Labels sink to the smallest around a node, then each takes the label of its label, so rounds grow with
    the logarithm of the longest path on most graphs. Each round is written, so nothing is computed twice and nothing stays cached.
    Joins are merges: small files of packed labels would be broadcast in every round, by way of the driver.
    """
    around = keep(both_ways(pairs))
    labels = keep(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        told = around.join(labels.withColumnRenamed("node", "other").hint("merge"), "other").select("node", "component", F.lit(None).cast(labels.schema["component"].dataType).alias("before"))
        own = labels.select("node", "component", F.col("component").alias("before"))
        sunk = keep(told.union(own).groupBy("node").agg(F.min("component").alias("component"), F.max("before").alias("before")))
        forget(labels)
        if sunk.where("component <> before").isEmpty():
            forget(around)
            return sunk.select("node", "component")
        jump = sunk.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = keep(sunk.join(jump.hint("merge"), "component", "left").select("node", F.least("component", "further").alias("component")))
        forget(sunk)


def _folded(parts: list[DataFrame]) -> list[DataFrame]:
    """The same rows in one table once there are 64, so that plans stay short however deep a graph is."""
    return parts if len(parts) < 64 else [keep(reduce(DataFrame.union, parts))]


def depths(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """GRF-03: node, depth, parent of a breadth-first forest: the least parent of the level above; a join for each level.

    A level's neighbours lie in it or next to it, so new ones need to be told apart from two levels only.
    """
    around = keep(both_ways(pairs))
    levels = [keep(roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")).distinct())]
    done, depth = levels, 0
    while True:
        near = reduce(DataFrame.union, [x.select("node") for x in levels])
        step = levels[-1].join(around, "node").select(F.col("other").alias("node"), F.col("node").alias("parent")).join(near, "node", "left_anti")
        level = keep(step.groupBy("node").agg(F.min("parent").alias("parent")).select("node", F.lit(depth + 1).alias("depth"), "parent"))
        if level.isEmpty():
            return reduce(DataFrame.union, done)
        levels, done, depth = [levels[-1], level], _folded([*done, level]), depth + 1


def best_parent(candidates: DataFrame, child: str, parent: str, score: str) -> DataFrame:
    """GRF-04: the parent with the highest score for each child, the lower id of equals."""
    return candidates.groupBy(child).agg(F.max_by(parent, F.struct(score, -F.col(parent))).alias(parent), F.max(score).alias(score))


def resolve_entities(records: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """JON-16: record, entity: records sharing any non-empty key are one entity, named by its smallest record.

    Keys link their records to the smallest record that holds them, so a key of many records gives no pairs.
    """
    held = None
    for i, k in enumerate(keys):
        part = records.select(record, F.lit(i).alias("kind"), F.nullif(F.col(k).cast("string"), F.lit("")).alias("value")).where("value IS NOT NULL")
        held = part if held is None else held.union(part)
    least = held.groupBy("kind", "value").agg(F.min(record).alias("first"))
    pairs = undirected(held.join(least.hint("merge"), ["kind", "value"]), record, "first")
    return components(records.select(F.col(record).alias("node")), pairs).select(F.col("node").alias(record), F.col("component").alias("entity"))


def isolated(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """GRF-11: nodes without a neighbour."""
    return nodes.join(both_ways(pairs), "node", "left_anti")
