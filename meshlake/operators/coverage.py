"""EVD-09: what devices were asked for and what they gave, as distinct rows; PRJ-05: the columns that semi-structured rows have.

A set is its distinct (owner, value) rows: the sets are small and many, and a bitmap takes 4 kB however few values it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(asked: DataFrame, given: DataFrame, owner: str, attempt: str, value: str) -> DataFrame:
    """EVD-09: owner, attempt, requested, received, covered: the largest request of each owner (the first of equals), how many values it got in all, and how many of the requested ones.

    asked has owner, attempt, value; given has owner and value of valid reports. Null values count for nothing. received is null for an owner without a valid report.
    """
    known = F.col(value).isNotNull()
    requests = asked.where(known).select(owner, attempt, value).distinct()
    sizes = requests.groupBy(owner, attempt).agg(F.count("*").alias("n"))
    best = sizes.groupBy(owner).agg(F.max(F.struct("n", (-F.col(attempt)).alias("first"))).alias("x")).select(owner, (-F.col("x.first")).alias(attempt), F.col("x.n").alias("requested"))
    got = given.where(known).select(owner, value).distinct()
    received = got.groupBy(owner).agg(F.count("*").alias("received"))
    wanted = requests.join(best.select(owner, attempt), [owner, attempt], "left_semi")
    covered = wanted.join(got, [owner, value], "left_semi").groupBy(owner).agg(F.count("*").alias("covered"))
    out = best.join(received, owner, "left").join(covered, owner, "left")
    return out.select(owner, attempt, "requested", "received", F.coalesce("covered", F.lit(0).cast("long")).alias("covered"))


# --- columns of semi-structured rows (PRJ-05)


def paths(df: DataFrame, record: str, deepest: int = 8) -> DataFrame:
    """path, type, n, first: every dotted path of the objects in a VARIANT column with the type and number of its values (nulls included as VOID) and the least place of one.

    Each level of nesting is one pass; objects deeper than ``deepest`` are values of type OBJECT. df has ``place`` besides, a number of the row.
    """
    spark, found = df.sparkSession, []
    level = df.select("place", F.lit("").alias("path"), F.col(record).alias("v"))
    for depth in range(deepest):
        name = f"level_{id(level)}"
        level.createOrReplaceTempView(name)
        inner = spark.sql(f"SELECT place, concat(path, CASE WHEN path = '' THEN '' ELSE '.' END, x.key) AS path, x.value AS v, schema_of_variant(x.value) AS type FROM {name}, LATERAL variant_explode(v) AS x WHERE x.key IS NOT NULL")
        spark.catalog.dropTempView(name)
        is_object = F.col("type").startswith("OBJECT")
        values = inner.where(~is_object | F.lit(depth == deepest - 1))
        found.append(values.groupBy("path", F.regexp_extract("type", "^[A-Z]+", 0).alias("type")).agg(F.count("*").alias("n"), F.min("place").alias("first")))
        level = inner.where(is_object).select("place", "path", "v")
        if depth == deepest - 1 or level.isEmpty():
            break
    return reduce(DataFrame.union, found)


def ordered(found: DataFrame, pinned: Sequence[str]) -> DataFrame:
    """PRJ-05: path, types, n, column: pinned paths first in their order, then by the first row that has them, then by name; one row a path."""
    each = found.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n"), F.min("first").alias("first"))
    rank: Column = F.coalesce(F.element_at(F.create_map(*(x for i, p in enumerate(pinned) for x in (F.lit(p), F.lit(i)))), F.col("path")), F.lit(len(pinned))) if pinned else F.lit(0)
    order = F.struct(rank.alias("rank"), "first", "path")
    columns = F.array_sort(F.collect_list(F.struct(order.alias("order"), "types", "n")))  # a row for each path of the schema
    return each.agg(columns.alias("c")).select(F.posexplode("c").alias("column", "c")).select("c.order.path", "c.types", "c.n", F.col("column").cast("long").alias("column"))


def projected(df: DataFrame, record: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows with a column for each (path, type); values of another type become null."""
    return df.select("*", *(F.try_variant_get(record, "$." + p, t).alias(p.replace(".", "_")) for p, t in columns)).drop(record)
