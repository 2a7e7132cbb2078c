"""Fingerprints of tables: one number pair for a whole table whatever its order and partitioning, and a Merkle tree that names damaged parts.

A row's hash covers all columns by name, with nulls told apart from any value. A table's print is the count and the sums of two 64-bit row hashes
(as exact decimals), which partial aggregation gives without a shuffle of rows; copies of a row count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.sources import shared


def row_hash(df: DataFrame, salt: str) -> Column:
    """A 64-bit hash of a row's columns in the order of their names; maps are taken as JSON text."""
    parts: list[Column] = [F.lit(salt)]
    for name in sorted(df.columns):
        c = F.col(f"`{name}`")
        value = F.to_json(F.struct(c.alias("x"))) if "map<" in df.schema[name].dataType.simpleString() or df.schema[name].dataType.typeName() == "variant" else c
        parts += [F.lit(name), c.isNull(), value]
    return F.xxhash64(*parts)


def fingerprint(df: DataFrame) -> str:
    """SNK-05: the table's print as text."""
    sums = [F.sum(row_hash(df, s).cast("decimal(20)")).alias(s) for s in ("a", "b")]
    n, a, b = df.agg(F.count("*").alias("n"), *sums).first()
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    return f"{n}:{a or 0}:{b or 0}:{schema}"


class Materialised:
    """SNK-05: a table in a folder that is written anew only if its rows differ from those there.

    A write makes a new generation beside the old one and then the print that names it, as the last step, so readers see
    one or the other whole, and a write that breaks off is never seen. The generation before stays for its readers; older ones go.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[tuple[int, str]]:
        path = f"{self.folder}/prints"
        if not shared.exists(self.spark, path):
            return []
        return sorted((r.version, r.print) for r in self.spark.read.schema("version long, print string").json(path).collect())  # a row a generation

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.folder)
        return self.spark.read.parquet(f"{self.folder}/generation-{found[-1][0]}")

    def write(self, df: DataFrame) -> bool:
        """Whether anything was written."""
        found, now = self.versions(), fingerprint(df)
        if found and found[-1][1] == now:
            return False
        version = found[-1][0] + 1 if found else 0
        df.write.mode("overwrite").parquet(f"{self.folder}/generation-{version}")
        self.spark.createDataFrame([(version, now)], "version long, print string").coalesce(1).write.mode("append").json(f"{self.folder}/prints")
        for old, _ in found[:-1]:
            shared.delete(self.spark, f"{self.folder}/generation-{old}")
        return True


# --- Merkle trees (EVD-18)


def chunk_digests(df: DataFrame, key: str, order: Sequence[str], rows: int) -> DataFrame:
    """key, chunk, n, digest: a SHA-256 over every so many rows of a key in order of their place, which is the column ``order[0]`` counted from 0."""
    data = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    at = F.col(order[0])
    lines = df.select(key, F.floor(at / rows).alias("chunk"), F.struct(*order, data.alias("data")).alias("line"))
    found = lines.groupBy(key, "chunk").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line")).alias("lines"))
    return found.select(key, "chunk", "n", F.sha2(F.array_join(F.transform("lines", lambda x: x["data"]), "\n"), 256).alias("digest"))


def merkle(chunks: DataFrame, key: str, fan: int = 16) -> DataFrame:
    """key, level, node, n, digest: level 0 are the chunks, each level above digests up to ``fan`` nodes, the last has one node a key."""
    level = chunks.select(key, F.lit(0).alias("level"), F.col("chunk").alias("node"), "n", "digest")
    levels, depth = [level], 0
    most = chunks.agg(F.max("chunk")).first()[0]
    while most:
        depth, most = depth + 1, most // fan
        parts = F.sort_array(F.collect_list(F.struct("node", "n", "digest")))
        text = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["node"].cast("string"), x["n"].cast("string"), x["digest"])), ",")
        level = level.groupBy(key, F.floor(F.col("node") / fan).alias("node")).agg(F.sum("n").alias("n"), parts.alias("parts")).select(key, F.lit(depth).alias("level"), "node", "n", F.sha2(text, 256).alias("digest"))
        levels.append(level)
    return reduce(DataFrame.union, levels)


def damaged(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """EVD-18: key, chunk, fault (changed, missing, added) of the chunks that differ from what is known.

    Only keys whose top digests differ have their chunks compared.
    """

    def tops(tree: DataFrame) -> DataFrame:
        return tree.groupBy(key).agg(F.max_by("digest", F.struct("level", "node")).alias("digest"))

    a, b = tops(known).withColumnRenamed("digest", "was"), tops(found).withColumnRenamed("digest", "now")
    keys = a.join(b, key, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(key)
    sides = [t.where("level = 0").select(key, F.col("node").alias("chunk"), F.struct("n", "digest").alias(name)).join(keys, key, "left_semi") for t, name in ((known, "was"), (found, "now"))]
    met = sides[0].join(sides[1], [key, "chunk"], "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return met.select(key, "chunk", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").otherwise("changed").alias("fault"))


# --- cursors (STR-10)


class StaleToken(ValueError):
    """The history that a token belongs to is no longer as it was."""


def page(df: DataFrame, order: Sequence[str], size: int, token: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """STR-10: the next rows in a total order, and the token of the page after (None at the end).

    A token holds the table's print and the last row's place in the order, so pages of an unchanged table join to the whole, and a changed one is refused. Each
    page is a filter and the first rows of what is left: no page is found by counting through those before it.
    """
    now = fingerprint(df)
    rest = df
    if token is not None:
        was, last = token
        if was != now:
            raise StaleToken("the table has changed since the page before")
        rest = df.where(F.struct(*(F.col(c) for c in order)) > F.struct(*(F.lit(x).cast(df.schema[c].dataType) for c, x in zip(order, last, strict=True))))
    rows = rest.orderBy(*order).limit(size)
    ends = rows.agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last")).first()
    return rows, (now, tuple(ends["last"])) if ends["n"] == size else None
