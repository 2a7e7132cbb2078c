"""CMP-10, MUT-08: comparisons of successive observations, stored by content and derived only where they aren't known; EVD-13: the revision that held at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.operators.prints import row_hash
from meshlake.sources import shared


def observation_digests(rows: DataFrame, at: str) -> DataFrame:
    """at, digest: a print of each observation's rows, whatever their order; a row for each observation."""
    sums = [F.sum(row_hash(rows, s).cast("decimal(20)")).cast("string") for s in ("a", "b")]
    return rows.groupBy(at).agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("digest"))


def successive(digests: DataFrame, at: str) -> DataFrame:
    """older_at, newer_at, older, newer (digests) of each observation and the one before it."""
    order = Window.orderBy(at)  # a row for each observation
    found = digests.select(F.lag(at).over(order).alias("older_at"), F.col(at).alias("newer_at"), F.lag("digest").over(order).alias("older"), F.col("digest").alias("newer"))
    return found.where("older_at IS NOT NULL")


class PairStore:
    """A folder of compared pairs: ``known`` lists the pairs by their observations' digests, ``items`` holds what differs between the two.

    Both are only ever added to, so a pair is derived once, whatever else changes; items are written before the pair counts as known, and a run that breaks off
    between the two derives them again under another run number, of which only listed ones are read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def known(self) -> DataFrame:
        path, schema = f"{self.folder}/known", "older string, newer string, run string"
        return self.spark.read.schema(schema).parquet(path) if shared.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def update(self, rows: DataFrame, at: str, key: str, value: str, tolerance: float = 0.0) -> int:
        """Derive the pairs of successive observations that aren't stored; how many these were.

        rows has one value for each observation and key; a null value is one that is missing. Items of a pair: key, before, after, change (appeared, disappeared, changed).
        """
        pairs = shared.keep(successive(observation_digests(rows, at), at))
        missing = shared.keep(pairs.join(self.known(), ["older", "newer"], "left_anti").dropDuplicates(["older", "newer"]))
        n = missing.count()
        if n:
            run = shared.new_folder(self.spark, "run").rpartition("-")[2]
            sides = []
            for side, name in (("older", "before"), ("newer", "after")):
                chosen = missing.select("older", "newer", F.col(f"{side}_at").alias(at))
                sides.append(rows.join(chosen, at).where(F.col(value).isNotNull()).select("older", "newer", key, F.col(value).alias(name)))
            items = sides[0].join(sides[1], ["older", "newer", key], "full")
            change = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "disappeared").when(F.abs(F.col("after") - F.col("before")) > tolerance, "changed")
            items = items.withColumn("change", change).where("change IS NOT NULL").withColumn("run", F.lit(run))
            items.write.mode("append").partitionBy("run").parquet(f"{self.folder}/items")
            missing.select("older", "newer", F.lit(run).alias("run")).write.mode("append").parquet(f"{self.folder}/known")
        shared.forget(pairs, missing)
        return n

    def read(self, rows: DataFrame, at: str) -> DataFrame:
        """older_at, newer_at, key, before, after, change of the successive observations of rows, all from the store."""
        pairs = successive(observation_digests(rows, at), at).join(self.known(), ["older", "newer"])
        return self.spark.read.parquet(f"{self.folder}/items").join(pairs, ["older", "newer", "run"]).drop("older", "newer", "run")


def revision_at(facts: DataFrame, revisions: DataFrame, at: str, keys: list[str], bucket_days: int = 32) -> DataFrame:
    """EVD-13: the columns of facts, and revision: the one that held at a fact's time, null if none did.

    revisions: keys (null: any), valid_from, valid_to (null: open; the end itself is outside), revision. Of several that hold, that with the most keys given, then
    the latest beginning, then the greatest revision. A fact meets a revision in the bucket of its time only: revisions are spread over the buckets that they cover, within the span of
    the facts. Each choice of given keys is an equi-join of its own, so a wildcard never meets everything.
    """
    spark_day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (86_400 * bucket_days))
    facts = facts.withColumn("_bucket", spark_day(at)).withColumn("_id", F.monotonically_increasing_id())
    facts = shared.keep(facts)
    span = facts.agg(F.min("_bucket").alias("_low"), F.max("_bucket").alias("_high"))  # one row
    spread = revisions.crossJoin(F.broadcast(span)).withColumn("_from", F.greatest(spark_day("valid_from"), "_low")).withColumn("_to", F.least(F.coalesce(spark_day("valid_to"), "_high"), "_high")).where("_from <= _to")
    spread = spread.withColumn("_bucket", F.explode(F.sequence("_from", "_to"))).drop("_low", "_high", "_from", "_to")
    held = None
    for chosen in range(1 << len(keys)):
        given = [k for i, k in enumerate(keys) if chosen >> i & 1]
        kind: Column = F.lit(True)
        for k in keys:
            kind = kind & (F.col(k).isNotNull() if k in given else F.col(k).isNull())
        some = spread.where(kind).drop(*(k for k in keys if k not in given))
        met = facts.select("_id", "_bucket", F.col(at).alias("_at"), *given).join(some, ["_bucket", *given]).where("_at >= valid_from AND (valid_to IS NULL OR _at < valid_to)")
        met = met.select("_id", F.struct(F.lit(len(given)).alias("given"), "valid_from", "revision").alias("r"))
        held = met if held is None else held.union(met)
    best = held.groupBy("_id").agg(F.max("r").alias("r"))
    return facts.join(best, "_id", "left").withColumn("revision", F.col("r.revision")).drop("_id", "_bucket", "r")
