"""Joins, merges, windows and orders of snapshots as DataFrame operators; column names are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.sources.shared import keep

# --- predicates (FLT)


def holds(value: Column, op: str, threshold) -> Column:
    """FLT-03: a comparison that is false, never null, for missing and non-finite values."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    found = {">=": value >= threshold, ">": value > threshold, "<=": value <= threshold, "<": value < threshold, "==": value == threshold, "!=": value != threshold}[op]
    fine = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < F.lit(float("inf")))
    return F.coalesce(fine & found, F.lit(False))


def within(value: Column, low, high, upper_inclusive: bool = False) -> Column:
    """FLT-04: [low, high) or [low, high]."""
    return holds(value, ">=", low) & holds(value, "<=" if upper_inclusive else "<", high)


def mentions(term: str, *columns: str) -> Column:
    """FLT-08: whether any of the columns contains the term, whatever the case."""
    found = [F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False)) for c in columns]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def highest_only(df: DataFrame, group: list[str], rank: str, triggered: str) -> DataFrame:
    """FLT-07: of each group's triggered rows those of the highest rank; all rows that aren't triggered."""
    top = F.max(F.when(F.col(triggered), F.col(rank))).over(Window.partitionBy(*group))
    return df.withColumn("_top", top).where(~F.col(triggered) | (F.col(rank) == F.col("_top"))).drop("_top")


# --- joins (JON)


def latest_before(left: DataFrame, right: DataFrame, key: str, cutoff: str, time: str, ties: list[str], strict: bool = False) -> DataFrame:
    """JON-06/07: for each left row the right row of its key with the latest time up to the cutoff; later ties win.

    Both sides stand in one window of the key, so a key costs its rows once, not left rows times right rows. Rows with a null key or
    cutoff, and those with nothing before, get nulls; repeated left rows stay.
    """
    own, other = left.columns, [c for c in right.columns if c != key]
    facts = F.struct(*other)
    after = F.lit(2 if strict else 0)  # whether right rows of the very cutoff stand behind or before it
    a = left.select(F.col(key).alias("_key"), F.col(cutoff).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_left"))
    b = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_at"), after.alias("_side"), facts.alias("_right"), F.struct(*ties).alias("_ties"))
    both = a.unionByName(b, allowMissingColumns=True)
    so_far = Window.partitionBy("_key").orderBy("_at", "_side", "_ties").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_best", F.last("_right", ignorenulls=True).over(so_far)).where("_side = 1")
    known = F.col("_at").isNotNull() & F.col("_key").isNotNull()
    return met.select("_left.*", *(F.when(known, F.col(f"_best.{c}")).alias(c) for c in other))


def band_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """JON-08: rows of one key no further apart than ``seconds``; buckets of that length keep it an equi-join."""
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    step = seconds * 1_000_000
    a = left.withColumn("_b", F.floor(micros(left_time) / step)).withColumn("_bucket", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).drop("_b")
    b = right.withColumn("_bucket", F.floor(micros(right_time) / step))
    near = F.abs(micros(left_time) - micros(right_time)) <= step
    return a.join(b, [key, "_bucket"]).where(near).drop("_bucket")


def unique_only(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """JON-11: adds the value of the key where exactly one exists, and else the state unknown or ambiguous."""
    known = right.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias("_value"))
    out = left.join(known, key, "left")
    return out.select(*[left[c] for c in left.columns], F.when(F.col("_n") == 1, F.col("_value")).alias(value), F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unknown").alias(f"{value}_state"))


def outer_change(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """JON-09/CMP-03: both sides of every key, with the change and its kind."""
    a, b = before.withColumnRenamed(value, "before"), after.withColumnRenamed(value, "after")
    out = a.join(b, keys, "full")
    change = F.col("after") - F.col("before")
    kind = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "disappeared").when(change > 0, "increased").when(change < 0, "decreased").otherwise("unchanged")
    return out.select(*keys, "before", "after", change.alias("change"), kind.alias("kind"))


# --- merges (AGG)


def best_fact(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """AGG-28: the value of the highest order (rank, time, file ...) for each key, and whether values disagree."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), (F.countDistinct(value) > 1).alias("disagreement"))


def merge_by_rank(df: DataFrame, key: str, fields: list[str], rank: str) -> DataFrame:
    """AGG-03: for each field of a key the non-empty value of the highest rank; lower ranks fill gaps; disagreements are counted."""
    aggs = []
    for f in fields:
        filled = F.nullif(F.col(f).cast("string"), F.lit(""))
        aggs += [F.max_by(F.col(f), F.when(filled.isNotNull(), F.col(rank))).alias(f), (F.countDistinct(filled) > 1).cast("int").alias(f"{f}_conflict")]
    return df.groupBy(key).agg(*aggs)


def union_text(df: DataFrame, keys: list[str], value: str, out: str, limit: int | None = None) -> DataFrame:
    """AGG-04: distinct trimmed texts of a key in order, joined by commas."""
    clean = F.nullif(F.trim(F.col(value).cast("string")), F.lit(""))
    found = F.array_sort(F.collect_set(clean))
    return df.groupBy(*keys).agg(F.array_join(F.slice(found, 1, limit) if limit else found, ",").alias(out))


# --- windows (WIN)


def with_previous(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """WIN-03: the value of the row before, within a key."""
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def counter_deltas(df: DataFrame, key: str, order: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """WIN-04/STR-07: change of a counter since the row before, with its kind: first, reset or delta."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    out = df.withColumn("previous", before)
    kind = F.when(F.col("previous").isNull(), "first").when(F.col(value) < F.col("previous") - tolerance, "reset-detected").otherwise("delta")
    return out.withColumn("kind", kind).withColumn("delta", F.when(F.col("kind") == "delta", F.col(value) - F.col("previous")))


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """SRT: the place (from 1) of every row in one order of the whole table, which should have no ties.

    Rows are dealt out by ranges of the order and numbered within a range; how many rows stand before a range is one number for each.
    """
    dealt = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))  # the ranges stay as they are, whatever is read of them
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(offsets, "_range").withColumn(out, (F.col("_before") + F.col("_nth")).cast("long")).drop("_range", "_nth", "_before")


def absence_streak(observations: DataFrame, presence: DataFrame, keys: DataFrame, key: str, at: str) -> DataFrame:
    """WIN-01: how many of the latest observations pass until the key was present; all of them if it never was.

    Only a key's latest presence counts, so one row a key meets the places of the observations from the newest.
    """
    ranked = placed(observations.select(at).distinct(), [F.desc(at)], "_rank")
    total = ranked.agg(F.count("*").alias("_all"))
    seen = presence.join(ranked.select(at), at, "left_semi").groupBy(key).agg(F.max(at).alias(at)).join(ranked, at)
    joined = keys.select(key).distinct().join(seen.select(key, "_rank"), key, "left").crossJoin(F.broadcast(total))  # one row
    return joined.select(key, (F.coalesce(F.col("_rank") - 1, F.col("_all"))).cast("long").alias("absent"))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """WIN-06/07/08: the first n rows of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def occurrence(df: DataFrame, keys: list[str], order: list[str], out: str = "occurrence") -> DataFrame:
    """WIN-09: the how-manieth row of its key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# --- orders (SRT)


def natural_key(c: Column) -> Column:
    """SRT-02: runs of digits, without leading zeros, behind their padded length, so that text order is natural order."""

    def number(x: Column) -> Column:
        digits = F.regexp_replace(x, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x)), "")


def missing_last(c: Column, descending: bool = False) -> list[Column]:
    """SRT-01: missing values last, whatever the direction."""
    return [c.isNull().asc(), c.desc() if descending else c.asc()]


# --- merges of arrays (AGG) and identities (JON)


def merge_entries(rows: DataFrame, owner: str, key: list[str], rank: list[str], fields: list[str]) -> DataFrame:
    """AGG-08/09: one entry for each owner and key, each field from the entry of the lowest rank that has it, the least value of equals; entries without a whole key stay as they are."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*rank, c))).alias(c) for c in fields]
    return rows.where(whole).groupBy(owner, *key).agg(*first).unionByName(rows.where(~whole).select(owner, *key, *fields))


def with_fallback_key(rows: DataFrame, owner: str, key: str, fallback: str) -> DataFrame:
    """AGG-08: entries without a key take that of their owner's entries with the same fallback value, if these have one only."""
    known = rows.where(F.col(key).isNotNull() & F.col(fallback).isNotNull()).groupBy(owner, fallback).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    one = known.where("_low = _high").select(owner, fallback, F.col("_low").alias("_key"))
    return rows.join(one, [owner, fallback], "left").withColumn(key, F.coalesce(key, "_key")).select(*rows.columns)


def compatible_groups(rows: DataFrame, group: str, concrete: str) -> DataFrame:
    """JON-17: the groups whose members have one concrete address at most (nulls agree with all)."""
    return rows.groupBy(group).agg(F.count_distinct(concrete).alias("addresses"), F.count("*").alias("members")).withColumn("compatible", F.col("addresses") <= 1)
