"""Health rules as expressions over evidence columns (RUL-01..23) and comparisons of intervals (CMP-01..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts from best to worst.
LEVELS = ["STRONG", "UNKNOWN", "MODERATE", "POOR"]
#: Named intervals in seconds (fixed values; a month is thirty days).
INTERVALS = {"1d": 86_400, "3d": 259_200, "1w": 604_800, "1m": 2_592_000}


def redundancy(count: Column, complete: Column) -> Column:
    """RUL-01/02: none or incomplete: UNKNOWN; one: MODERATE; more: STRONG."""
    return F.when(~complete | count.isNull() | (count == 0), "UNKNOWN").when(count <= 1, "MODERATE").otherwise("STRONG")


def external_routing(border_routers: Column, with_address: Column) -> Column:
    """RUL-03: a border router with an address: STRONG; border routers without: MODERATE."""
    return F.when(with_address > 0, "STRONG").when(border_routers > 0, "MODERATE").otherwise("UNKNOWN")


def path_redundancy(routers: Column, edges: Column, cuts: Column) -> Column:
    """RUL-04: bridges or articulation points: MODERATE."""
    return F.when((routers < 2) | (edges == 0), "UNKNOWN").when(cuts > 0, "MODERATE").otherwise("STRONG")


def link_quality(good: Column, bad: Column) -> Column:
    """RUL-05: few good or many bad links: MODERATE."""
    return F.when(good.isNull() | bad.isNull(), "UNKNOWN").when((good < 0.60) | (bad >= 0.20), "MODERATE").otherwise("STRONG")


def offline_impact(offline: Column, expected: Column) -> Column:
    """RUL-06: more than 15 percent offline: POOR."""
    return F.when(expected.isNull() | (expected == 0), "UNKNOWN").when(offline / expected > 0.15, "POOR").otherwise("STRONG")


def partitions(count: Column, dominant_share: Column) -> Column:
    """RUL-07: one partition: STRONG; a dominant one: MODERATE; else POOR."""
    return F.when(count.isNull() | (count == 0), "UNKNOWN").when(count == 1, "STRONG").when(dominant_share >= 0.75, "MODERATE").otherwise("POOR")


def graded(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """RUL-15..19, RUL-23: the name of the highest band that the value reaches."""
    out = None
    for bound, name in sorted(bands, reverse=True):
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(otherwise)


def directional(quality_in: Column, quality_out: Column, error: Column, sole_path: Column) -> Column:
    """RUL-21/22: both directions best and no defect: STRONG; critical delivery on a sole path: POOR; any defect: MODERATE."""
    fine = (quality_in == 3) & (quality_out == 3) & (F.coalesce(error, F.lit(0.0)) < 0.05)
    critical = (error >= 0.09) & sole_path
    return F.when(F.coalesce(fine, F.lit(False)), "STRONG").when(F.coalesce(critical, F.lit(False)), "POOR").otherwise("MODERATE")


def reasons(*conditions: tuple[Column, str]) -> Column:
    """CMP-01/02: the codes of all conditions that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in conditions]), lambda x: x.isNotNull())


def numeric_change(before: Column, after: Column, kind: str, higher_is_better: bool) -> tuple[Column, Column]:
    """CMP-03: the change (ratios in points) and whether it is an improvement."""
    change = (after - before) * (100 if kind == "ratio" else 1)
    better, worse = ("improved", "worsened") if higher_is_better else ("worsened", "improved")
    return change, F.when(change.isNull(), "unknown").when(change > 0, better).when(change < 0, worse).otherwise("unchanged")


def discrete_change(before: Column, after: Column) -> Column:
    """CMP-04: the transition of a category."""
    return F.when(before.isNull() & after.isNull(), "unknown").when(before.isNull(), "appeared").when(after.isNull(), "disappeared").when(before == after, "unchanged").otherwise(F.concat(before, F.lit("->"), after))


def single_fact(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """CMP-06/07: the value of each key that has exactly one."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")
