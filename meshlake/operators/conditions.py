"""FLT-05: a compiler from rows of a condition table to one Column: no join, no shuffle, each metric worked out once a row.

A condition tests a number of the row itself, or the numbers that the entries of one of its arrays have (any, all, or at least so many of
them), where a guard of the row may be asked for besides. Numbers that are missing or not finite meet nothing; a condition without any number gives
no evaluation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlake.functions.identity import bound

COMPARE: dict[str, Callable[[Column, float, float], Column]] = {
    ">=": lambda x, low, high: x >= low,
    ">": lambda x, low, high: x > low,
    "<=": lambda x, low, high: x <= high,
    "<": lambda x, low, high: x < high,
    "==": lambda x, low, high: x == low,
    "!=": lambda x, low, high: x != low,
    "[)": lambda x, low, high: (x >= low) & (x < high),
    "[]": lambda x, low, high: (x >= low) & (x <= high),
}
RANKS = ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Condition:
    """over: the array whose entries have the metric, empty for the row itself; how: any, all, or a number of entries."""

    name: str
    group: str
    over: str
    metric: str
    comparison: str
    threshold: float | tuple[float, float]
    severity: str
    guard: str = ""
    how: str | int = "any"

    def bounds(self) -> tuple[float, float]:
        return self.threshold if isinstance(self.threshold, tuple) else (self.threshold, self.threshold)

    def checked(self) -> Condition:
        if self.comparison not in COMPARE or self.severity not in RANKS or not all(map(math.isfinite, self.bounds())):
            raise ValueError(f"not a condition: {self}")
        if not (self.how in ("any", "all") or isinstance(self.how, int) and self.how > 0) or self.how != "any" and not self.over:
            raise ValueError(f"{self.name}: how many entries is a matter of arrays, any, all or a number above 0")
        return self


#: The conditions' names, groups, thresholds and severities.
DEVICE_CONDITIONS = [
    Condition("mac-total-errors-ratio-medium", "Mac Total Errors Ratio", "", "mac_errors", ">=", 1, "medium"),
    Condition("mac-total-errors-ratio-high", "Mac Total Errors Ratio", "", "mac_errors", ">=", 5, "high"),
    Condition("mac-total-discards-ratio-medium", "Mac Total Discards Ratio", "", "mac_discards", ">=", 2, "medium"),
    Condition("mac-total-discards-ratio-high", "Mac Total Discards Ratio", "", "mac_discards", ">=", 8, "high"),
    Condition("medium-partition-changes", "Mle Partition Changes", "", "partition_changes", ">=", 2, "medium"),
    Condition("high-partition-changes", "Mle Partition Changes", "", "partition_changes", ">=", 5, "high"),
    Condition("medium-parent-changes", "MLE Parent Changes", "", "parent_changes", ">=", 2, "medium"),
    Condition("high-parent-changes", "MLE Parent Changes", "", "parent_changes", ">=", 5, "high"),
    Condition("mle-better-partition-medium", "Mle Better Partition Attach", "", "better_partition", ">=", 2, "medium"),
    Condition("mle-better-partition-high", "Mle Better Partition Attach", "", "better_partition", ">=", 5, "high"),
    Condition("mle-total-parent-partition-medium", "Mle Total Parent Partition Changes", "", "all_changes", ">=", 3, "medium"),
    Condition("mle-total-parent-partition-high", "Mle Total Parent Partition Changes", "", "all_changes", ">=", 8, "high"),
    Condition("router-neighbor-err-rate-frame-low", "Router Neighbor Err Rate Frame", "neighbors", "frame_errors", ">=", 2, "low"),
    Condition("router-neighbor-err-rate-frame-medium", "Router Neighbor Err Rate Frame", "neighbors", "frame_errors", ">=", 5, "medium"),
    Condition("router-neighbor-err-rate-frame-high", "Router Neighbor Err Rate Frame", "neighbors", "frame_errors", ">=", 10, "high"),
    Condition("router-neighbor-err-rate-frame-critical", "Router Neighbor Err Rate Frame", "neighbors", "frame_errors", ">=", 30, "critical"),
    Condition("router-neighbor-err-rate-msg-low", "Router Neighbor Err Rate Msg", "neighbors", "message_errors", ">=", 2, "low"),
    Condition("router-neighbor-err-rate-msg-medium", "Router Neighbor Err Rate Msg", "neighbors", "message_errors", ">=", 5, "medium"),
    Condition("router-neighbor-err-rate-msg-high", "Router Neighbor Err Rate Msg", "neighbors", "message_errors", ">=", 10, "high"),
    Condition("router-neighbor-err-rate-msg-critical", "Router Neighbor Err Rate Msg", "neighbors", "message_errors", ">=", 30, "critical"),
    Condition("router-neighbor-rss-very-low", "Router Neighbor RSS Ave", "neighbors", "rss", "<", -80, "critical"),
    Condition("router-neighbor-rss-low", "Router Neighbor RSS Ave", "neighbors", "rss", "[)", (-80, -70), "medium"),
    Condition("router-neighbor-rss-medium", "Router Neighbor RSS Ave", "neighbors", "rss", "[]", (-70, -60), "low"),
    Condition("router-neighbor-rss-high", "Router Neighbor RSS Ave", "neighbors", "rss", ">", -60, "info"),
    Condition("low-lq3-ratio-medium", "Router Link Quality Distribution", "", "lq3_ratio", "<", 0.6, "medium"),
    Condition("low-lq3-ratio-high", "Router Link Quality Distribution", "", "lq3_ratio", "<", 0.35, "high"),
    Condition("high-lq1-ratio-medium", "Router Link Quality Distribution", "", "lq1_ratio", ">=", 0.2, "medium"),
    Condition("high-lq1-ratio-high", "Router Link Quality Distribution", "", "lq1_ratio", ">=", 0.35, "high"),
    Condition("child-lq-medium", "Children Link Quality", "children", "link_quality", "<=", 2, "medium"),
    Condition("child-lq-poor", "Children Link Quality", "children", "link_quality", "==", 1, "high"),
    Condition("router-child-err-rate-frame-medium", "Router Child Err Rate Frame", "child_table", "frame_errors", ">=", 10, "medium"),
    Condition("router-child-err-rate-frame-high", "Router Child Err Rate Frame", "child_table", "frame_errors", ">=", 25, "high"),
    Condition("router-child-err-rate-msg-low", "Router Child Err Rate Msg", "child_table", "message_errors", ">=", 1, "low"),
    Condition("router-child-err-rate-msg-high", "Router Child Err Rate Msg", "child_table", "message_errors", ">=", 5, "high"),
    Condition("router-child-rss-very-low", "Router Child RSS Ave", "child_table", "rss", "<", -80, "critical"),
    Condition("router-child-rss-low", "Router Child RSS Ave", "child_table", "rss", "[)", (-80, -70), "medium"),
    Condition("router-child-rss-margin-low", "Router Child RSS Margin", "child_table", "margin", "<", 20, "medium"),
    Condition("router-child-has-queued-msgs", "Router Child Queued Messages", "child_table", "queued", ">", 0, "medium"),
    Condition("ftd-router-pct-low", "Time FTD Router Uptime", "", "router_share", "<", 80, "medium", guard="ftd_router"),
    Condition("ftd-router-pct-very-low", "Time FTD Router Uptime", "", "router_share", "<", 50, "high", guard="ftd_router"),
    Condition("detached-disabled-pct-medium", "Time Detached Disabled", "", "detached_share", ">=", 1, "medium"),
    Condition("detached-disabled-pct-high", "Time Detached Disabled", "", "detached_share", ">=", 5, "high"),
]


def finite(c: Column) -> Column:
    """A number as double; null if it is missing or not finite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def evaluations(conditions: Sequence[Condition], row: Mapping[str, Column], arrays: Mapping[str, tuple[Column, Mapping[str, Callable[[Column], Column]]]], guards: Mapping[str, Column]) -> Column:
    """An array of (name, group, severity, rank, metric, met), one for each condition that has a number to test, in the order of the table.

    row: metrics of the row; arrays: an array and the metrics of its entries; guards: conditions that must hold besides. metric is the number that decides: the least of
    the matching ones where small ones match, else the greatest.
    """
    for names in (conditions, RANKS):
        if len({getattr(c, "name", c) for c in names}) < len(names):
            raise ValueError("conditions have names of their own")
    used = dict.fromkeys((c.checked().over, c.metric) for c in conditions)
    names = {key: f"m{i}" for i, key in enumerate(used)}

    def numbers(over: str, metric: str) -> Column:
        if not over:
            return finite(row[metric])
        entries, metrics = arrays[over]
        return F.filter(F.transform(entries, lambda x: finite(metrics[metric](x))), lambda x: x.isNotNull())

    shared = F.struct(*(numbers(*key).alias(name) for key, name in names.items()), *(F.coalesce(g, F.lit(False)).alias(f"g_{name}") for name, g in guards.items()))

    def evaluation(c: Condition, at: Column) -> Column:
        given, (low, high) = at[names[c.over, c.metric]], c.bounds()

        def found(metric: Column, met: Column) -> Column:
            met = met & at[f"g_{c.guard}"] if c.guard else met
            return F.struct(F.lit(c.name).alias("name"), F.lit(c.group).alias("group"), F.lit(c.severity).alias("severity"), F.lit(RANKS.index(c.severity)).alias("rank"), metric.alias("metric"), met.alias("met"))

        def of_entries(matching: Column) -> Column:
            metric = (F.array_min if c.comparison in ("<", "<=", "[)", "[]") else F.array_max)(matching)
            met = F.size(matching) >= c.how if isinstance(c.how, int) else F.lit(c.how == "any") | (F.size(matching) == F.size(given))
            return F.when(F.size(matching) > 0, found(metric, met))

        if c.over:
            return bound(F.filter(given, lambda x: COMPARE[c.comparison](x, low, high)), of_entries)
        return F.when(given.isNotNull(), found(given, F.coalesce(COMPARE[c.comparison](given, low, high), F.lit(False))))

    # every condition reads the same values
    every = bound(shared, lambda at: F.array(*(evaluation(c, at) for c in conditions)))
    return F.filter(every, lambda x: x.isNotNull())


def worst_of_groups(found: Column) -> Column:
    """FLT-07: the evaluations that are met and no less severe than any other met one of their group."""

    def worst(at: Column) -> Column:
        return F.filter(at, lambda e: ~F.exists(at, lambda o: (o["group"] == e["group"]) & (o["rank"] > e["rank"])))

    return bound(F.filter(found, lambda e: e["met"]), worst)
