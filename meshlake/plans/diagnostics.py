"""Diagnostic conditions over devices; an order stands for a device, and its lines for what it is linked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions.identity import bound
from meshlake.operators import conditions as C
from meshlake.plans.catalog import register
from meshlake.sources.tables import table

#: Metrics of an order's lines: Spark and SQL expressions of the same meaning.
ENTRY = {
    "neighbors": ("l_linestatus = 'F'", {"frame_errors": "l_quantity - 10", "message_errors": "l_discount * 400", "rss": "-2 * l_quantity"}),
    "children": ("l_returnflag <> 'R'", {"link_quality": "l_linenumber % 5"}),
    "child_table": ("l_linestatus = 'O'", {"frame_errors": "l_quantity - 10", "message_errors": "l_tax * 100", "rss": "-2 * l_quantity", "margin": "l_quantity + 5", "queued": "l_suppkey % 10 - 7"}),
}
ROW = {
    "mac_errors": "AVG(l_discount) * 100", "mac_discards": "ROUND(MAX(l_tax) * 100, 6)", "partition_changes": "SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)",
    "parent_changes": "COUNT(*)", "better_partition": "SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)", "all_changes": "COUNT(*) + SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)",
    "lq3_ratio": "AVG(CASE WHEN l_quantity >= 20 THEN 1.0 ELSE 0.0 END)", "lq1_ratio": "AVG(CASE WHEN l_quantity < 10 THEN 1.0 ELSE 0.0 END)",
    "router_share": "AVG(l_quantity) * 2 + 20", "detached_share": "ROUND(MIN(l_discount) * 100, 6)",
}
GUARD = "MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1"


def _measured() -> str:
    """SQL: every number a condition may test, a row each."""
    parts = [f"SELECT l_orderkey, '' AS over_, '{m}' AS metric, CAST({x} AS DOUBLE) AS x FROM lineitem GROUP BY l_orderkey" for m, x in ROW.items()]
    parts += [f"SELECT l_orderkey, '{over}', '{m}', CAST({x} AS DOUBLE) FROM lineitem WHERE {where}" for over, (where, metrics) in ENTRY.items() for m, x in metrics.items()]
    rows = ", ".join(f"({i}, '{c.name}', '{c.group}', '{c.over}', '{c.metric}', '{c.comparison}', {c.bounds()[0]}, {c.bounds()[1]}, {C.RANKS.index(c.severity)}, {bool(c.guard)})" for i, c in enumerate(C.DEVICE_CONDITIONS))
    return f"""measured AS ({" UNION ALL ".join(parts)}), guarded AS (SELECT l_orderkey, {GUARD} AS ok FROM lineitem GROUP BY l_orderkey),
    conditions(i, name, group_, over_, metric, how, low, high, rank, guard) AS (VALUES {rows}),
    tested AS (
      SELECT m.l_orderkey, c.*, CASE how WHEN '>=' THEN x >= low WHEN '>' THEN x > low WHEN '<=' THEN x <= low WHEN '<' THEN x < low WHEN '==' THEN x = low WHEN '[)' THEN x >= low AND x < high WHEN '[]' THEN x >= low AND x <= high END AS hit
      FROM measured m JOIN conditions c ON m.over_ = c.over_ AND m.metric = c.metric),
    judged AS (
      SELECT t.l_orderkey, i, name, group_, over_, rank, bool_or(hit) AND (ok OR NOT guard) AS met FROM tested t JOIN guarded g ON g.l_orderkey = t.l_orderkey
      GROUP BY t.l_orderkey, i, name, group_, over_, rank, guard, ok)"""


def evaluated(spark: SparkSession, sf_dir: str, of: Callable[[Column], Column] = lambda found: found) -> DataFrame:
    """l_orderkey and all evaluations of its conditions, or what ``of`` makes of them."""
    entries = {over: F.collect_list(F.expr(f"CASE WHEN {where} THEN struct({', '.join(f'{x} AS {m}' for m, x in metrics.items())}) END")).alias(over) for over, (where, metrics) in ENTRY.items()}
    devices = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.expr(x).alias(m) for m, x in ROW.items()), F.expr(GUARD).alias("ftd_router"), *entries.values())
    arrays = {over: (F.col(over), {m: (lambda e, m=m: e[m]) for m in metrics}) for over, (_, metrics) in ENTRY.items()}
    found = C.evaluations(C.DEVICE_CONDITIONS, {m: F.col(m) for m in ROW}, arrays, {"ftd_router": F.col("ftd_router")})
    return devices.select("l_orderkey", bound(found, of).alias("found"))


@register(
    "flt05_conditions",
    f"""WITH {_measured()}, worst AS (SELECT *, rank = MAX(rank) OVER (PARTITION BY l_orderkey, group_) AS top FROM judged WHERE met)
    SELECT l_orderkey, COUNT(*) AS met, string_agg(name, ';' ORDER BY i) FILTER (top) AS worst FROM worst GROUP BY l_orderkey""",
)
def flt05_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: all 42 conditions of a device in one pass; the met ones that are the most severe of their group."""

    def summary(found: Column) -> Column:
        worst = F.array_join(F.transform(C.worst_of_groups(found), lambda e: e["name"]), ";")
        return F.struct(F.size(F.filter(found, lambda e: e["met"])).cast("long").alias("met"), worst.alias("worst"))

    # a generator's output, so that the filter on it doesn't have the evaluations done a second time
    each = evaluated(spark, sf_dir, summary)
    return each.select("l_orderkey", F.inline(F.array("found"))).where("met > 0")


@register(
    "flt05_condition_counts",
    f"""WITH {_measured()} SELECT name, COUNT(*) FILTER (met) AS devices_met, COUNT(*) FILTER (NOT met AND over_ = '') AS devices_missed FROM judged WHERE met OR over_ = '' GROUP BY name""",
)
def flt05_condition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: how many devices meet each condition, and how many have a number and miss it (arrays are evaluated where an entry matches)."""
    each = evaluated(spark, sf_dir).select(F.explode("found").alias("e")).select("e.*")
    return each.groupBy("name").agg(F.count_if("met").alias("devices_met"), F.count_if(~F.col("met")).alias("devices_missed"))
