"""Device records and their projections; an order stands for a device's record, an event for an item of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators import devices as D
from meshlake.operators import relational as R
from meshlake.plans.catalog import register
from meshlake.sources.tables import table

#: What an order says as a device: expressions that Spark and DuckDB both take.
SAID = {
    "flat": "CASE o_orderkey % 9 WHEN 1 THEN ' ftd ' WHEN 2 THEN 'MTD' WHEN 3 THEN 'other' END",
    "nested": "CASE WHEN o_orderkey % 9 = 3 THEN 'Mtd' END",
    "flag": "CASE WHEN o_orderkey % 9 = 4 THEN o_orderstatus = 'O' END",
    "number": "CASE WHEN o_orderkey % 9 = 5 THEN o_custkey % 2 END",
    "role": "CASE o_orderkey % 11 WHEN 1 THEN 'Router' WHEN 2 THEN ' child' WHEN 3 THEN 'Leader' WHEN 4 THEN '' WHEN 5 THEN 'sleepy-child' END",
    "type": "CASE o_orderkey % 7 WHEN 1 THEN 'border router' WHEN 2 THEN 'Sleepy Child' WHEN 3 THEN 'lamp' END",
    "rloc16": "CASE WHEN o_orderkey % 4 = 0 THEN '0x1C00' WHEN o_orderkey % 4 = 1 THEN '0x1c05' WHEN o_orderkey % 8 = 2 THEN 'none' END",
    "is_router": "CASE o_orderkey % 13 WHEN 1 THEN true WHEN 2 THEN false END",
    "is_leader": "CASE WHEN o_orderkey % 13 = 3 THEN o_orderstatus = 'F' END",
    "is_border_router": "CASE WHEN o_orderkey % 13 = 4 THEN o_orderstatus = 'F' END",
    "total_children": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 END",
}
DEVICES = f"SELECT o_orderkey, {', '.join(f'{x} AS {c}' for c, x in SAID.items())} FROM orders"


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    return table(spark, sf_dir, "orders").select("o_orderkey", *(F.expr(x).alias(c) for c, x in SAID.items())), {c: F.col(c) for c in SAID}


MODE = """CASE WHEN upper(trim(flat)) IN ('FTD', 'MTD') THEN upper(trim(flat)) WHEN upper(trim(nested)) IN ('FTD', 'MTD') THEN upper(trim(nested)) WHEN flag IS NOT NULL THEN CASE WHEN flag THEN 'FTD' ELSE 'MTD' END
    WHEN number IS NOT NULL THEN CASE WHEN number <> 0 THEN 'FTD' ELSE 'MTD' END WHEN lower(trim(role)) IN ('router', 'border router') THEN 'FTD' WHEN lower(trim(role)) = 'child' THEN 'MTD'
    WHEN lower(trim(type)) IN ('router', 'border router') THEN 'FTD' WHEN contains(lower(type), 'child') THEN 'MTD' END"""


@register("prj14_mode_device", f"SELECT o_orderkey, {MODE} AS mode_device FROM ({DEVICES})")
def prj14_mode_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14: full or minimal device by the first of six kinds of evidence that tells."""
    rows, record = records(spark, sf_dir)
    return rows.select("o_orderkey", D.mode_device(record).alias("mode_device"))


@register(
    "prj07_device_projection",
    f"""WITH d AS (SELECT *, {MODE} AS mode_device, lower(coalesce(rloc16, '')) AS r, lower(trim(coalesce(role, ''))) AS ro FROM ({DEVICES})), n AS (SELECT l_orderkey, COUNT(*) FILTER (l_returnflag = 'R') AS a, COUNT(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, r AS rloc16, coalesce(mode_device, 'unknown') AS device_type, CASE WHEN is_router IS NOT NULL THEN is_router WHEN ro <> '' THEN ro IN ('router', 'leader') ELSE starts_with(r, '0x') AND ends_with(r, '00') AND length(r) = 6 END AS is_router,
    coalesce(is_leader, ro = 'leader') AS is_leader, coalesce(is_border_router, false) AS is_border_router, CASE WHEN is_router IS NOT NULL OR ro <> '' THEN 'explicit' WHEN r LIKE '0x__00' THEN 'rloc16-derived' ELSE 'none' END AS role_evidence,
    coalesce(total_children, 0) AS total_children, coalesce(a, 0) AS n_neighbors, coalesce(b, 0) AS n_children FROM d LEFT JOIN n ON l_orderkey = o_orderkey""",
)
def prj07_device_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-07: devices as every view shows them, with the evidence of their roles and the sizes of their relationships."""
    rows, record = records(spark, sf_dir)
    entries = lambda where: F.collect_list(F.when(F.expr(where), F.col("l_linenumber")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(entries("l_returnflag = 'R'").alias("neighbors"), entries("l_linestatus = 'O'").alias("children"))
    rows = rows.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    found = D.projection(record | {"mode_device": D.mode_device(record)}, {c: F.col(c) for c in ("neighbors", "children")})
    return rows.select("o_orderkey", *(c.alias(name) for name, c in found.items()))


@register(
    "flt13_eligible",
    f"""SELECT o_orderkey FROM ({DEVICES}) WHERE regexp_full_match(coalesce(rloc16, ''), '0[xX][0-9a-fA-F]{{4}}') OR coalesce(is_border_router, false)
    OR lower(trim(coalesce(type, ''))) IN ('router', 'border router', 'child', 'sleepy-child', 'sleepy child') OR lower(trim(coalesce(role, ''))) IN ('router', 'border router', 'child', 'sleepy-child', 'sleepy child')""",
)
def flt13_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13: the records that belong to the mesh."""
    rows, record = records(spark, sf_dir)
    return rows.where(D.eligible(record)).select("o_orderkey")


@register(
    "srt05_derived_order",
    """WITH i AS (SELECT event_id, concat(CASE WHEN user_id % 2 = 0 THEN 'U' ELSE 'u' END, user_id) AS subject, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'link' ELSE '' END AS relationship, CASE WHEN event_id % 5 > 0 THEN 'm' ELSE '' END AS metric, user_id % 7 AS samples FROM events)
    SELECT event_id, row_number() OVER (ORDER BY kind DESC, relationship DESC, metric DESC, samples DESC, subject DESC, event_id DESC) AS evidence_down, row_number() OVER (ORDER BY lower(subject), subject, kind, metric, event_id) AS subject_up FROM i""",
)
def srt05_derived_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: places of derived comparison items by evidence, descending as a whole, and by subject."""
    subject = F.concat(F.when(F.col("user_id") % 2 == 0, "U").otherwise("u"), F.col("user_id").cast("string"))
    item = {"scope": F.lit("device"), "subject": subject, "kind": F.col("event_type"), "relationship": F.when(F.col("event_id") % 3 == 0, "link"), "metric": F.when(F.col("event_id") % 5 > 0, "m"), "samples": F.col("user_id") % 7, "change": F.lit("none"), "id": F.col("event_id")}
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows = R.placed(rows, D.derived_order(item, "evidence", True), "evidence_down")
    return R.placed(rows, D.derived_order(item, "subject", False), "subject_up").select("event_id", "evidence_down", "subject_up")
