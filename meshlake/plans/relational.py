"""Joins, merges, windows, sets and orders bound to the star-schema tables, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.operators import relational as R
from meshlake.plans.catalog import register
from meshlake.sources.tables import table

@register(
    "jon01_inner_multi",
    """SELECT n_name, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 0) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def jon01_inner_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01: an inner join through four tables."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = (
        lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 0).alias("revenue"))


@register(
    "jon02_left_outer",
    """SELECT c_custkey, COUNT(o_orderkey) AS n_orders, ROUND(COALESCE(SUM(o_totalprice), 0), 2) AS spent
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def jon02_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02: customers with what they ordered; orders are summed before the join."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(spent, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@register(
    "jon03_semi_exists",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > (SELECT AVG(o_totalprice) FROM orders))",
)
def jon03_semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-03: customers with an order above the average."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    high = orders.crossJoin(F.broadcast(orders.agg(F.avg("o_totalprice").alias("mean")))).where("o_totalprice > mean")  # one row
    return table(spark, sf_dir, "customer").join(high, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register(
    "jon04_anti_orphans",
    """SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT 'order', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
def jon04_anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04: customers without orders and orders without a returned line."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return customers.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).union(orders.select(F.lit("order"), "o_orderkey"))


@register(
    "jon05_alias_window",
    """SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b
    ON a.event_type = b.event_type AND a.user_id < b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 5000000""",
)
def jon05_alias_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-05: events of one type by different users no more than five seconds apart."""
    events = table(spark, sf_dir, "events")
    a = events.select("event_type", F.col("event_id").alias("first_id"), F.col("user_id").alias("a_user"), F.col("ts").alias("a_ts"))
    b = events.select("event_type", F.col("event_id").alias("second_id"), F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"))
    return R.band_join(a, b, "event_type", "a_ts", "b_ts", 5).where("a_user < b_user").select("first_id", "second_id")


CUTOFFS = {"1d": 1, "3d": 3, "1w": 7, "1m": 30}


@register(
    "jon06_asof_interval",
    """WITH last AS (SELECT o_custkey, MAX(o_orderdate) AS seen FROM orders GROUP BY o_custkey), cut AS (
      SELECT o_custkey, i.name, seen - i.days * INTERVAL 1 DAY AS cutoff FROM last, (VALUES ('1d', 1), ('3d', 3), ('1w', 7), ('1m', 30)) AS i(name, days)),
    met AS (SELECT c.o_custkey, c.name, o.o_orderkey, o.o_orderdate, ROW_NUMBER() OVER (PARTITION BY c.o_custkey, c.name ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS n
      FROM cut c JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderdate <= c.cutoff)
    SELECT c.o_custkey, c.name AS interval_name, m.o_orderkey AS baseline FROM cut c LEFT JOIN met m ON m.o_custkey = c.o_custkey AND m.name = c.name AND m.n = 1""",
)
def jon06_asof_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06: of each customer the baseline order up to 1, 3, 7 and 30 days before the last one."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("interval_name"), F.lit(d * 86400).cast("long").alias("seconds")) for k, d in CUTOFFS.items()]))
    cuts = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at")).select("o_custkey", "at", names.alias("i"))
    cuts = cuts.select("o_custkey", "i.interval_name", F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp")) - F.col("i.seconds") * 1_000_000).alias("cutoff"))
    orders = orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return R.latest_before(cuts, orders, "o_custkey", "cutoff", "o_orderdate", ["o_orderkey"]).select("o_custkey", "interval_name", F.col("o_orderkey").alias("baseline"))


@register("jon07_predecessor", "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events")
def jon07_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07/WIN-03: the event before, of the same user."""
    return R.with_previous(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "previous_id").select("event_id", "previous_id")


@register(
    "jon08_band_join",
    """SELECT a.event_id AS view_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id
    AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000""",
)
def jon08_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08: events of one user within two hours of each other."""
    events = table(spark, sf_dir, "events")
    a = events.select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("a_ts"))
    b = events.select("user_id", F.col("event_id").alias("near_id"), F.col("ts").alias("b_ts"))
    return R.band_join(a, b, "user_id", "a_ts", "b_ts", 7200).where("view_id <> near_id").select("view_id", "near_id")


@register(
    "jon09_full_outer_change",
    """WITH q AS (SELECT l_partkey, year(l_shipdate) AS y, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    a AS (SELECT l_partkey, q FROM q WHERE y = 1995), b AS (SELECT l_partkey, q FROM q WHERE y = 1996)
    SELECT COALESCE(a.l_partkey, b.l_partkey) AS l_partkey, a.q AS before, b.q AS after, b.q - a.q AS change,
    CASE WHEN a.q IS NULL THEN 'appeared' WHEN b.q IS NULL THEN 'disappeared' WHEN b.q > a.q THEN 'increased' WHEN b.q < a.q THEN 'decreased' ELSE 'unchanged' END AS kind
    FROM a FULL JOIN b ON a.l_partkey = b.l_partkey""",
)
def jon09_full_outer_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09/CMP-03: quantities of each part in two years, with the kind of change."""
    q = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))
    return R.outer_change(q.where("y = 1995").drop("y"), q.where("y = 1996").drop("y"), ["l_partkey"], "q")


@register(
    "jon10_fallback_lookup",
    """SELECT l_orderkey, l_linenumber, COALESCE(s.s_name, c.c_name) AS label FROM lineitem
    LEFT JOIN supplier s ON s.s_suppkey = l_suppkey AND s.s_acctbal > 0 LEFT JOIN customer c ON c.c_custkey = l_suppkey""",
)
def jon10_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10: a label by the first key, else by the second."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    first = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    second = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l_suppkey"), "c_name")
    return lines.join(first, "l_suppkey", "left").join(second, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("s_name", "c_name").alias("label"))


@register(
    "jon11_unique_only",
    """WITH k AS (SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS n, MIN(l_suppkey) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
    SELECT p_partkey, CASE WHEN n = 1 THEN s END AS l_suppkey, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS l_suppkey_state
    FROM part LEFT JOIN k ON l_partkey = p_partkey""",
)
def jon11_unique_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-11: a part's supplier of large lines where there is exactly one."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return R.unique_only(table(spark, sf_dir, "part").select("p_partkey"), lines, "p_partkey", "l_suppkey")


@register(
    "jon12_label_precedence",
    """SELECT id, arg_max(label, rank) AS label FROM (SELECT s_suppkey AS id, s_name AS label, 30 AS rank FROM supplier WHERE s_acctbal > 0
    UNION ALL SELECT c_custkey, c_name, 20 FROM customer WHERE c_acctbal > 0 UNION ALL SELECT p_partkey, p_name, 10 FROM part) GROUP BY id""",
)
def jon12_label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-12/AGG-27: the label of the source with the highest rank."""
    sources = (
        table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS id", "s_name AS label", "30 AS rank")
        .union(table(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("c_custkey", "c_name", "20"))
        .union(table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "10"))
    )
    return sources.groupBy("id").agg(F.max_by("label", "rank").alias("label"))


@register(
    "jon14_hierarchy",
    """SELECT c.event_id AS child, p.event_id AS parent FROM events c JOIN events p ON (c.event_id >> 10) = (p.event_id >> 10) AND (p.event_id & 1023) = 0 AND (c.event_id & 1023) <> 0""",
)
def jon14_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-14: children under the router whose upper bits they share."""
    events = table(spark, sf_dir, "events").select("event_id")
    low, block = F.col("event_id").bitwiseAND(F.lit(1023)), F.shiftright("event_id", 10)
    parents = events.where(low == 0).select(block.alias("block"), F.col("event_id").alias("parent"))
    return events.where(low != 0).select(block.alias("block"), F.col("event_id").alias("child")).join(parents, "block").select("child", "parent")


@register(
    "agg02_conditional_max",
    """SELECT o_custkey, epoch_us(MAX(o_orderdate)) AS last_seen, MAX(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS any_f FROM orders GROUP BY o_custkey""",
)
def agg02_conditional_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02: when each customer was last seen, and whether with a condition."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.unix_micros(F.max(F.col("o_orderdate").cast("timestamp"))).alias("last_seen"), F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("any_f"))


@register(
    "agg03_precedence_merge",
    """WITH s AS (SELECT s_suppkey AS id, s_name AS name, NULL AS segment, 20 AS rank FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment, 10 FROM customer)
    SELECT id, arg_max(name, rank) AS name, CAST(COUNT(DISTINCT name) > 1 AS INTEGER) AS name_conflict, arg_max(segment, rank) AS segment, CAST(COUNT(DISTINCT segment) > 1 AS INTEGER) AS segment_conflict FROM s GROUP BY id""",
)
def agg03_precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: fields merged by source rank, gaps filled from lower ranks, disagreements counted."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "CAST(NULL AS STRING) AS segment", "20 AS rank")
    return R.merge_by_rank(rows.union(table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "10")), "id", ["name", "segment"], "rank")


@register("agg04_text_union", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def agg04_text_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04/05: distinct texts of a key, in order."""
    return R.union_text(table(spark, sf_dir, "events"), ["user_id"], "event_type", "types")


@register(
    "agg06_bounded_conflicts",
    """SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS conflicts FROM (SELECT DISTINCT user_id, event_type, DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM events) WHERE n <= 3 GROUP BY user_id""",
)
def agg06_bounded_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: at most a few distinct entries of a key (the bound is the feature)."""
    return R.union_text(table(spark, sf_dir, "events"), ["user_id"], "event_type", "conflicts", limit=3)


@register(
    "agg11_derived_counters",
    """SELECT l_orderkey, SUM(l_quantity) AS total, CASE WHEN SUM(l_quantity) > 0 THEN FLOOR(1000 * SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / SUM(l_quantity)) / 10 END AS returned_percent FROM lineitem GROUP BY l_orderkey""",
)
def agg11_derived_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: totals, and a ratio only where its denominator is positive."""
    total, returned = F.sum("l_quantity"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(total.alias("total"), F.when(total > 0, F.floor(1000 * returned / total) / 10).alias("returned_percent"))


@register(
    "agg12_distribution_verdict",
    """WITH t AS (SELECT n_name, COUNT(*) AS n, SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS good, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name)
    SELECT n_name, n, ROUND(good / n, 6) AS good_share, ROUND(bad / n, 6) AS bad_share, CASE WHEN good / n < 0.6 OR bad / n >= 0.2 THEN 'MODERATE' ELSE 'STRONG' END AS verdict FROM t""",
)
def agg12_distribution_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12/RUL-05: shares of quality classes and the verdict of their thresholds."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t = lines.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey")).join(nations, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name")
    t = t.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("l_returnflag") == f, F.col("n")).otherwise(0)).alias(k) for f, k in (("N", "good"), ("R", "bad"))])
    good, bad = F.col("good") / F.col("n"), F.col("bad") / F.col("n")
    verdict = F.when((good < 0.6) | (bad >= 0.2), "MODERATE").otherwise("STRONG")
    return t.select("n_name", "n", F.round(good, 6).alias("good_share"), F.round(bad, 6).alias("bad_share"), verdict.alias("verdict"))


@register(
    "agg14_dominant",
    """SELECT c_custkey, arg_min(o_orderstatus, (-n, o_orderstatus)) AS dominant, ROUND(MAX(n) / SUM(n), 6) AS ratio FROM (SELECT o_custkey AS c_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2) GROUP BY c_custkey""",
)
def agg14_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: the most frequent value of a key, the lower one of equals, and its share."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").agg(F.count("*").alias("n"))
    return n.groupBy("c_custkey").agg(F.min_by("o_orderstatus", F.struct(-F.col("n"), "o_orderstatus")).alias("dominant"), F.round(F.max("n") / F.sum("n"), 6).alias("ratio"))


@register(
    "agg15_child_parents",
    "SELECT l_partkey AS child, COUNT(DISTINCT l_suppkey) AS parents, COUNT(DISTINCT l_suppkey) = 1 AS sole_path FROM lineitem GROUP BY l_partkey",
)
def agg15_child_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: how many parents each child has, and whether there is but one."""
    n = F.count_distinct("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("child")).agg(n.alias("parents"), (n == 1).alias("sole_path"))


@register(
    "agg16_multiple_reporters",
    "SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS reporters FROM lineitem WHERE l_discount >= 0.09 GROUP BY l_suppkey HAVING COUNT(DISTINCT l_partkey) >= 2",
)
def agg16_multiple_reporters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16/RUL-14: targets of which two or more report a high error."""
    return table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("reporters")).where("reporters >= 2")


@register(
    "agg17_worst_of",
    """WITH s AS (SELECT n_regionkey, CASE WHEN c_acctbal < -500 THEN 3 WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS level FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT r_name, CASE MAX(level) WHEN 3 THEN 'POOR' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'STRONG' ELSE 'UNKNOWN' END AS verdict, COUNT(level) AS n FROM region LEFT JOIN s ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def agg17_worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: the worst status of each region, unknown without evidence."""
    level = F.when(F.col("c_acctbal") < -500, 3).when(F.col("c_acctbal") < 0, 2).otherwise(1)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    worst = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max(level).alias("level"), F.count("*").alias("n")).join(nations, "c_nationkey").groupBy("r_regionkey").agg(F.max("level").alias("level"), F.sum("n").alias("n"))
    verdict = F.when(F.col("level") == 3, "POOR").when(F.col("level") == 2, "MODERATE").when(F.col("level") == 1, "STRONG").otherwise("UNKNOWN")
    return table(spark, sf_dir, "region").join(worst, "r_regionkey", "left").select("r_name", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"))


@register(
    "agg18_evidence_counts",
    "SELECT l_shipmode_year AS y, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open, COUNT(*) AS n FROM (SELECT year(l_shipdate) AS l_shipmode_year, * FROM lineitem) GROUP BY 1",
)
def agg18_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18/25: conditional counts, zero where nothing meets the condition."""
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count("*").alias("n"))


@register(
    "agg19_finding_groups",
    """WITH g AS (SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS status, MIN(value) AS confidence, COUNT(*) AS n FROM events GROUP BY 1, 2)
    SELECT DISTINCT g.event_type, g.status, e.user_id AS subject, g.confidence, g.n FROM events e JOIN g ON g.event_type = e.event_type AND g.status = CASE WHEN e.value > 50 THEN 'high' ELSE 'low' END""",
)
def agg19_finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: findings grouped by rule and status with least confidence and count, and a row for each subject of a group.

    Two levels of aggregation: subjects are counted first, so a group of any size is a few rows when it meets its subjects.
    """
    status = F.when(F.col("value") > 50, "high").otherwise("low")
    subjects = table(spark, sf_dir, "events").groupBy("event_type", status.alias("status"), F.col("user_id").alias("subject")).agg(F.min("value").alias("least"), F.count("*").alias("m"))
    groups = subjects.groupBy("event_type", "status").agg(F.min("least").alias("confidence"), F.sum("m").alias("n"))
    return subjects.join(groups, ["event_type", "status"]).select("event_type", "status", "subject", "confidence", "n")


@register(
    "agg28_best_fact",
    "SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS o_orderpriority, COUNT(DISTINCT o_orderpriority) > 1 AS disagreement FROM orders GROUP BY o_custkey",
)
def agg28_best_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-28: the fact of the highest rank, then key, and whether facts disagree."""
    return R.best_fact(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["o_totalprice", "o_orderkey"])


@register(
    "agg29_lineage",
    """WITH w AS (SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS p FROM orders GROUP BY 1)
    SELECT o.o_custkey, w.p AS winner, COUNT(*) AS contributors, MIN(o.o_orderkey) AS first_contributor FROM orders o JOIN w ON w.o_custkey = o.o_custkey AND w.p = o.o_orderpriority GROUP BY 1, 2""",
)
def agg29_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29: who contributed the winning value of each key; per-value counts come first, so it needs one shuffle of rows."""
    orders = table(spark, sf_dir, "orders")
    by_value = orders.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_totalprice", "o_orderkey")).alias("top"), F.count("*").alias("contributors"), F.min("o_orderkey").alias("first_contributor"))
    best = by_value.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderpriority", "contributors", "first_contributor"), "top").alias("w"))
    return best.select("o_custkey", F.col("w.o_orderpriority").alias("winner"), "w.contributors", "w.first_contributor")


@register(
    "agg30_digest",
    "SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_custkey",
)
def agg30_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30/CMP-09: a digest over the ordered entries of a key."""
    entries = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("t"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(entries, lambda x: x["t"]), "\n"), 256).alias("digest"))


@register(
    "win01_absence_streak",
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day, ROW_NUMBER() OVER (ORDER BY day DESC) AS n FROM d),
    f AS (SELECT user_id, MIN(n) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) JOIN r USING (day) GROUP BY user_id)
    SELECT user_id, n - 1 AS absent FROM f""",
)
def win01_absence_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01/RUL-12: for how many of the latest days each user was absent."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return R.absence_streak(events.select("day").distinct(), events, events, "user_id", "day")


@register(
    "win02_witness_groups",
    """WITH g AS (SELECT user_id, COUNT(DISTINCT CAST(ts AS DATE)) AS days, COUNT(DISTINCT (date_trunc('week', ts), event_type)) AS witnesses FROM events GROUP BY user_id) SELECT * FROM g""",
)
def win02_witness_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: observations collapsed to one for each witness before they are counted."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct(F.date_trunc("week", "ts"), "event_type").alias("witnesses"))


@register(
    "win04_counter_reset",
    """WITH p AS (SELECT event_id, value, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    SELECT event_id, CASE WHEN previous IS NULL THEN 'first' WHEN value < previous THEN 'reset-detected' ELSE 'delta' END AS kind, CASE WHEN value >= previous THEN ROUND(value - previous, 6) END AS delta FROM p""",
)
def win04_counter_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04/STR-07: counter deltas with resets told apart."""
    out = R.counter_deltas(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", "kind", F.round("delta", 6).alias("delta"))


@register(
    "win05_gaps",
    """WITH p AS (SELECT user_id, event_id, epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
    SELECT event_id, d // 1000000 AS elapsed, d > 604800000000 AS gap_exceeded FROM p WHERE d IS NOT NULL""",
)
def win05_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05/DT-F02: seconds since the event before, rounded down; the gap test is on the unrounded time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    out = table(spark, sf_dir, "events").withColumn("at", micros)
    out = R.with_previous(out, "user_id", ["at", "event_id"], "at", "before").where("before IS NOT NULL").withColumn("d", F.col("at") - F.col("before"))
    return out.select("event_id", F.floor(F.col("d") / 1_000_000).cast("long").alias("elapsed"), (F.col("d") > 604_800_000_000).alias("gap_exceeded"))


@register(
    "win06_latest_revision",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
)
def win06_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06/07: the latest row of each key, as an aggregate that combines before the shuffle."""
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x"))
    return best.select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@register("win08_retention", "SELECT event_id, user_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def win08_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: the newest five events of each user (the bound is the feature)."""
    return R.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@register("win09_occurrence", "SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS occurrence FROM documents")
def win09_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09: the how-manieth copy of its text a document is; only digests are shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return R.occurrence(docs, ["digest"], ["doc_id"]).select("doc_id", F.col("occurrence").cast("long").alias("occurrence"))


@register(
    "win10_neighbours",
    "SELECT o_orderkey, LAG(o_orderkey) OVER w AS older, LEAD(o_orderkey) OVER w AS newer FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def win10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10: the older and the newer neighbour of each order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("older"), F.lead("o_orderkey").over(w).alias("newer"))


@register(
    "win11_freshness",
    """WITH n AS (SELECT MAX(ts) AS now FROM events), l AS (SELECT user_id, MAX(ts) AS seen FROM events GROUP BY user_id)
    SELECT c_custkey, CASE WHEN seen IS NULL THEN 'absent' WHEN epoch_us(now) - epoch_us(seen) <= 86400000000 THEN 'fresh' ELSE 'stale' END AS state FROM customer CROSS JOIN n LEFT JOIN l ON user_id = c_custkey""",
)
def win11_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: fresh, stale or absent by the age of the last event."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    last = events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("at").alias("at"))
    now = events.agg(F.max("at").alias("now"))  # one row
    out = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").crossJoin(F.broadcast(now))
    return out.select("c_custkey", F.when(F.col("at").isNull(), "absent").when(F.col("now") - F.col("at") <= 86_400_000_000, "fresh").otherwise("stale").alias("state"))


@register("srt01_missing_last", "SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS place FROM customer")
def srt01_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01: the place of every row in an order with missing values last."""
    value = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", value.alias("v"))
    return R.placed(rows, [*R.missing_last(F.col("v"), True), F.col("c_custkey").asc()]).select("c_custkey", "place")


@register("srt02_natural_order", "SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY CAST(p_size AS INTEGER), p_partkey) AS place FROM part")
def srt02_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02: the place of every part in natural order of a text with digits."""
    parts = table(spark, sf_dir, "part").select("p_partkey", R.natural_key(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("k"))
    return R.placed(parts, [F.col("k").asc(), F.col("p_partkey").asc()]).select("p_partkey", "place")


@register("srt06_finding_order", "SELECT event_type, event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events")
def srt06_finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06/07/08: places within a group by rank, ties by id."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(w).cast("long").alias("place"))


@register("srt09_paging", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def srt09_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-09: the third page of 100 (the page is the feature)."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(100).select("o_orderkey")


@register("srt10_pick", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY o_custkey")
def srt10_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-10: the least row of each key by a tuple."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"))


@register("set01_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01/06: distinct union."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@register("set02_union_all", "SELECT src, SUM(x) AS x FROM (SELECT 'c' AS src, c_nationkey AS x FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) GROUP BY src")
def set02_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02: a union of all rows, and the budget of each side."""
    both = table(spark, sf_dir, "customer").select(F.lit("c").alias("src"), F.col("c_nationkey").alias("x")).union(table(spark, sf_dir, "supplier").select(F.lit("s"), "s_nationkey"))
    return both.groupBy("src").agg(F.sum("x").alias("x"))


@register("set03_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def set03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03/RUL-11: expected but not observed."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "events").select("user_id"))


@register("set04_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def set04_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04: expected and observed."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf_dir, "events").select("user_id"))


@register(
    "set05_key_union",
    "SELECT COALESCE(a.k, b.k) AS k, a.k IS NOT NULL AS old, b.k IS NOT NULL AS new FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08) b ON a.k = b.k",
)
def set05_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: old and new keys together, in one aggregation of the lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40 OR l_discount > 0.08")
    return lines.groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.col("l_quantity") > 40).alias("old"), F.max(F.col("l_discount") > 0.08).alias("new"))
