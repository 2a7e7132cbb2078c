"""Further operators of projection, filtering, merging, evidence and sinks, bound to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions import network as N
from meshlake.functions import values as V
from meshlake.functions.identity import bound
from meshlake.operators import graph as G
from meshlake.operators import relational as R
from meshlake.operators import rules as U
from meshlake.plans.catalog import register
from meshlake.sources.tables import table

# --- projections


@register(
    "prj02_camel_keys",
    """SELECT p_partkey, parts[1] || array_to_string(list_transform(parts[2:], lambda x: upper(x[1]) || x[2:]), '') AS key FROM (SELECT p_partkey, string_split('mac_' || replace(lower(p_type), ' ', '_'), '_') AS parts FROM part)""",
)
def prj02_camel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02/03: keys folded to camel case."""
    raw = F.concat(F.lit("mac_"), F.regexp_replace(F.lower("p_type"), " ", "_"))
    return table(spark, sf_dir, "part").select("p_partkey", N.camel(raw).alias("key"))


@register(
    "prj06_flatten_entries",
    "SELECT event_id, 'props.k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, 'type', event_type FROM events",
)
def prj06_flatten_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04/06: nested values as path and value pairs; missing ones give no pair."""
    pairs = F.map_from_arrays(F.array(F.lit("props.k"), F.lit("type")), F.array(F.get_json_object("props", "$.k"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(pairs).alias("path", "value")).where("value IS NOT NULL")


@register(
    "prj09_leader",
    """WITH l AS (SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS leader FROM supplier GROUP BY 1)
    SELECT s_suppkey, s_suppkey = leader AS derived, CASE WHEN s_suppkey % 5 = 0 THEN FALSE ELSE s_suppkey = leader END AS is_leader, s_suppkey % 5 = 0 AND s_suppkey = leader AS conflict FROM supplier JOIN l USING (s_nationkey)""",
)
def prj09_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09..11: a derived role, which an explicit statement overrules; the disagreement is kept."""
    s = table(spark, sf_dir, "supplier")
    leaders = s.groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("leader"))
    derived, explicit = F.col("s_suppkey") == F.col("leader"), F.when(F.col("s_suppkey") % 5 == 0, False)
    out = s.join(leaders, "s_nationkey")
    return out.select("s_suppkey", derived.alias("derived"), F.coalesce(explicit, derived).alias("is_leader"), (explicit.isNotNull() & (explicit != derived)).alias("conflict"))


@register(
    "prj15_route_coverage",
    "SELECT l_orderkey, COUNT(*) <= 63 AND COUNT(*) = COUNT(DISTINCT l_suppkey) AS covered, COUNT(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY l_orderkey",
)
def prj15_route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-15: whether a route table is valid: few and unique targets."""
    n = F.count_distinct("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(((F.count("*") <= 63) & (F.count("*") == n)).alias("covered"), n.alias("targets"))


# --- filters

MODES_SQL = "(VALUES ('all'), ('border'), ('main'), ('reed')) AS m(mode)"


@register(
    "flt01_node_modes",
    f"""SELECT mode, s_suppkey FROM supplier CROSS JOIN {MODES_SQL} WHERE mode = 'all' OR (mode = 'border' AND s_acctbal > 8000) OR (mode = 'main' AND s_suppkey % 4 = 0) OR (mode = 'reed' AND s_acctbal < 0)""",
)
def flt01_node_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01: the modes that each node passes, in one scan."""
    modes = F.array(F.lit("all"), F.when(F.col("s_acctbal") > 8000, "border"), F.when(F.col("s_suppkey") % 4 == 0, "main"), F.when(F.col("s_acctbal") < 0, "reed"))
    return table(spark, sf_dir, "supplier").select(F.explode(modes).alias("mode"), "s_suppkey").where("mode IS NOT NULL")


@register(
    "flt02_link_categories",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 5 THEN 1 ELSE 0 END AS level FROM lineitem WHERE l_returnflag IN ('A', 'R') OR l_linestatus = 'O'",
)
def flt02_link_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02: links with any of some categories, and their quality level."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R') OR l_linestatus = 'O'").select("l_orderkey", "l_linenumber", V.banded("l_quantity", [(40, 3), (20, 2), (5, 1)], 0).alias("level"))


@register(
    "flt11_comparison_filter",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_totalprice > 200000 THEN 'worsened' ELSE 'unchanged' END AS result FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 200000",
)
def flt11_comparison_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11/CMP-08: items by their effective result: pruned ones are unknown."""
    result = F.when(F.col("o_orderstatus") == "P", "unknown").when(F.col("o_totalprice") > 200000, "worsened").otherwise("unchanged")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P' OR o_totalprice > 200000").select("o_orderkey", result.alias("result"))


@register(
    "flt14_scope_exclusion",
    """WITH s AS (SELECT o_custkey, COUNT(DISTINCT o_orderstatus) AS n, MIN(o_orderstatus) AS status FROM orders GROUP BY 1) SELECT o_custkey, status FROM s WHERE n = 1 AND status = 'F'""",
)
def flt14_scope_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14/EVD-11: sources whose scope is the chosen one; ambiguous scopes go."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n"), F.min("o_orderstatus").alias("status"))
    return s.where("n = 1 AND status = 'F'").select("o_custkey", "status")


@register("flt17_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 OR o_orderkey = (SELECT MAX(o_orderkey) FROM orders)")
def flt17_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: a record by id, and the latest."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    latest = orders.agg(F.max("o_orderkey").alias("o_orderkey"))  # one row
    wanted = latest.union(spark.range(7, 8).select("id")).distinct()
    return orders.join(F.broadcast(wanted), "o_orderkey")


@register(
    "flt18_roster",
    """SELECT id, MAX(expected) AS expected, MAX(seen) AS seen, MAX(ordered) AS ordered FROM (SELECT c_custkey AS id, 1 AS expected, 0 AS seen, 0 AS ordered FROM customer UNION ALL SELECT user_id, 0, 1, 0 FROM events UNION ALL SELECT o_custkey, 0, 0, 1 FROM orders) GROUP BY id""",
)
def flt18_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12/18: all members of a roster with the sources that know them."""
    rows = (
        table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "1 AS expected", "0 AS seen", "0 AS ordered")
        .union(table(spark, sf_dir, "events").selectExpr("user_id", "0", "1", "0")).union(table(spark, sf_dir, "orders").selectExpr("o_custkey", "0", "0", "1"))
    )
    return rows.groupBy("id").agg(*[F.max(c).alias(c) for c in ("expected", "seen", "ordered")])


# --- joins


@register(
    "jon13_placeholders",
    "SELECT DISTINCT user_id, COALESCE(c_name, 'unresolved:' || CAST(user_id AS VARCHAR)) AS node, c_name IS NULL AS placeholder FROM events LEFT JOIN customer ON c_custkey = user_id",
)
def jon13_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-13: referenced devices, with a made-up node where none is known."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    out = users.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left")
    return out.select("user_id", F.coalesce("c_name", F.concat(F.lit("unresolved:"), F.col("user_id").cast("string"))).alias("node"), F.col("c_name").isNull().alias("placeholder"))


@register(
    "jon15_prefixes",
    "SELECT c_custkey, printf('%032x', c_custkey * 65537) AS address, n_nationkey IS NOT NULL AND c_custkey % 2 = 0 AS inside FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
)
def jon15_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-15/SRT-03: addresses as fixed-width text, and whether they lie in a network of 64 bits."""
    number = F.col("c_custkey") * 65537
    low = F.lower(F.lpad(F.hex(number), 16, "0"))
    short = F.concat(F.lit("::"), F.concat_ws(":", *[F.substring(low, 4 * i + 1, 4) for i in range(4)]))
    prefix = N.ipv6_hex(F.when(F.col("c_custkey") % 2 == 0, F.lit("0:0:0:0::")).otherwise(F.lit("FD00:1:2:3::")))
    inside = bound(N.ipv6_hex(short), lambda address: F.struct(address.alias("address"), N.in_prefix(address, prefix, 64).alias("inside")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(F.array(inside)))


# --- merges and summaries


@register(
    "agg10_latest_event",
    "SELECT user_id, arg_max(event_type, (CAST(ts AS DATE), CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END, event_id)) AS event_type FROM events GROUP BY user_id",
)
def agg10_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: the newest record of each key; ties by the kind of event."""
    order = F.struct(F.to_date("ts"), F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 2).otherwise(1), "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", order).alias("event_type"))


@register(
    "agg13_memberships",
    """WITH c AS (SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n, MIN(o_orderpriority) AS p FROM orders WHERE o_totalprice > 150000 GROUP BY 1)
    SELECT state, COUNT(*) AS devices FROM (SELECT CASE WHEN n > 1 THEN 'conflicting' WHEN n IS NULL THEN 'missing' ELSE 'supported' END AS state FROM customer LEFT JOIN c ON o_custkey = c_custkey) GROUP BY state""",
)
def agg13_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: the state of each device's claims, counted."""
    c = table(spark, sf_dir, "orders").where("o_totalprice > 150000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderpriority").alias("n"))
    state = F.when(F.col("n") > 1, "conflicting").when(F.col("n").isNull(), "missing").otherwise("supported")
    return table(spark, sf_dir, "customer").join(c, "c_custkey", "left").groupBy(state.alias("state")).agg(F.count("*").alias("devices"))


@register(
    "agg20_insights",
    "SELECT event_type, COUNT(*) AS eligible, COUNT(value) AS evaluable, COUNT(*) FILTER (WHERE value > 80) AS triggered, MIN(CASE WHEN value > 80 THEN value END) AS low, MAX(CASE WHEN value > 80 THEN value END) AS high FROM events GROUP BY event_type",
)
def agg20_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: of each condition who could be judged, who met it, and the range of its metric."""
    hit = F.when(F.col("value") > 80, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("eligible"), F.count("value").alias("evaluable"), F.count(hit).alias("triggered"), F.min(hit).alias("low"), F.max(hit).alias("high"))


@register(
    "agg22_neighbour_stats",
    "SELECT l_suppkey, MAX(l_discount) AS worst_error, MIN(l_quantity) AS low_signal, MAX(l_quantity) AS high_signal, bool_or(l_discount >= 0.1) AS banded FROM lineitem GROUP BY l_suppkey",
)
def agg22_neighbour_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: the extremes of each router's neighbours, and whether one lies in a band."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_discount").alias("worst_error"), F.min("l_quantity").alias("low_signal"), F.max("l_quantity").alias("high_signal"), F.bool_or(F.col("l_discount") >= 0.1).alias("banded"))


@register(
    "agg23_network_summary",
    "SELECT n_name, COUNT(DISTINCT s_suppkey) AS routers, COUNT(*) FILTER (WHERE l_quantity >= 40) AS lq3, COUNT(*) FILTER (WHERE l_quantity < 5) AS lq0, COUNT(l_orderkey) AS links FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_name",
)
def agg23_network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21/23: devices and links of each network by quality; links are counted by device before the joins."""
    q = F.col("l_quantity")
    links = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(q >= 40).alias("lq3"), F.count_if(q < 5).alias("lq0"), F.count("*").alias("links"))
    s = table(spark, sf_dir, "supplier").join(links, "s_suppkey", "left").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("routers"), *[F.sum(c).alias(c) for c in ("lq3", "lq0", "links")])
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").select("n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("routers", "lq3", "lq0", "links")])


@register(
    "agg25_outcome_vocabulary",
    "SELECT word, COUNT(event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('timeout'), ('error')) AS v(word) LEFT JOIN events ON event_type = word GROUP BY word",
)
def agg25_outcome_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: counts by a fixed vocabulary, zero where nothing happened."""
    words = spark.createDataFrame([(w,) for w in ("click", "view", "purchase", "timeout", "error")], "word string")  # configuration
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    return words.join(n, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


@register(
    "agg26_merge_statistics",
    "SELECT 'supplier' AS source, COUNT(*) AS rows_read, COUNT(c_custkey) AS matched, COUNT(*) - COUNT(c_custkey) AS new FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_nationkey = s_nationkey",
)
def agg26_merge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26: how many rows of a source matched and how many were new."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.lit(1).alias("hit"))
    return s.join(c, ["k", "n"], "left").agg(F.lit("supplier").alias("source"), F.count("*").alias("rows_read"), F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("new"))


@register(
    "agg31_service_groups",
    "SELECT l_orderkey, COUNT(*) AS services FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) >= 2 AND COUNT(DISTINCT l_returnflag) <= 1",
)
def agg31_service_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31: groups of two or more services that don't disagree about their address."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("services"), F.count_distinct("l_returnflag").alias("n"))
    return g.where("services >= 2 AND n <= 1").select("l_orderkey", "services")


@register(
    "agg07_serial_merge",
    """WITH r AS (SELECT l_orderkey, list({'serial': CAST(l_partkey % 256 AS INT), 'supp': l_suppkey} ORDER BY l_linenumber, l_partkey % 256, l_suppkey) AS routes FROM lineitem GROUP BY l_orderkey),
    f AS (SELECT l_orderkey, list_reduce(routes, lambda held, x: CASE WHEN ((x.serial - held.serial) % 256 + 256) % 256 BETWEEN 1 AND 127 THEN x ELSE held END) AS r FROM r)
    SELECT l_orderkey, r.serial AS serial, r.supp AS supp FROM f""",
)
def agg07_serial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07/MTH-F05: routes merged in source order: a newer serial number replaces, an older one is dropped (the order isn't transitive, so it is a fold)."""
    routes = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("serial"), "l_suppkey")))
    start = F.struct(F.lit(None).cast("int").alias("serial"), F.lit(None).cast("long").alias("supp"))

    def step(s, x):
        take = s["serial"].isNull() | (V.serial_order(s["serial"], x["serial"]) == "newer")
        return F.struct(F.when(take, x["serial"]).otherwise(s["serial"]).alias("serial"), F.when(take, x["l_suppkey"]).otherwise(s["supp"]).alias("supp"))

    merged = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.aggregate(routes, start, step).alias("r"))
    return merged.select("l_orderkey", "r.serial", "r.supp")


# --- orders


@register(
    "srt03_address_order",
    "SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY (c_custkey * 7919) % 16777216, c_custkey) AS place FROM customer",
)
def srt03_address_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03: the place of every row by numeric address."""
    n = (F.col("c_custkey") * 7919) % 16777216
    address = F.concat_ws(".", F.lit("10"), *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (16, 8, 0)])
    rows = table(spark, sf_dir, "customer").select("c_custkey", N.ipv4_hex(address).alias("k"))
    return R.placed(rows, [F.col("k").asc(), F.col("c_custkey").asc()]).select("c_custkey", "place")


# --- rules and evidence


@register(
    "rul11_missing_devices",
    """WITH seen AS (SELECT user_id, MAX(CAST(ts AS DATE)) AS day FROM events GROUP BY 1), last AS (SELECT MAX(CAST(ts AS DATE)) AS day FROM events)
    SELECT c_custkey, CASE WHEN seen.day = last.day THEN 'observed' WHEN seen.day IS NOT NULL AND date_diff('day', seen.day, last.day) < 2 THEN 'missing' ELSE 'offline' END AS finding FROM customer CROSS JOIN last LEFT JOIN seen ON user_id = c_custkey""",
)
def rul11_missing_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-10..12: expected devices observed, missing, or offline after two absences."""
    day = F.to_date("ts")
    events = table(spark, sf_dir, "events")
    seen = events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(day).alias("day"))
    last = events.agg(F.max(day).alias("last"))  # one row
    finding = F.when(F.col("day") == F.col("last"), "observed").when(F.datediff("last", "day") < 2, "missing").otherwise("offline")
    return table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left").crossJoin(F.broadcast(last)).select("c_custkey", finding.alias("finding"))


@register(
    "rul19_error_ratios",
    """WITH e AS (SELECT l_suppkey, SUM(l_discount) AS bad, SUM(l_quantity) AS total FROM lineitem GROUP BY 1)
    SELECT l_suppkey, CASE WHEN NOT total > 0 THEN 'not-evaluable' WHEN bad / total >= 0.00203 THEN 'critical' WHEN bad / total >= 0.00194 THEN 'unstable' ELSE 'normal' END AS band FROM e""",
)
def rul19_error_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-17..19: ratios graded where their denominator is positive."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("bad"), F.sum("l_quantity").alias("total"))
    band = F.when(~(F.col("total") > 0), "not-evaluable").otherwise(U.graded(F.col("bad") / F.col("total"), [(0.00194, "unstable"), (0.00203, "critical")], "normal"))
    return e.select("l_suppkey", band.alias("band"))


@register(
    "evd05_classification",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'answered' WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'not-provided' WHEN o_orderpriority = '5-LOW' THEN 'legacy' ELSE 'unanswered' END AS outcome FROM orders",
)
def evd05_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-02/04/05: the outcome of a request by the first rule that applies."""
    outcome = F.when(F.col("o_orderstatus") == "F", "answered").when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000), "not-provided").when(F.col("o_orderpriority") == "5-LOW", "legacy").otherwise("unanswered")
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"))


@register(
    "evd07_moved",
    """WITH f AS (SELECT l_partkey, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS a, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS b, COUNT(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_partkey, CASE WHEN n = 1 THEN 'added' WHEN a = b THEN 'updated' ELSE 'moved' END AS outcome FROM f""",
)
def evd07_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-07: children added, updated, or seen under another parent."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    f = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", order).alias("a"), F.max_by("l_suppkey", order).alias("b"), F.count("*").alias("n"))
    return f.select("l_partkey", F.when(F.col("n") == 1, "added").when(F.col("a") == F.col("b"), "updated").otherwise("moved").alias("outcome"))


@register(
    "evd08_first_occurrence",
    "SELECT l_suppkey, l_partkey, MIN(l_orderkey * 10 + l_linenumber) AS kept, COUNT(*) - 1 AS skipped FROM lineitem GROUP BY 1, 2",
)
def evd08_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-08: the first of a device's entries is kept, later ones are counted."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kept"), (F.count("*") - 1).alias("skipped"))


@register(
    "evd11_scope_resolution",
    "SELECT o_custkey, CASE COUNT(DISTINCT o_orderpriority) WHEN 0 THEN 'unknown' WHEN 1 THEN 'observed' ELSE 'ambiguous' END AS state, CASE WHEN COUNT(DISTINCT o_orderpriority) = 1 THEN MIN(o_orderpriority) END AS scope FROM orders GROUP BY o_custkey",
)
def evd11_scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-11: none, one or many scopes: unknown, observed or ambiguous."""
    n = F.count_distinct("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(n == 0, "unknown").when(n == 1, "observed").otherwise("ambiguous").alias("state"), F.when(n == 1, F.min("o_orderpriority")).alias("scope"))


@register(
    "evd14_lattice",
    "SELECT user_id, CASE WHEN bool_or(event_type = 'click') AND bool_or(event_type = 'view') THEN 'conflicting' WHEN bool_or(event_type = 'click') THEN 'thread' WHEN bool_or(event_type = 'view') THEN 'non-thread' ELSE 'unknown' END AS kind FROM events GROUP BY user_id",
)
def evd14_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-14: contradicting evidence conflicts; else what any evidence says."""
    has = {k: F.bool_or(F.col("event_type") == k) for k in ("click", "view")}
    kind = F.when(has["click"] & has["view"], "conflicting").when(has["click"], "thread").when(has["view"], "non-thread").otherwise("unknown")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kind.alias("kind"))


# --- graphs, mutation and sinks


@register(
    "grf10_directed_samples",
    "SELECT l_orderkey, l_linenumber, 'out' AS direction, l_suppkey AS source, l_partkey AS target, l_tax AS metric FROM lineitem WHERE l_tax > 0 UNION ALL SELECT l_orderkey, l_linenumber, 'in', l_partkey, l_suppkey, l_discount FROM lineitem WHERE l_discount > 0",
)
def grf10_directed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-09/10: a link with a metric of each direction as two samples; a direction without one gives none."""
    sides = F.array(
        F.struct(F.lit("out").alias("direction"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_tax").alias("metric")),
        F.struct(F.lit("in").alias("direction"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_discount").alias("metric")),
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(sides).alias("x")).select("l_orderkey", "l_linenumber", "x.*").where("metric > 0")


@register(
    "grf07_dangling",
    "SELECT DISTINCT l_partkey AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)",
)
def grf07_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-07: links to nodes that the model lacks."""
    nodes = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("missing"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("missing")).distinct().join(nodes, "missing", "left_anti")


@register(
    "grf12_ring_layout",
    "SELECT s_suppkey, ROUND(cos(2 * pi() * (ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) / COUNT(*) OVER (PARTITION BY s_nationkey)), 5) + 0.0 AS x FROM supplier",
)
def grf12_ring_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-12: each network's devices around a circle."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    turn = (F.row_number().over(w.orderBy("s_suppkey")) - 1) / F.count("*").over(w)
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.round(F.cos(2 * F.pi() * turn), 5) + 0.0).alias("x"))


@register(
    "mut04_label_merge",
    "SELECT COALESCE(c_custkey, s_suppkey) AS id, COALESCE(s_name, c_name) AS label, c_name IS NOT NULL AND s_name IS NOT NULL AND c_name <> s_name AS replaced FROM customer FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON c_custkey = s_suppkey",
)
def mut04_label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MUT-04: labels merged with new ones, and which were replaced."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), "s_name")
    return c.join(s, "id", "full").select("id", F.coalesce("s_name", "c_name").alias("label"), F.coalesce(F.col("c_name") != F.col("s_name"), F.lit(False)).alias("replaced"))


@register(
    "mut07_replay",
    "SELECT policy, COUNT(*) FILTER (WHERE l_discount >= t) AS triggered FROM lineitem CROSS JOIN (VALUES ('v1', 0.05), ('v2', 0.08)) AS p(policy, t) GROUP BY policy",
)
def mut07_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MUT-07/RUL-25: all evidence judged again under several policies, in one scan."""
    return table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_discount") >= 0.05).alias("v1"), F.count_if(F.col("l_discount") >= 0.08).alias("v2")).unpivot([], ["v1", "v2"], "policy", "triggered")


@register(
    "snk04_idempotent_insert",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'",
)
def snk04_idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: a batch that overlaps the table adds only what is new."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    held, batch = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), orders.where("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    return held.union(batch.join(held, "o_orderkey", "left_anti"))


@register("jsn01_canonical", """SELECT c_custkey, '{"balance":' || CAST(CAST(FLOOR(c_acctbal) AS BIGINT) AS VARCHAR) || ',"name":"' || c_name || '"}' AS body FROM customer""")
def jsn01_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-F01: compact JSON with keys in order."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.floor("c_acctbal").alias("balance"), F.col("c_name").alias("name"))).alias("body"))


@register("src04_page_digests", "SELECT page_id, sha256(html) AS digest, strlen(html) AS size FROM pages")
def src04_page_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04/05: the digest and size of each raw source."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))


@register(
    "src01_json_records",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL",
)
def src01_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01/JSN-F04: JSON snapshots as records."""
    from meshlake.sources.records import extract_records, lifted

    return extract_records(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", lifted("record", "k").alias("k"))


@register(
    "conv_latest_turn",
    "SELECT conv_id, MAX(turn) AS turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id",
)
def conv_latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: the pointer to the latest turn of each conversation."""
    return R.best_fact(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"]).drop("disagreement").withColumnRenamed("role", "last_role").join(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")), "conv_id")


@register("grf06_strong_pairs", "SELECT LEAST(l_suppkey, l_partkey) AS low, GREATEST(l_suppkey, l_partkey) AS high, COUNT(*) AS links FROM lineitem WHERE l_suppkey <> l_partkey AND l_quantity > 48 GROUP BY 1, 2")
def grf06_strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-06: links in either direction as one."""
    return G.undirected(table(spark, sf_dir, "lineitem").where("l_quantity > 48"), "l_suppkey", "l_partkey")
