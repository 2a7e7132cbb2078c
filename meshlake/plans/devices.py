"""Printed texts read back, merges of entries, identity guards, rules and orders of devices, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators import relational as R
from meshlake.plans.catalog import register
from meshlake.sources import records
from meshlake.sources import sections as S
from meshlake.sources.tables import table

# --- printed texts: every order is printed as a device would print itself, and read back


def printed(spark: SparkSession, sf_dir: str, line: str, head: str = "", tail: str = "") -> DataFrame:
    """l_orderkey and text: the lines of each order in order, each printed by a SQL expression, between a head and a tail."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*order, F.expr(line).alias("text")).alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "")
    return lines.groupBy("l_orderkey").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


#: The place of a line within its order.
PLACED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place FROM lineitem"


@register(
    "src08_child_table",
    """SELECT l_orderkey, format('0x{:04x}', (l_orderkey % 60) * 1024) AS parent, l_linenumber AS id, format('0x{:04x}', CASE WHEN l_linenumber % 4 = 0 THEN (l_orderkey % 60) * 1024 + l_linenumber ELSE l_partkey % 65536 END) AS rloc16,
    240 AS timeout, CAST(l_quantity AS INT) AS age, l_linenumber % 4 AS lq_in FROM lineitem""",
)
def src08_child_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: the children of printed tables; where one has no address it is its parent's with its id; a broken row goes."""
    address = "CASE WHEN l_linenumber % 4 = 0 THEN '     -' ELSE concat('0x', lower(lpad(hex(l_partkey % 65536), 4, '0'))) END"
    head = "| ID  | RLOC16 | Timeout | Age | LQ In |\n+-----+--------+---------+-----+-------+\n"
    files = printed(spark, sf_dir, f"concat('| ', lpad(l_linenumber, 3, ' '), ' | ', {address}, ' |     240 | ', lpad(int(l_quantity), 3, ' '), ' | ', l_linenumber % 4, ' |\n')", head, "|   x | broken |\nDone\n")
    files = files.withColumn("parent", F.expr("concat('0x', lower(lpad(hex((l_orderkey % 60) * 1024), 4, '0')))"))
    return S.child_rows(files, "text", "parent", ["l_orderkey"])


@register(
    "src09_counters",
    "SELECT o_orderkey, o_orderkey + 1 AS tx_total, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS tx_errors, CASE WHEN o_orderstatus <> 'P' THEN ROUND(100 * o_custkey / (o_orderkey + 1), 6) END AS error_percent FROM orders",
)
def src09_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09/10/16: counters behind their names in printed lists, null where a list lacks them, and a ratio of two."""
    text = "concat('TxTotal: ', o_orderkey + 1, '\nTxTotalOther: 5\n', CASE WHEN o_orderstatus <> 'P' THEN concat('    TxErrCca: ', o_custkey, '\n') ELSE 'TxErrCca: none\n' END, 'RxTotal: 90\n')"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("text"))
    found = rows.select("o_orderkey", records.tokens("text", "TxTotal").alias("tx_total"), records.tokens("text", "TxErrCca").alias("tx_errors"))
    return found.withColumn("error_percent", F.round(100 * F.col("tx_errors") / F.col("tx_total"), 6))


@register(
    "src11_time_shares",
    """WITH n AS (SELECT l_orderkey, COUNT(*) FILTER (l_returnflag = 'N') AS a, COUNT(*) FILTER (l_returnflag = 'R') AS b, COUNT(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_orderkey, floor(1000 * a / n + 0.5) / 10 AS router_percent, floor(1000 * b / n + 0.5) / 10 AS child_percent, floor(1000 * (n - a - b) / n + 0.5) / 10 AS detached_percent FROM n""",
)
def src11_time_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: role times of printed lists as percent of the tracked time."""
    roles = {"Role Router": "N", "Role Child": "R", "Role Detached": "A"}
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(*(x for r, flag in roles.items() for x in (F.lit(f"{r}: "), F.count_if(F.col("l_returnflag") == flag).cast("string"), F.lit("\n")))).alias("text"))
    return texts.select("l_orderkey", *records.time_shares("text", list(roles))).toDF("l_orderkey", "router_percent", "child_percent", "detached_percent")


@register(
    "src12_leader_data",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS partition_id, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 3 = 0 THEN 64 END AS weighting, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 256 END AS data_version,
    CAST(NULL AS BIGINT) AS leader_router_id FROM orders""",
)
def src12_leader_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: the leader sections of printed texts; what a section lacks is null, whatever stands in other sections."""
    inside = "concat('Leader Data:\n  PartitionId: ', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '\n  Weighting: 64' ELSE '' END, '\n  DataVersion: ', o_orderkey % 256, '\nOther:\n  LeaderRouterId: 9\n')"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"CASE WHEN o_orderkey % 7 > 0 THEN {inside} WHEN o_orderkey % 2 = 0 THEN 'Mode: rdn\n' END").alias("text"))
    return rows.select("o_orderkey", S.leader_data(F.col("text")).alias("x")).select("o_orderkey", "x.*")


@register("src13_route_entries", f"WITH p AS ({PLACED}) SELECT l_orderkey, 12 AS id_sequence, place, l_suppkey AS router_id, l_linenumber % 4 AS lq_out, l_linenumber % 3 AS lq_in, CAST(l_quantity AS BIGINT) AS cost FROM p")
def src13_route_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: the entries of printed route sections."""
    entry = "concat('  - RouterId: ', l_suppkey, '\n    LinkQualityOut: ', l_linenumber % 4, '\n    LinkQualityIn: ', l_linenumber % 3, '\n    RouteCost: ', int(l_quantity), '\n')"
    return S.route_entries(printed(spark, sf_dir, entry, "Mode: rdn\nRoute:\n  IdSequence: 12\n", "IPv6 Address List:\n  - fd00::1\n"), "text", "l_orderkey")


@register(
    "src14_mode_and_addresses",
    f"""WITH p AS ({PLACED}), a AS (SELECT l_orderkey, format('fd00::{{:x}}', l_suppkey % 3) AS address, MIN(place) AS place FROM p GROUP BY 1, 2)
    SELECT l_orderkey, l_orderkey % 2 = 0 AS rx_on, l_orderkey % 3 = 0 AS full_device, l_orderkey % 5 = 0 AS full_data, string_agg(address, ',' ORDER BY place) AS addresses FROM a GROUP BY l_orderkey""",
)
def src14_mode_and_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: mode flags of printed texts and their lists of addresses, each once."""
    rows = printed(spark, sf_dir, "concat('  - fd00::', lower(hex(l_suppkey % 3)), '\n')", "IPv6 Address List:\n")
    letters = "concat(CASE WHEN l_orderkey % 2 = 0 THEN 'r' ELSE '' END, CASE WHEN l_orderkey % 3 = 0 THEN 'd' ELSE '' END, CASE WHEN l_orderkey % 5 = 0 THEN 'n' ELSE '' END)"
    rows = rows.withColumn("text", F.expr(f"concat('Mode: ', coalesce(nullif({letters}, ''), '-'), '\n', text)"))
    return rows.select("l_orderkey", S.mode_flags(F.col("text")).alias("m"), F.array_join(S.addresses(F.col("text")), ",").alias("addresses")).select("l_orderkey", "m.*", "addresses")


@register("src15_tlv", f"WITH p AS ({PLACED}) SELECT l_orderkey, place, l_linenumber * 10 AS type, l_linenumber % 2 * 2 AS length, CASE WHEN l_linenumber % 2 = 1 THEN format('{{:04x}}', l_suppkey % 65536) ELSE '' END AS value FROM p")
def src15_tlv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: type, length and value of the entries of hex payloads; one that reaches past the end ends the list."""
    entry = "concat(lpad(hex(l_linenumber * 10), 2, '0'), CASE WHEN l_linenumber % 2 = 1 THEN concat('02', lpad(hex(l_suppkey % 65536), 4, '0')) ELSE '00' END)"
    rows = printed(spark, sf_dir, entry, "", "0908FF")
    return rows.select("l_orderkey", F.posexplode(records.tlv(F.col("text"))).alias("place", "x")).select("l_orderkey", "place", "x.type", "x.length", "x.value")


@register("src23_router_table", "SELECT l_orderkey, l_linenumber AS id, format('0x{:04x}', l_suppkey % 64 * 1024) AS rloc16, 63 - l_linenumber AS next_hop, CAST(l_quantity AS INT) AS cost FROM lineitem")
def src23_router_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23: the rows of printed router tables."""
    line = "concat('|  ', l_linenumber, ' | 0x', lower(lpad(hex(l_suppkey % 64 * 1024), 4, '0')), ' |       ', 63 - l_linenumber, ' |  ', int(l_quantity), ' |\n')"
    files = printed(spark, sf_dir, line, "| ID | RLOC16 | Next Hop | Path Cost |\n+----+--------+----------+-----------+\n", "\nDone")
    rows = records.table_rows(files, "text", ["id", "rloc16", "next_hop", "cost"])
    return rows.select("l_orderkey", F.col("id").cast("int"), "rloc16", F.col("next_hop").cast("int"), F.col("cost").cast("int"))


LINES = """SELECT l_orderkey AS owner, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END AS ext, l_suppkey AS rloc, l_linenumber AS rank, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS mode,
    CASE WHEN l_quantity > 10 THEN l_quantity END AS quality FROM lineitem"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as entries of a device: some lack their address, some lack fields."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS owner", "CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END AS ext", "l_suppkey AS rloc", "l_linenumber AS rank",
        "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS mode", "CASE WHEN l_quantity > 10 THEN l_quantity END AS quality"
    )


@register(
    "agg08_relationship_merge",
    f"""WITH r AS ({LINES}), one AS (SELECT owner, rloc, MIN(ext) AS e FROM r WHERE ext IS NOT NULL GROUP BY owner, rloc HAVING COUNT(DISTINCT ext) = 1),
    k AS (SELECT r.owner, COALESCE(r.ext, one.e) AS ext, r.rloc, r.rank, r.mode, r.quality FROM r LEFT JOIN one ON r.owner = one.owner AND r.rloc = one.rloc)
    SELECT owner, ext, arg_min(mode, (rank, rloc, mode)) FILTER (mode IS NOT NULL) AS mode, arg_min(quality, (rank, rloc, quality)) FILTER (quality IS NOT NULL) AS quality FROM k WHERE ext IS NOT NULL GROUP BY owner, ext
    UNION ALL SELECT owner, ext, mode, quality FROM k WHERE ext IS NULL""",
)
def agg08_relationship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: a device's entries of one address as one, found by a single fallback value where the address lacks; the others stay."""
    rows = R.with_fallback_key(entries(spark, sf_dir), "owner", "ext", "rloc")
    return R.merge_entries(rows, "owner", ["ext"], ["rank", "rloc"], ["mode", "quality"])


@register(
    "agg09_endpoint_merge",
    f"""WITH r AS ({LINES}), k AS (SELECT owner, rloc % 8 - 1 AS endpoint, rank, mode, quality FROM r)
    SELECT owner, endpoint, arg_min(mode, (rank, mode)) FILTER (mode IS NOT NULL) AS mode, arg_min(quality, (rank, quality)) FILTER (quality IS NOT NULL) AS quality FROM k WHERE endpoint >= 0 GROUP BY owner, endpoint
    UNION ALL SELECT owner, NULL, mode, quality FROM k WHERE endpoint < 0""",
)
def agg09_endpoint_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09: entries of one endpoint number (0 to 65,534) as one; those with another number have none and stay."""
    number = F.col("rloc") % 8 - 1
    rows = entries(spark, sf_dir).withColumn("endpoint", F.when((number >= 0) & (number < 65535), number))
    return R.merge_entries(rows, "owner", ["endpoint"], ["rank"], ["mode", "quality"])


@register(
    "jon17_identity_guard",
    """SELECT c_nationkey AS key, COUNT(DISTINCT CASE WHEN c_acctbal > 9000 THEN c_mktsegment END) AS addresses, COUNT(*) AS members, COUNT(DISTINCT CASE WHEN c_acctbal > 9000 THEN c_mktsegment END) <= 1 AS compatible FROM customer GROUP BY 1""",
)
def jon17_identity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-17: whether the records that share a key can be one device: no two different concrete addresses."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment")).alias("address"))
    return R.compatible_groups(rows, "key", "address")


@register(
    "jon19_guarded_merge",
    """WITH g AS (SELECT c_nationkey, COUNT(DISTINCT CASE WHEN c_acctbal > 9000 THEN c_mktsegment END) <= 1 AS fits, MIN(c_custkey) AS low FROM customer GROUP BY 1)
    SELECT c_custkey AS id, CASE WHEN fits THEN low ELSE c_custkey END AS entity FROM customer JOIN g USING (c_nationkey)""",
)
def jon19_guarded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16/17/19: records of one key become its smallest one only where the guard lets them."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"), F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment")).alias("address"))
    groups = rows.groupBy("key").agg(F.count_distinct("address").alias("addresses"), F.min("id").alias("low"))
    return rows.join(groups, "key").select("id", F.when(F.col("addresses") <= 1, F.col("low")).otherwise(F.col("id")).alias("entity"))


@register(
    "srt04_comparison_order",
    "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey DESC) AS place FROM orders",
)
def srt04_comparison_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04: an order whose direction applies to its last term only; the place of every row."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return R.placed(rows, [F.col("o_orderpriority").asc(), F.col("o_orderdate").asc(), F.col("o_orderkey").desc()]).select("o_orderkey", "place")


@register(
    "srt11_roster_order",
    """WITH r AS (SELECT c_custkey, c_mktsegment AS label, COUNT(*) OVER (PARTITION BY lower(c_mktsegment), c_nationkey) > 1 AS twice, c_nationkey FROM customer WHERE c_acctbal >= 0),
    n AS (SELECT c_custkey, CASE WHEN twice THEN label || ' #' || c_custkey ELSE label END AS label FROM r) SELECT c_custkey, label, ROW_NUMBER() OVER (ORDER BY lower(label), c_custkey) AS place FROM n""",
)
def srt11_roster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-11: a filtered roster by label whatever its case; labels that occur twice get their id."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", F.col("c_mktsegment").alias("label"), "c_nationkey", F.lower("c_mktsegment").alias("folded"))
    times = rows.groupBy("folded", "c_nationkey").agg((F.count("*") > 1).alias("twice"))
    named = rows.join(times, ["folded", "c_nationkey"]).select("c_custkey", F.when(F.col("twice"), F.concat("label", F.lit(" #"), F.col("c_custkey").cast("string"))).otherwise(F.col("label")).alias("label"))
    return R.placed(named, [F.lower("label").asc(), F.col("c_custkey").asc()]).select("c_custkey", "label", "place")


@register("dtf03_source_time", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN epoch_us(ts) END AS source_us FROM events")
def dtf03_source_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-F03: a file's time in nanoseconds as source time; one behind the read time is none."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", (at * 1000).alias("ns"), F.when(F.col("event_id") % 5 > 0, at).otherwise(at - 1).alias("read_us"))
    source = F.expr("ns div 1000")
    return rows.select("event_id", F.when(source <= F.col("read_us"), source).alias("source_us"))


@register(
    "dtf05_cutoff",
    "SELECT event_type, COUNT(*) AS old FROM events WHERE epoch_us(ts) < (SELECT MAX(epoch_us(ts)) FROM events) - 7 * 86400000000 GROUP BY event_type",
)
def dtf05_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-F05: rows older than a number of days before the newest, as a purge counts them."""
    events = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    newest = events.agg(F.max("us").alias("newest"))  # one row
    return events.crossJoin(F.broadcast(newest)).where(F.col("us") < F.col("newest") - 7 * 86_400_000_000).groupBy("event_type").agg(F.count("*").alias("old"))


@register(
    "rul20_attachment",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'POOR' WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE 'GOOD' END AS status, o_orderstatus = 'F' AS network_material FROM orders",
)
def rul20_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-20: a device whose state says that it isn't attached is POOR and counts for the network; an unknown state gives UNKNOWN."""
    state = F.when(F.col("o_orderstatus") == "F", "detached").when(F.col("o_orderstatus") == "O", "router")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))
    bad = F.col("state").isin("detached", "disabled", "orphaned")
    return rows.select("o_orderkey", F.when(bad, "POOR").when(F.col("state").isNull(), "UNKNOWN").otherwise("GOOD").alias("status"), F.coalesce(bad, F.lit(False)).alias("network_material"))


@register(
    "rul27_findings",
    """WITH o AS (SELECT user_id, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad, COUNT(*) AS n FROM events GROUP BY user_id)
    SELECT sha256('device.error-ratio|' || user_id) AS finding_id, 'device.error-ratio' AS rule, user_id AS subject, CASE WHEN n < 5 THEN 'UNKNOWN' WHEN 4 * bad >= n THEN 'POOR' WHEN 8 * bad >= n THEN 'MODERATE' ELSE 'GOOD' END AS status, bad || '/' || n AS evidence FROM o""",
)
def rul27_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-13/27: a finding for each device with a stable id, status, subject and evidence; too little evidence gives UNKNOWN."""
    bad = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(bad.alias("bad"), F.count("*").alias("n"))
    status = F.when(F.col("n") < 5, "UNKNOWN").when(4 * F.col("bad") >= F.col("n"), "POOR").when(8 * F.col("bad") >= F.col("n"), "MODERATE").otherwise("GOOD")
    rule = F.lit("device.error-ratio")
    return seen.select(F.sha2(F.concat_ws("|", rule, F.col("user_id").cast("string")), 256).alias("finding_id"), rule.alias("rule"), F.col("user_id").alias("subject"), status.alias("status"), F.concat_ws("/", "bad", "n").alias("evidence"))


@register(
    "arrf03_sorted_addresses",
    """WITH a AS (SELECT DISTINCT o_custkey, o_orderkey // 256 % 256 AS x, o_orderkey % 256 AS y FROM orders) SELECT o_custkey, string_agg('10.0.' || x || '.' || y, ',' ORDER BY x, y) AS addresses FROM a GROUP BY o_custkey""",
)
def arrf03_sorted_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-F02/F03: each key's addresses once, in numeric order."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.expr("o_orderkey div 256 % 256").alias("x"), (k % 256).alias("y")).distinct()
    held = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("a"))  # bounded by the 65,536 addresses of a network
    return held.select("o_custkey", F.array_join(F.transform("a", lambda s: F.concat_ws(".", F.lit("10.0"), s["x"].cast("string"), s["y"].cast("string"))), ",").alias("addresses"))
