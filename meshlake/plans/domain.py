"""Mesh-specific functions, rules, comparisons and graphs bound to the star-schema tables, with SQL oracles.

Identifiers are made from the tables' keys, so that both sides compute them from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.functions import identity as I
from meshlake.functions import values as V
from meshlake.operators import blocks as B
from meshlake.operators import graph as G
from meshlake.operators import relational as R
from meshlake.operators import rules as U
from meshlake.plans.catalog import register
from meshlake.sources.shared import keep
from meshlake.sources.tables import table

# --- projections and filters


@register(
    "prj01_first_present",
    "SELECT c_custkey, COALESCE(NULLIF(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), NULLIF(c_mktsegment, '')) AS label FROM customer",
)
def prj01_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01: the first alias with a value; empty text is no value."""
    first = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.first_present(first, "c_mktsegment").alias("label"))


@register(
    "prj13_unpivot_metrics",
    """SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)
    UNPIVOT (value FOR metric IN (quantity, discount, tax))""",
)
def prj13_unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-13: wide records as long metric rows."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS quantity", "l_discount AS discount", "l_tax AS tax")
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "metric", "value").where("value IS NOT NULL")


@register(
    "prj08_roles",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'explicit' WHEN (event_id & 1023) = 0 THEN 'router' ELSE 'child' END AS role, printf('0x%04x', event_id & 65535) AS rloc16, (event_id & 64512) AS parent FROM events""",
)
def prj08_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08/STR-F05: a role from an explicit word, else from the locator's low bits, with locator and parent."""
    number = F.col("event_id").bitwiseAND(F.lit(65535))
    role = F.when(F.col("event_type") == "view", "explicit").when(I.is_router(F.col("event_id")), "router").otherwise("child")
    return table(spark, sf_dir, "events").select("event_id", role.alias("role"), I.rloc16(number).alias("rloc16"), I.parent(number).alias("parent"))


@register(
    "prj12_version_decode",
    "SELECT p_partkey, CASE p_size % 8 WHEN 2 THEN '1.1' WHEN 3 THEN '1.2' WHEN 4 THEN '1.3' WHEN 5 THEN '1.4' ELSE 'Unknown' END AS version FROM part",
)
def prj12_version_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-12: protocol versions by number."""
    known = F.create_map(*[F.lit(x) for kv in ((2, "1.1"), (3, "1.2"), (4, "1.3"), (5, "1.4")) for x in kv])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(known, F.col("p_size") % 8), F.lit("Unknown")).alias("version"))


@register(
    "flt03_two_valued",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE COALESCE(CASE WHEN l_returnflag <> 'A' THEN l_quantity END >= 45, FALSE)",
)
def flt03_two_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03: a threshold that missing values never meet."""
    metric = F.when(F.col("l_returnflag") != "A", F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").where(R.holds(metric, ">=", 45)).select("l_orderkey", "l_linenumber")


@register("flt04_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.03 AND l_discount < 0.05")
def flt04_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: a half-open range; plain bounds, so the scan skips row groups."""
    return table(spark, sf_dir, "lineitem").where("l_discount >= 0.03 AND l_discount < 0.05").select("l_orderkey", "l_linenumber")


POLICY = [("l_discount", 0.09, "critical", 3), ("l_discount", 0.07, "unstable", 2), ("l_tax", 0.07, "unstable", 2), ("l_quantity", 48.0, "high", 1)]
POLICY_SQL = "(VALUES " + ", ".join(f"('{m}', {t}, '{b}', {r})" for m, t, b, r in POLICY) + ") AS p(metric, threshold, band, rank)"


@register(
    "flt05_threshold_policy",
    f"""WITH m AS (SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR metric IN (l_quantity, l_discount, l_tax))),
    r AS (SELECT l_orderkey, l_linenumber, metric, (SELECT arg_max(band, rank) FROM {POLICY_SQL} WHERE p.metric = m.metric AND m.value >= threshold) AS band FROM m)
    SELECT * FROM r WHERE band IS NOT NULL""",
)
def flt05_threshold_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05/RUL-15/24: every row's metrics against a table of thresholds; the highest band met."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    rows = lines.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "metric", "value")
    # a row's answer depends on it alone: the thresholds from the highest rank down, without a join or a shuffle
    met = F.coalesce(*[F.when((F.col("metric") == m) & (F.col("value") >= t), F.lit(b)) for m, t, b, _ in sorted(POLICY, key=lambda x: -x[3])])
    return rows.withColumn("band", met).where("band IS NOT NULL").select("l_orderkey", "l_linenumber", "metric", "band")


@register(
    "flt06_collection",
    "SELECT l_orderkey, MIN(l_discount) AS least, MAX(l_discount) AS most, COUNT(*) AS n FROM lineitem WHERE l_discount > 0.06 GROUP BY l_orderkey",
)
def flt06_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06/AGG-20: of each collection the matching entries' least and most metric."""
    return table(spark, sf_dir, "lineitem").where("l_discount > 0.06").groupBy("l_orderkey").agg(F.min("l_discount").alias("least"), F.max("l_discount").alias("most"), F.count("*").alias("n"))


@register(
    "flt07_severity_dedup",
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(FLOOR(value / 25) AS INTEGER) AS rank, value >= 25 AS triggered FROM events), t AS (SELECT *, MAX(CASE WHEN triggered THEN rank END) OVER (PARTITION BY user_id, event_type) AS top FROM e)
    SELECT event_id, rank FROM t WHERE NOT triggered OR rank = top""",
)
def flt07_severity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: the highest triggered severity of each group; what isn't triggered stays."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("value") / 25).cast("int").alias("rank"), (F.col("value") >= 25).alias("triggered"))
    return R.highest_only(e, ["user_id", "event_type"], "rank", "triggered").select("event_id", "rank")


@register("flt08_text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1')")
def flt08_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08/09: whole texts searched whatever the case, in several columns."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(R.mentions("license", "text") | R.mentions("SRC1", "source")).select("doc_id")


@register(
    "flt15_capabilities",
    "SELECT bool_or(value > 90) AS has_high, bool_or(event_type = 'click') AS has_click, bool_or(props IS NULL) AS has_missing, bool_or(contains(props, 'nothing')) AS has_nothing FROM events",
)
def flt15_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15: flags that any row sets, in one pass (one row is the result)."""
    e = table(spark, sf_dir, "events")
    return e.agg(F.bool_or(F.col("value") > 90).alias("has_high"), F.bool_or(F.col("event_type") == "click").alias("has_click"), F.bool_or(F.col("props").isNull()).alias("has_missing"), F.bool_or(F.col("props").contains("nothing")).alias("has_nothing"))


@register(
    "flt16_visibility_closure",
    """WITH s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000), e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 45),
    v AS (SELECT e.* FROM e JOIN s ON s_suppkey = l_suppkey)
    SELECT 'supplier' AS kind, s_suppkey AS id FROM s UNION SELECT 'part', l_partkey FROM v""",
)
def flt16_visibility_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16: visible nodes, and the endpoints of the links that touch them."""
    seen = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_suppkey")
    links = table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(seen, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("l_partkey").distinct()
    return seen.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")).union(links.select(F.lit("part"), "l_partkey"))


@register("jsn02_membership", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '3') OR props IS NULL")
def jsn02_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-F02/FLT-10: rows whose JSON holds one of some values."""
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isin("1", "3") | F.col("props").isNull()).select("event_id")


# --- scalar functions


@register(
    "strf02_ext_address",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'extaddr:' || printf('%016x', c_custkey * 7919) END AS device, 'link:' || printf('%016x', c_custkey * 7919) || '->' || CAST(c_nationkey AS VARCHAR) AS link FROM customer""",
)
def strf02_ext_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-F01/02/12: addresses with separators and capitals in canonical form; all zeros are none."""
    number = F.format_string("%016X", F.col("c_custkey") * 7919)
    raw = F.when(F.col("c_custkey") % 5 == 0, F.lit(" 00:00:00:00:00:00:00:00")).otherwise(F.concat(F.lit(" "), F.substring(number, 1, 8), F.lit("-"), F.substring(number, 9, 8)))
    return table(spark, sf_dir, "customer").select("c_custkey", I.device_id(raw).alias("device"), I.relationship_id(F.lower(number), F.col("c_nationkey").cast("string")).alias("link"))


@register(
    "strf04_pan_id",
    "SELECT c_custkey, printf('%016x', c_custkey * 1000003) AS pan FROM customer",
)
def strf04_pan_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-F04: network ids from hex with and without 0x, and from decimal text."""
    n = F.col("c_custkey") * 1000003
    raw = F.when(F.col("c_custkey") % 3 == 0, F.format_string("0x%016X", n)).when(F.col("c_custkey") % 3 == 1, F.format_string("%016x", n)).otherwise(n.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", I.ext_pan_id(raw).alias("pan"))


@register(
    "strf06_router_and_partition",
    "SELECT p_partkey, CASE WHEN p_size <= 62 AND p_partkey % 7 <> 0 THEN p_size END AS router, p_partkey * 131 AS part FROM part",
)
def strf06_router_and_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-F06/07: router ids 0..62 and partition ids of 32 bits from decimal and hex text."""
    router = F.when(F.col("p_partkey") % 7 == 0, F.lit("63")).when(F.col("p_partkey") % 2 == 0, F.format_string("0x%x", F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    n = F.col("p_partkey") * 131
    part = F.when(F.col("p_partkey") % 2 == 0, F.format_string("0x%X", n)).otherwise(n.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", I.router_id(router).alias("router"), I.partition_id(part).alias("part"))


@register("strf08_base64", "SELECT s_suppkey, printf('%016x', s_suppkey * 999331) AS forward, printf('%016x', s_suppkey * 999331) AS backward FROM supplier")
def strf08_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-F08: addresses in base64, byte by byte and reversed, as hex."""
    text = F.format_string("%016x", F.col("s_suppkey") * 999331)
    turned = F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)])
    return table(spark, sf_dir, "supplier").select("s_suppkey", I.base64_to_ext_address(F.base64(F.unhex(text))).alias("forward"), I.base64_to_ext_address(F.base64(F.unhex(turned)), True).alias("backward"))


@register(
    "strf09_labels",
    "SELECT doc_id, CASE WHEN length(trim(source)) BETWEEN 1 AND 64 AND source <> 'src3' THEN trim(source) END AS label, printf('%016x', doc_id) || '|' || printf('%016x', doc_id * 3) AS node FROM documents",
)
def strf09_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-F03/09/10: valid labels, placeholders as none, and composite node ids."""
    raw = F.when(F.col("source") == "src3", " N/A ").otherwise(F.concat(F.lit(" "), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", I.valid_label(raw).alias("label"), I.composite("doc_id", F.col("doc_id") * 3).alias("node"))


@register("strf11_redaction", """SELECT event_id, regexp_replace(props, '("(?:k|token)"\\s*:\\s*)("[^"]*"|[0-9.]+)', '\\1"***"', 'g') AS props FROM events""")
def strf11_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-F11: the values of some keys masked in JSON text."""
    return table(spark, sf_dir, "events").select("event_id", I.redacted("props", ["k", "token"]).alias("props"))


@register("strf13_stable_id", "SELECT event_id, substr(sha256(CAST(user_id AS VARCHAR) || chr(1) || event_type || chr(1) || CAST(event_id AS VARCHAR)), 1, 24) AS id FROM events")
def strf13_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-F13/STR-04: a digest of a row's parts that names it whenever it is ingested."""
    parts = F.concat_ws("\x01", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.substring(F.sha2(parts, 256), 1, 24).alias("id"))


@register(
    "mthf_arithmetic",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_discount / 100 ELSE l_discount END AS fraction, CASE WHEN l_quantity >= 10 THEN l_discount * 100 / l_quantity * 1.0 END AS share,
    CASE WHEN (l_suppkey - l_partkey) % 256 = 0 THEN 'equal' WHEN ((l_suppkey - l_partkey) % 256 + 256) % 256 = 128 THEN 'ambiguous' WHEN ((l_suppkey - l_partkey) % 256 + 256) % 256 < 128 THEN 'newer' ELSE 'older' END AS serial,
    CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 5 THEN 1 ELSE 0 END AS quality, (l_orderkey >> 3) & 7 AS field FROM lineitem""",
)
def mthf_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-F02..07: scaling by source, shares above a floor, serial order, bands and bit fields."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", V.fraction("l_discount", "l_returnflag", "R").alias("fraction"), V.share("l_discount", "l_quantity", 10).alias("share"),
        V.serial_order("l_partkey", "l_suppkey").alias("serial"), V.banded("l_quantity", [(40, 3), (20, 2), (5, 1)], 0).alias("quality"), V.bit_field("l_orderkey", 3, 3).alias("field"),
    )


@register(
    "arrf04_coercion",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 4 = 0 END AS flag, CASE WHEN c_custkey % 4 <> 3 THEN CAST(c_custkey AS DOUBLE) END AS number, CASE WHEN c_custkey % 2 = 0 THEN 1577836800 + c_custkey END AS at FROM customer",
)
def arrf04_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-F04/DT-F01: booleans and numbers from text, and instants that need an offset."""
    k = F.col("c_custkey")
    flag = F.when(k % 4 == 0, "Yes ").when(k % 4 == 1, "off").when(k % 4 == 2, "maybe")
    text = F.when(k % 4 == 3, F.concat(k.cast("string"), F.lit("x"))).otherwise(k.cast("string"))
    stamp = F.date_format(F.timestamp_seconds(k + 1577836800), "yyyy-MM-dd'T'HH:mm:ss")
    at = V.instant(F.when(k % 2 == 0, F.concat(stamp, F.lit("+00:00"))).otherwise(stamp))
    return table(spark, sf_dir, "customer").select("c_custkey", V.boolean(flag).alias("flag"), V.number(text).alias("number"), F.unix_seconds(at).alias("at"))


# --- rules


@register(
    "rul01_redundancy",
    """WITH n AS (SELECT n_nationkey, n_name, COUNT(s_suppkey) AS routers, COUNT(*) FILTER (WHERE s_acctbal > 5000) AS border FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT n_name, CASE WHEN routers = 0 THEN 'UNKNOWN' WHEN routers <= 1 THEN 'MODERATE' ELSE 'STRONG' END AS redundancy, CASE WHEN border > 0 THEN 'STRONG' WHEN routers > 0 THEN 'MODERATE' ELSE 'UNKNOWN' END AS routing FROM n""",
)
def rul01_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-01..03: redundancy of routers and external routing."""
    found = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("routers"), F.count_if(F.col("s_acctbal") > 5000).alias("border"))
    out = table(spark, sf_dir, "nation").join(found, "n_nationkey", "left").na.fill(0, ["routers", "border"])
    return out.select("n_name", U.redundancy(F.col("routers"), F.lit(True)).alias("redundancy"), U.external_routing(F.col("routers"), F.col("border")).alias("routing"))


@register(
    "rul06_offline_impact",
    """WITH n AS (SELECT c_nationkey, COUNT(*) AS expected, COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')) AS offline FROM customer GROUP BY 1)
    SELECT c_nationkey, expected, offline, CASE WHEN offline / expected > 0.15 THEN 'POOR' ELSE 'STRONG' END AS verdict FROM n""",
)
def rul06_offline_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-06: the share of expected members that are offline."""
    seen = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(1))
    n = table(spark, sf_dir, "customer").join(seen, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("expected"), F.count_if(F.col("seen").isNull()).alias("offline"))
    return n.select("c_nationkey", "expected", "offline", U.offline_impact(F.col("offline"), F.col("expected")).alias("verdict"))


@register(
    "rul07_partitions",
    """WITH p AS (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT c_nationkey, COUNT(*) AS parts, MAX(n) / SUM(n) AS share FROM p GROUP BY 1)
    SELECT c_nationkey, parts, CASE WHEN parts = 1 THEN 'STRONG' WHEN share >= 0.75 THEN 'MODERATE' ELSE 'POOR' END AS verdict FROM s""",
)
def rul07_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-07/AGG-13/14: partitions of each network and the share of the dominant one."""
    p = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    s = p.groupBy("c_nationkey").agg(F.count("*").alias("parts"), (F.max("n") / F.sum("n")).alias("share"))
    return s.select("c_nationkey", "parts", U.partitions(F.col("parts"), F.col("share")).alias("verdict"))


@register("rul08_duplicate_entries", "SELECT l_suppkey, l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def rul08_duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-08: links reported more than once."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@register(
    "rul15_graded_counters",
    """SELECT user_id, CASE WHEN n >= 14 THEN 'high' WHEN n >= 9 THEN 'elevated' ELSE 'normal' END AS band, n FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id)""",
)
def rul15_graded_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-15..19/23: counters graded by bands."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", U.graded(F.col("n"), [(9, "elevated"), (14, "high")], "normal").alias("band"), "n")


@register(
    "rul22_directional",
    """WITH s AS (SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS parents FROM lineitem GROUP BY 1), l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 30 THEN 3 ELSE 1 END AS i, CASE WHEN l_tax < 0.06 THEN 3 ELSE 2 END AS o, l_discount AS e, parents = 1 AS sole FROM lineitem JOIN s USING (l_partkey))
    SELECT l_orderkey, l_linenumber, CASE WHEN i = 3 AND o = 3 AND e < 0.05 THEN 'STRONG' WHEN e >= 0.09 AND sole THEN 'POOR' ELSE 'MODERATE' END AS verdict FROM l""",
)
def rul22_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-21/22: the quality of links in both directions; poor only on a sole path."""
    lines = table(spark, sf_dir, "lineitem")
    sole = lines.groupBy("l_partkey").agg((F.count_distinct("l_suppkey") == 1).alias("sole"))
    out = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount").join(sole, "l_partkey")
    verdict = U.directional(F.when(F.col("l_quantity") >= 30, 3).otherwise(1), F.when(F.col("l_tax") < 0.06, 3).otherwise(2), F.col("l_discount"), F.col("sole"))
    return out.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


# --- comparisons


@register(
    "cmp01_reason_codes",
    """WITH p AS (SELECT event_id, event_type, value, LAG(event_type) OVER w AS bt, LAG(value) OVER w AS bv, epoch_us(ts) - epoch_us(LAG(ts) OVER w) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, concat_ws(',', CASE WHEN bt IS NULL THEN 'baseline-missing' END, CASE WHEN bt <> event_type THEN 'subject-differs' END, CASE WHEN d > 604800000000 THEN 'gap-exceeded' END, CASE WHEN value < bv THEN 'reset-detected' END) AS reasons FROM p""",
)
def cmp01_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-01/02: why an event can't be compared with the one before, in a fixed order."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    p = e.select("event_id", "event_type", "value", "at", F.lag("event_type").over(w).alias("bt"), F.lag("value").over(w).alias("bv"), F.lag("at").over(w).alias("ba"))
    codes = U.reasons((F.col("bt").isNull(), "baseline-missing"), (F.col("bt") != F.col("event_type"), "subject-differs"), (F.col("at") - F.col("ba") > 604_800_000_000, "gap-exceeded"), (F.col("value") < F.col("bv"), "reset-detected"))
    return p.select("event_id", F.array_join(codes, ",").alias("reasons"))


@register(
    "cmp03_numeric_items",
    """WITH q AS (SELECT l_suppkey, year(l_shipdate) AS y, AVG(l_discount) AS r FROM lineitem GROUP BY 1, 2)
    SELECT COALESCE(a.l_suppkey, b.l_suppkey) AS l_suppkey, ROUND((b.r - a.r) * 100, 6) AS points, CASE WHEN a.r IS NULL OR b.r IS NULL THEN 'unknown' WHEN b.r - a.r > 0 THEN 'worsened' WHEN b.r - a.r < 0 THEN 'improved' ELSE 'unchanged' END AS direction
    FROM (SELECT * FROM q WHERE y = 1996) a FULL JOIN (SELECT * FROM q WHERE y = 1997) b ON a.l_suppkey = b.l_suppkey""",
)
def cmp03_numeric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-03/MTH-F03: ratios of two intervals compared, in points; one aggregation instead of a join."""
    y = F.year("l_shipdate")
    q = table(spark, sf_dir, "lineitem").where(y.isin(1996, 1997)).groupBy("l_suppkey").agg(F.avg(F.when(y == 1996, F.col("l_discount"))).alias("a"), F.avg(F.when(y == 1997, F.col("l_discount"))).alias("b"))
    change, direction = U.numeric_change(F.col("a"), F.col("b"), "ratio", False)
    return q.select("l_suppkey", F.round(change, 6).alias("points"), direction.alias("direction"))


@register(
    "cmp04_discrete_items",
    """WITH f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS a, arg_max(event_type, (ts, event_id)) AS b FROM events GROUP BY user_id)
    SELECT c_custkey, CASE WHEN a IS NULL THEN 'unknown' WHEN a = b THEN 'unchanged' ELSE a || '->' || b END AS change FROM customer LEFT JOIN f ON user_id = c_custkey""",
)
def cmp04_discrete_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-04: the transition of a category between two ends."""
    order = F.struct("ts", "event_id")
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min_by("event_type", order).alias("a"), F.max_by("event_type", order).alias("b"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(f, "c_custkey", "left").select("c_custkey", U.discrete_change(F.col("a"), F.col("b")).alias("change"))


@register(
    "cmp06_single_facts",
    "SELECT l_partkey, year(l_shipdate) AS y, MIN(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2 HAVING COUNT(DISTINCT l_suppkey) = 1",
)
def cmp06_single_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-06/07: facts without conflict, of each interval."""
    return U.single_fact(table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")), ["l_partkey", "y"], "l_suppkey")


@register(
    "cmp05_common_newer",
    """WITH s AS (SELECT o_custkey, o_orderpriority, MIN(o_orderdate) AS a, MAX(o_orderdate) AS b FROM orders GROUP BY 1, 2) SELECT o_custkey, MIN(o_orderpriority) AS source FROM s WHERE b > a GROUP BY o_custkey""",
)
def cmp05_common_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-05: the least source that both sides have, newer on the later side."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return s.where("b > a").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("source"))


# --- graphs


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the suppliers and parts of all lines; parts are numbered from 10 million up."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 10_000_000).alias("b"))


TRADE = "SELECT l_suppkey AS a, l_partkey + 10000000 AS b FROM lineitem"


@register("grf06_pairs", f"SELECT LEAST(a, b) AS low, GREATEST(a, b) AS high, COUNT(*) AS links FROM ({TRADE}) GROUP BY 1, 2")
def grf06_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-06: linked pairs with their parallel links."""
    return G.undirected(trade(spark, sf_dir), "a", "b")


@register("grf05_degrees", f"WITH e AS (SELECT DISTINCT a, b FROM ({TRADE})) SELECT node, COUNT(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node")
def grf05_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-05/AGG-24: distinct neighbours of each node."""
    return G.degrees(G.undirected(trade(spark, sf_dir), "a", "b"))


@register(
    "grf02_components",
    f"""WITH RECURSIVE e AS (SELECT a AS x, b AS y FROM ({TRADE}) UNION SELECT b, a FROM ({TRADE})),
    r(node, component) USING KEY (node) AS (
      SELECT DISTINCT x, x FROM e
      UNION
      SELECT e.x, MIN(r.component) FROM r JOIN e ON e.y = r.node JOIN recurring.r AS now ON now.node = e.x WHERE r.component < now.component GROUP BY e.x)
    SELECT node, component FROM r""",
)
def grf02_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-02: connected components of the links."""
    pairs = keep(G.undirected(trade(spark, sf_dir), "a", "b"))  # read for the nodes and for the links
    return G.components(G.both_ways(pairs).select("node").distinct(), pairs)


@register(
    "grf04_best_parent",
    f"""WITH s AS (SELECT b AS child, a AS parent, COUNT(*) AS score FROM ({TRADE}) GROUP BY 1, 2) SELECT child, arg_max(parent, (score, -parent)) AS parent, MAX(score) AS score FROM s GROUP BY child""",
)
def grf04_best_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-04: each child's parent by score, the lower id of equals."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 10_000_000).alias("child"), F.col("l_suppkey").alias("parent")).agg(F.count("*").alias("score"))
    return G.best_parent(lines, "child", "parent", "score")


@register(
    "grf11_isolated",
    "SELECT p_partkey + 10000000 AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY l_suppkey, l_partkey HAVING SUM(l_quantity) >= 80)",
)
def grf11_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-11: parts without a strong link."""
    return G.isolated(table(spark, sf_dir, "part").select((F.col("p_partkey") + 10_000_000).alias("node")), strong(spark, sf_dir))


def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-part pairs whose lines have 80 units or more together."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("low"), (F.col("l_partkey") + 10_000_000).alias("high"))
    return lines.agg(F.sum("l_quantity").alias("units")).where("units >= 80").select("low", "high")


STRONG = "SELECT l_suppkey AS low, l_partkey + 10000000 AS high FROM lineitem GROUP BY 1, 2 HAVING SUM(l_quantity) >= 80"
AROUND = f"links AS ({STRONG}), around AS (SELECT low AS node, high AS other FROM links UNION ALL SELECT high, low FROM links)"


def strong_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keep(strong(spark, sf_dir))
    return B.analysed(G.both_ways(pairs).select("node").distinct(), pairs)


@register(
    "grf01_bridges",
    f"""WITH RECURSIVE {AROUND}, reached(low, high, node) AS (  -- from a link's lower end without the link
      SELECT low, high, low FROM links
      UNION
      SELECT r.low, r.high, a.other FROM reached r JOIN around a ON a.node = r.node WHERE NOT (r.low = least(a.node, a.other) AND r.high = greatest(a.node, a.other))),
    whole(start, node) AS (SELECT DISTINCT low, low FROM links UNION SELECT w.start, a.other FROM whole w JOIN around a ON a.node = w.node),
    sizes AS (SELECT start, COUNT(*) AS n FROM whole GROUP BY start)
    SELECT low, high, COUNT(*) AS low_side, any_value(n) - COUNT(*) AS high_side FROM reached JOIN sizes ON start = low GROUP BY low, high HAVING NOT bool_or(node = high)""",
)
def grf01_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-01: links whose loss splits a component, with the sizes of both sides."""
    return B.bridges(strong_blocks(spark, sf_dir))


@register(
    "grf01_cut_nodes",
    f"""WITH RECURSIVE {AROUND}, reached(cut, start, node) AS (  -- from every neighbour of a node without the node
      SELECT node, other, other FROM around
      UNION
      SELECT r.cut, r.start, a.other FROM reached r JOIN around a ON a.node = r.node WHERE a.other <> r.cut),
    parts AS (SELECT cut, start, MIN(node) AS part, COUNT(*) AS size FROM reached GROUP BY cut, start)
    SELECT DISTINCT cut AS node, part, size FROM parts QUALIFY MIN(part) OVER (PARTITION BY cut) <> MAX(part) OVER (PARTITION BY cut)""",
)
def grf01_cut_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-01: nodes whose loss splits a component, with the parts that remain by their smallest node and size."""
    return B.cut_parts(strong_blocks(spark, sf_dir))


@register(
    "rul04_path_redundancy",
    f"""WITH RECURSIVE {AROUND}, whole(start, node) AS (SELECT DISTINCT node, node FROM around UNION SELECT w.start, a.other FROM whole w JOIN around a ON a.node = w.node),
    networks AS (SELECT node, MIN(start) AS network FROM whole GROUP BY node),
    reached(cut, start, node) AS (SELECT node, other, other FROM around UNION SELECT r.cut, r.start, a.other FROM reached r JOIN around a ON a.node = r.node WHERE a.other <> r.cut),
    firsts AS (SELECT cut, start, MIN(node) AS part FROM reached GROUP BY cut, start), cuts AS (SELECT cut FROM firsts GROUP BY cut HAVING MIN(part) <> MAX(part)),
    lost(low, high, node) AS (SELECT low, high, low FROM links UNION SELECT r.low, r.high, a.other FROM lost r JOIN around a ON a.node = r.node WHERE NOT (r.low = least(a.node, a.other) AND r.high = greatest(a.node, a.other))),
    bridges AS (SELECT low FROM lost GROUP BY low, high HAVING NOT bool_or(node = high)),
    sizes AS (SELECT network, COUNT(*) AS routers FROM networks GROUP BY network), c AS (SELECT network, COUNT(*) AS n FROM cuts JOIN networks ON node = cut GROUP BY network), b AS (SELECT network, COUNT(*) AS n FROM bridges JOIN networks ON node = low GROUP BY network)
    SELECT s.network, routers, COALESCE(b.n, 0) AS bridges, COALESCE(c.n, 0) AS cuts, CASE WHEN COALESCE(b.n, 0) + COALESCE(c.n, 0) > 0 THEN 'MODERATE' ELSE 'STRONG' END AS verdict FROM sizes s LEFT JOIN b USING (network) LEFT JOIN c USING (network)""",
)
def rul04_path_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-04: redundancy of each network's paths, from its bridges and cut nodes."""
    found = strong_blocks(spark, sf_dir)
    cuts = B.cut_parts(found).select("node").distinct().withColumn("cut", F.lit(1))
    each = found.join(cuts, "node", "left").groupBy(F.col("root").alias("network")).agg(
        F.count("*").alias("routers"), F.count("parent").alias("links"), F.count_if(F.expr("parent IS NOT NULL AND low >= depth")).alias("bridges"), F.count("cut").alias("cuts")
    )
    return each.select("network", "routers", "bridges", "cuts", U.path_redundancy(F.col("routers"), F.col("links"), F.col("bridges") + F.col("cuts")).alias("verdict"))


@register(
    "grf03_depths",
    f"""WITH RECURSIVE {AROUND}, reached(start, node) AS (SELECT DISTINCT node, node FROM around UNION SELECT r.start, a.other FROM reached r JOIN around a ON a.node = r.node),
    roots AS (SELECT node, MIN(start) AS root FROM reached GROUP BY node),
    walk(node, depth) USING KEY (node) AS (
      SELECT DISTINCT root, 0 FROM roots
      UNION
      SELECT a.other, MIN(w.depth) + 1 FROM walk w JOIN around a ON a.node = w.node LEFT JOIN recurring.walk AS now ON now.node = a.other WHERE now.node IS NULL GROUP BY a.other)
    SELECT w.node, w.depth, MIN(above.node) AS parent FROM walk w LEFT JOIN (SELECT a.other, u.node, u.depth FROM around a JOIN walk u ON u.node = a.node) above ON above.other = w.node AND above.depth = w.depth - 1 GROUP BY w.node, w.depth""",
)
def grf03_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-03: breadth-first depth and least parent of every node from its component's smallest."""
    pairs = strong(spark, sf_dir)
    roots = G.components(G.both_ways(pairs).select("node").distinct(), pairs).select(F.col("component").alias("node")).distinct()
    return G.depths(pairs, roots)


@register(
    "jon16_entities",
    """WITH RECURSIVE r AS (SELECT c_custkey AS id, 'a' || CAST(c_custkey % 97 AS VARCHAR) || c_mktsegment AS k1, CASE WHEN c_custkey % 2 = 0 THEN 'b' || CAST(c_custkey // 10 AS VARCHAR) END AS k2 FROM customer),
    k AS (SELECT id, k1 AS k FROM r UNION ALL SELECT id, k2 FROM r WHERE k2 IS NOT NULL), e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b ON a.k = b.k), c(node, reach) AS (SELECT id, id FROM r UNION SELECT c.node, e.y FROM c JOIN e ON e.x = c.reach)
    SELECT node AS id, MIN(reach) AS entity FROM c GROUP BY node""",
)
def jon16_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16/18: records that share identity keys, directly or through others, as one entity."""
    k = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("a"), (k % 97).cast("string"), "c_mktsegment").alias("k1"), F.when(k % 2 == 0, F.concat(F.lit("b"), F.floor(k / 10).cast("string"))).alias("k2")
    )
    return G.resolve_entities(records, "id", ["k1", "k2"])


# --- history


@register(
    "mut01_upsert",
    """WITH all_rows AS (SELECT c_custkey AS id, c_name AS label, 10 AS rank, 0 AS seen FROM customer UNION ALL SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN 20 ELSE 5 END, 1 FROM supplier)
    SELECT id, arg_max(label, (rank, seen)) AS label, MAX(rank) AS rank FROM all_rows GROUP BY id""",
)
def mut01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MUT-01/STR-03: an upsert that lower ranks and older rows don't win."""
    old = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS label", "10 AS rank", "0 AS at")
    new = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS label", "IF(s_acctbal > 0, 20, 5) AS rank", "1 AS at")
    return old.union(new).groupBy("id").agg(F.max_by("label", F.struct("rank", "at")).alias("label"), F.max("rank").alias("rank"))


@register("mut03_enrol_absent", "SELECT s_suppkey AS id, s_name AS label FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def mut03_enrol_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MUT-03: labels added only for members that the roster lacks."""
    ordering = table(spark, sf_dir, "orders").select("o_custkey")
    roster = table(spark, sf_dir, "customer").join(ordering, F.col("c_custkey") == F.col("o_custkey"), "left_semi").selectExpr("c_custkey AS id", "c_name AS label")
    labels = table(spark, sf_dir, "supplier").join(ordering, F.col("s_suppkey") == F.col("o_custkey"), "left_anti").selectExpr("s_suppkey AS id", "s_name AS label")
    return roster.union(labels)


@register(
    "mut02_roster_state",
    """WITH f AS (SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, ts, event_id FROM events)
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, COUNT(*) AS revision FROM f WHERE n = 1 GROUP BY user_id""",
)
def mut02_roster_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MUT-02: each member's state from a log of actions; a request that is repeated counts once."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.max_by("event_type", "at").alias("state"), F.count("*").alias("revision"))


@register(
    "mut05_purge_counts",
    "SELECT o_orderstatus, COUNT(DISTINCT o_orderkey) AS orders, COUNT(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_orderstatus",
)
def mut05_purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MUT-05: what a purge up to a cut-off would delete, with its dependents."""
    old = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return old.join(lines, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


@register(
    "str02_completeness",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT event_type) AS kinds, COUNT(*) FILTER (WHERE props IS NULL) AS broken FROM events GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, CASE WHEN kinds < (SELECT COUNT(DISTINCT event_type) FROM events) THEN 'partial' WHEN broken > 0 THEN 'degraded' ELSE 'complete' END AS completeness FROM s""",
)
def str02_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: whether an observation has all its sources, some broken, or not all."""
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.count_distinct("event_type").alias("all_kinds"))  # one row
    s = e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("event_type").alias("kinds"), F.count_if(F.col("props").isNull()).alias("broken"))
    state = F.when(F.col("kinds") < F.col("all_kinds"), "partial").when(F.col("broken") > 0, "degraded").otherwise("complete")
    return s.crossJoin(F.broadcast(kinds)).select("day", state.alias("completeness"))
