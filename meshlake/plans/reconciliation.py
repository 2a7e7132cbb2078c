"""Reconciled reports, coverage of requests, discovered columns, and stores kept by fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlake.operators import coverage as V
from meshlake.operators import lattice as L
from meshlake.operators import prints as P
from meshlake.operators.pairs import PairStore, revision_at
from meshlake.plans.catalog import register
from meshlake.sources.shared import new_folder
from meshlake.sources.tables import table

#: How the reports of a customer (its orders) meet, field by field.
CUSTOMER_POLICY = {"ever_open": "ever", "top_price": "most", "name": "real", "note": "longest", "priorities": "union", "segment": "agreed", "status": "newest"}
REPORTS = {
    "ever_open": "o_orderstatus = 'O'",
    "top_price": "o_totalprice",
    "source_rank": "o_orderkey % 3",
    "name": "CASE WHEN o_orderkey % 5 = 0 THEN concat('found-', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 5 = 1 THEN concat('name-', CAST(o_orderkey % 7 AS STRING)) END",
    "note": "CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE concat(o_orderpriority, CAST(o_orderkey % 13 AS STRING)) END",
    "priorities": "array(o_orderpriority)",
    "segment": "CASE WHEN o_orderkey % 6 < 4 THEN 'Unknown' WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'fixed' END",
    "status": "o_orderstatus",
}
SQL_REPORTS = ", ".join(f"{x.replace('array(o_orderpriority)', '[o_orderpriority]').replace('AS STRING', 'AS VARCHAR')} AS {f}" for f, x in REPORTS.items())


@register(
    "evd06_reconciled",
    f"""WITH r AS (SELECT o_custkey, o_orderdate, {SQL_REPORTS} FROM orders), k AS (SELECT *, NULLIF(note, 'Unknown') AS known_note, NULLIF(segment, 'Unknown') AS known_segment FROM r),
    m AS (SELECT o_custkey, bool_or(ever_open) AS ever_open, MAX(top_price) AS top_price,
      arg_min(name, (starts_with(name, 'found-'), source_rank, name)) FILTER (name IS NOT NULL) AS name, arg_min(known_note, (-length(known_note), known_note)) FILTER (known_note IS NOT NULL) AS note,
      string_agg(DISTINCT priorities[1], ',' ORDER BY priorities[1]) AS priorities, string_agg(DISTINCT known_segment, ',' ORDER BY known_segment) AS segments, arg_max(status, (o_orderdate, status)) AS status FROM k GROUP BY o_custkey)
    SELECT o_custkey, ever_open, top_price, name, note, priorities, CASE WHEN NOT contains(segments, ',') THEN segments END AS segment, CASE WHEN contains(segments, ',') THEN segments END AS segment_conflict, status FROM m""",
)
def evd06_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-06: one record of each customer from its orders, by the policy of each field."""
    reports = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", *(F.expr(x).alias(f) for f, x in REPORTS.items()))
    found = L.reconciled(reports, ["o_custkey"], CUSTOMER_POLICY, "o_orderdate")
    return found.withColumns({c: F.array_join(c, ",") for c in ("priorities", "segment_conflict")})


ASKED = "SELECT o_custkey, o_orderkey, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS id, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@register(
    "evd09_coverage",
    f"""WITH a AS ({ASKED}), n AS (SELECT o_custkey, o_orderkey, COUNT(DISTINCT id) AS n FROM a WHERE id IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT o_custkey, arg_max(o_orderkey, (n, -o_orderkey)) AS o_orderkey, MAX(n) AS requested FROM n GROUP BY 1),
    g AS (SELECT DISTINCT o_custkey, id FROM a WHERE id IS NOT NULL AND o_orderstatus <> 'O'), r AS (SELECT o_custkey, COUNT(*) AS received FROM g GROUP BY 1),
    c AS (SELECT b.o_custkey, COUNT(DISTINCT a.id) AS covered FROM b JOIN a USING (o_custkey, o_orderkey) JOIN g ON g.o_custkey = a.o_custkey AND g.id = a.id GROUP BY 1)
    SELECT b.o_custkey, b.o_orderkey, requested, received, COALESCE(covered, 0) AS covered FROM b LEFT JOIN r USING (o_custkey) LEFT JOIN c USING (o_custkey)""",
)
def evd09_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-09: each customer's order with the most parts, and how many of these its finished orders have."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    asked = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus", F.expr("CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END").alias("id"))
    return V.coverage(asked, asked.where("o_orderstatus <> 'O'"), "o_custkey", "o_orderkey", "id")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_variant_object(F.struct("event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"), F.parse_json("props").alias("props")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), record.alias("record"))


@register(
    "prj05_columns",
    """WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), p AS (
      SELECT 'event_type' AS path, 'STRING' AS type, event_id FROM events
      UNION ALL SELECT 'value', CASE WHEN event_id % 3 > 0 AND value IS NOT NULL THEN 'DOUBLE' ELSE 'VOID' END, event_id FROM events
      UNION ALL SELECT 'props.' || key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(props, '$.' || key) END, event_id FROM k)
    SELECT path, string_agg(DISTINCT type, ',' ORDER BY type) AS types, COUNT(*) AS n, row_number() OVER (ORDER BY path <> 'value', MIN(event_id), path) - 1 AS "column" FROM p GROUP BY path""",
)
def prj05_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05: the columns that the events' records have, with types and counts, in display order."""
    found = V.ordered(V.paths(event_records(spark, sf_dir), "record"), ["value"])
    return found.withColumn("types", F.array_join("types", ","))


@register("prj05_projection", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def prj05_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05: the events' records as columns that were discovered in them, typed by what most of their values are."""
    records = event_records(spark, sf_dir)
    columns = V.ordered(V.paths(records, "record"), ["value"]).orderBy("column").collect()  # a row for each column of the schema
    typed = [(r.path, next((t for t in r.types if t != "VOID"), "STRING")) for r in columns]
    return V.projected(records, "record", typed).withColumnRenamed("place", "event_id")


@register("snk05_noop_write", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT MIN(o_orderkey) FROM orders) THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, 2 AS generations FROM orders")
def snk05_noop_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: orders materialised three times: as they are, the same rows dealt otherwise (nothing is written), and with one price changed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    kept = P.Materialised(spark, new_folder(spark, "orders"))
    least = orders.agg(F.min("o_orderkey").alias("least"))  # one row
    changed = orders.crossJoin(F.broadcast(least)).select("o_orderkey", (F.col("o_totalprice") + F.when(F.col("o_orderkey") == F.col("least"), 1.0).otherwise(0.0)).alias("o_totalprice"))
    for rows in (orders, orders.repartition(5, "o_totalprice"), changed):
        kept.write(rows)
    return kept.read().withColumn("generations", F.lit(len(kept.versions())))


@register(
    "evd18_damaged_chunks",
    "WITH p AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem) SELECT DISTINCT l_suppkey, place // 64 AS chunk, 'changed' AS fault FROM p WHERE l_orderkey % 1000 = 7",
)
def evd18_damaged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-18: the chunks of each supplier's lines in which planted changes are, found by Merkle trees."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    lines = table(spark, sf_dir, "lineitem").withColumn("place", place)
    trees = [P.merkle(P.chunk_digests(x, "l_suppkey", ["place"], 64), "l_suppkey") for x in (lines, lines.withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))))]
    return P.damaged(*trees, "l_suppkey")


@register(
    "str10_pages",
    "WITH s AS (SELECT COUNT(*) // 4 + 1 AS size FROM orders) SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // size AS page FROM orders, s",
)
def str10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: all orders in pages by date, each found from the token of the page before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    size, pages, token = orders.count() // 4 + 1, [], None
    while not pages or token:
        rows, token = P.page(orders, ["o_orderdate", "o_orderkey"], size, token)
        pages.append(rows.select("o_orderkey", F.lit(len(pages)).cast("long").alias("page")))
    return reduce(DataFrame.union, pages)


@register(
    "cmp10_stored_pairs",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id, ROUND(SUM(value), 2) AS s FROM events GROUP BY 1, 2), v AS (SELECT day, user_id, s + CASE WHEN day = DATE '2024-01-10' THEN 1 ELSE 0 END AS v FROM s),
    d AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM v)),
    a AS (SELECT d.before AS older_at, d.day AS newer_at, user_id, v AS x FROM d JOIN v ON v.day = d.before), b AS (SELECT d.before AS older_at, d.day AS newer_at, user_id, v AS y FROM d JOIN v ON v.day = d.day WHERE d.before IS NOT NULL)
    SELECT older_at, newer_at, user_id, x AS before, y AS after, CASE WHEN x IS NULL THEN 'appeared' WHEN y IS NULL THEN 'disappeared' ELSE 'changed' END AS change, (SELECT concat(COUNT(*) - 1, ',0,2') FROM d) AS derived
    FROM a FULL JOIN b USING (older_at, newer_at, user_id) WHERE x IS NULL OR y IS NULL OR x <> y""",
)
def cmp10_stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-10/MUT-08: each day compared with the one before it, three times: all pairs are derived, then none, then the two of a day that has changed."""
    day = F.to_date("ts")
    rows = table(spark, sf_dir, "events").groupBy(day.alias("day"), "user_id").agg(F.round(F.sum("value"), 2).alias("v"))
    changed = rows.withColumn("v", F.col("v") + F.when(F.col("day") == F.lit("2024-01-10").cast("date"), 1).otherwise(0))
    store = PairStore(spark, new_folder(spark, "pairs"))
    derived = [store.update(x, "day", "user_id", "v") for x in (rows, rows, changed)]
    return store.read(changed, "day").withColumn("derived", F.lit(",".join(map(str, derived))))


CONTRACTS = """WITH m AS (SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q FROM orders),
    r AS (SELECT priority, CAST(NULL AS VARCHAR) AS status, q FROM m WHERE priority < '3' GROUP BY ALL UNION ALL SELECT NULL, status, q FROM m WHERE status = 'F' AND month(q) = 1 GROUP BY ALL UNION ALL SELECT priority, status, q FROM m WHERE priority LIKE '2%' AND status = 'P' AND month(q) = 7
      UNION ALL SELECT NULL, NULL, MIN(q) + INTERVAL 1 YEAR FROM m)"""


@register(
    "evd13_revisions",
    f"""{CONTRACTS}, v AS (SELECT priority, status, q AS valid_from, lead(q) OVER (PARTITION BY priority, status ORDER BY q) AS valid_to, concat_ws('/', coalesce(priority, '*'), coalesce(status, '*'), CAST(year(q) * 12 + month(q) AS VARCHAR)) AS revision FROM r)
    SELECT o_orderkey, arg_max(revision, ((priority IS NOT NULL)::INT + (status IS NOT NULL)::INT, valid_from, revision)) FILTER (revision IS NOT NULL) AS revision
    FROM orders LEFT JOIN v ON o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to) AND coalesce(priority, o_orderpriority) = o_orderpriority AND coalesce(status, o_orderstatus) = o_orderstatus GROUP BY o_orderkey""",
)
def evd13_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVD-13: the contract that held for each order at its date: chains of quarterly revisions by priority, by status, by both, and for all from the second year on."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    quarters = orders.select("priority", "status", F.date_trunc("quarter", "o_orderdate").alias("q")).distinct()
    none = F.lit(None).cast("string")
    kinds = [
        quarters.where("priority < '3'").select("priority", none.alias("status"), "q"),
        quarters.where("status = 'F' AND month(q) = 1").select(none.alias("priority"), "status", "q"),
        quarters.where("priority LIKE '2%' AND status = 'P' AND month(q) = 7").select("priority", "status", "q"),
        quarters.agg((F.min("q") + F.expr("INTERVAL '1' YEAR")).alias("q")).select(none.alias("priority"), none.alias("status"), "q"),
    ]
    begun = reduce(DataFrame.union, kinds).distinct()
    chain = Window.partitionBy("priority", "status").orderBy("q")  # a row for each quarter
    name = F.concat_ws("/", F.coalesce("priority", F.lit("*")), F.coalesce("status", F.lit("*")), (F.year("q") * 12 + F.month("q")).cast("string"))
    revisions = begun.select("priority", "status", F.col("q").alias("valid_from"), F.lead("q").over(chain).alias("valid_to"), name.alias("revision"))
    return revision_at(orders, revisions, "o_orderdate", ["priority", "status"]).select("o_orderkey", "revision")
