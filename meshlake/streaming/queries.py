"""Streams over the events table, run to the end of their input; results are Parquet in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.plans.catalog import register
from meshlake.sources.shared import new_folder
from meshlake.streaming import processors, state


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    whole = spark.read.parquet(path)
    stream = spark.readStream.schema(whole.schema)
    if any(f.rstrip("/").endswith("/events.parquet") for f in whole.inputFiles()[:1]):  # the file source reads folders; here the table is one file
        stream, path = stream.option("pathGlobFilter", "events.parquet"), sf_dir
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, folder: str) -> DataFrame:
    """Write all that a stream gives until its input ends."""
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def told(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """All that a stream with timers tells, batch by batch, until its input ends; a batch that runs again overwrites only its own rows."""
    spark = df.sparkSession
    before = spark.conf.get(processors.PROVIDER)
    spark.conf.set(processors.PROVIDER, processors.ROCKS)  # timers and lists need it
    try:
        write = df.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"))
        query = write.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(processors.PROVIDER, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/out").select(*df.columns)


@register("str04_once", "SELECT event_id, user_id FROM events")
def str04_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: idempotent ingestion of a stream by id."""
    once = state.once(events_stream(spark, sf_dir), "event_id", "ts", "3650 days")
    return finished(once.select("event_id", "user_id"), new_folder(spark, "stream"))


@register(
    "str05_last_known",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
)
def str05_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03/05: the last-known row of each user, upserted batch by batch; older facts never win."""
    folder = new_folder(spark, "stream")
    known = state.LastKnown(f"{folder}/known", "user_id", ["ts", "event_id"], ["ts", "event_id", "value"])
    query = known.start(events_stream(spark, sf_dir), f"{folder}/log")
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(known.path(last)).select("user_id", "event_id", "value")


@register(
    "str01_windows",
    "WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM events)",
)
def str01_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01/11: counts in hours of event time, given out once the watermark has passed an hour."""
    return finished(state.windowed_counts(events_stream(spark, sf_dir), "ts", "event_type"), new_folder(spark, "stream"))


@register(
    "str06_absences",
    "WITH last AS (SELECT user_id, MAX(CAST(ts AS DATE)) AS day FROM events GROUP BY user_id) SELECT user_id, date_diff('day', day, (SELECT MAX(day) FROM last)) AS absent FROM last",
)
def str06_absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06: days since each user was present, kept by a stateful stream with timers; the count at the end of its input."""
    rows = told(processors.absences(events_stream(spark, sf_dir), "user_id", "ts"), new_folder(spark, "stream"), "update")
    return rows.groupBy(F.col("key").alias("user_id")).agg(F.min_by("absent", F.struct(-F.col("as_of"), "absent")).alias("absent"))


@register(
    "str07_counter_changes",
    """WITH p AS (SELECT event_id, value, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    SELECT event_id, CASE WHEN previous IS NULL THEN 'first' WHEN value < previous THEN 'reset-detected' ELSE 'delta' END AS kind, CASE WHEN value >= previous THEN ROUND(value - previous, 6) END AS delta FROM p""",
)
def str07_counter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: changes of each user's counter in event time, with resets told apart, by a stateful stream."""
    rows = told(processors.counter_changes(events_stream(spark, sf_dir), "user_id", "ts", "event_id", "value"), new_folder(spark, "stream"), "append")
    return rows.select(F.col("id").alias("event_id"), "kind", F.round("delta", 6).alias("delta"))


@register(
    "str09_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k HAVING MAX(ts) + INTERVAL 30 MINUTE <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def str09_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: each user's sessions that an idle time of half an hour has ended."""
    return finished(state.sessions(events_stream(spark, sf_dir), "ts", "user_id"), new_folder(spark, "stream")).select("user_id", "start", "n")
