"""All registered queries of the library with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "agg01_count_distinct"


def register(name: str, sql: str | None = None):
    """Add a query, and its oracle where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


@register(
    "agg01_count_distinct",
    "SELECT event_type, COUNT(*) AS n_events, COUNT(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
)
def agg01_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: row count and distinct count of a group."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))
    )


def load_all() -> None:
    """Import the modules that register queries."""
    from meshlake.plans import devices, diagnostics, domain, evidence, projections, reconciliation, relational  # noqa: F401
    from meshlake.streaming import queries  # noqa: F401


load_all()
