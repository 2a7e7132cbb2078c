"""Reading the Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a dataset folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
