"""Tables written to the folder that the driver and all executors share, to cut lineage and to outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared one; it isn't created yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """The rows as a written table: a plan of its own, without what led to it.

    For loops: with checkpoint() in its place planning took longer from round to round.
    """
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*kept: DataFrame) -> None:
    """Delete the files behind kept tables that no later plan reads."""
    for df in kept:
        for file in df.inputFiles()[:1]:
            delete(df.sparkSession, file.rpartition("/")[0])


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
