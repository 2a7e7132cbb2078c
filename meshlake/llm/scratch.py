"""Tables written to the folder that all executors share, to cut lineage and to recover from lost executors."""

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


def small_batches(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Whole texts go to Python in batches of so many rows at most (a session that asks for fewer keeps its setting)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
    return spark


def keep(df: DataFrame) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it back: a short plan that a lost executor doesn't undo."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*kept: DataFrame) -> None:
    """Delete the files behind kept DataFrames that no later plan reads."""
    for df in kept:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
