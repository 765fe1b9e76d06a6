"""Event streams: windowed statistics and running totals, written so that a batch that runs again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The rows of a Parquet folder or file, and those of files that come later."""
    schema = spark.read.parquet(path).schema
    # a path without a pattern has to be a folder; a pattern that only matches itself may be a file as well
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed(events: DataFrame, by: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start (seconds), by, n, total for each window of time. Events that come later than ``late`` after the newest are dropped; so state stays bounded."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), by)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.unix_seconds("w.start").alias("start"), by, "n", "total")


def activity(events: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, last (microseconds) and total so far. State is a row for each key."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"), F.sum(value).alias("total"))


def settle(changes: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream of updates over all that is there, and returns the newest row of each key.

    Each batch overwrites its own folder, named by its number, so a batch that is run again after a failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark = changes.sparkSession
    query = changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "batch")
