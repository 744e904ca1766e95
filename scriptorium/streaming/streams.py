"""Continuous ingest and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's files in the shared one."""
    return f"{shared_dir(spark)}/stream-{name}"


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its rows: appended ones from Parquet, a complete result (small) from a memory table."""
    spark: SparkSession = df.sparkSession
    place = checkpoint or folder(spark, name)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{place}/rows").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{place}/rows")
    w.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def ingest(docs: DataFrame, transform, place: str, **options) -> StreamingQuery:
    """Runs transform (DataFrame -> DataFrame), the same as in batch, on each micro-batch and appends its rows to place/rows.

    A document must come whole in one row. A batch that is tried again replaces its own folder, so no row is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(**(options or {"availableNow": True})).start()


def ingested(docs: DataFrame, transform, place: str) -> DataFrame:
    """The rows of ingest() once all that is there has been read."""
    ingest(docs, transform, place).awaitTermination()
    return docs.sparkSession.read.parquet(f"{place}/rows").drop("batch")


def monitor(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count, mean and maximum of value by tumbling window and event type, with late rows up to delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value", "max_value")


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def sliding(events: DataFrame, delay: str = "1 hour", width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Count and mean of value by overlapping windows and event type."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, delay: str = "1 hour", gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """(key, start, end, n): stretches of a key's events with no longer pause than gap."""
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
