"""Extension: sessions and activity windows on event streams; the same functions serve batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """A user's events in sessions that end after a gap; on a stream, events up to late behind the latest count."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select("user_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n", "total")


def density(events: DataFrame, window: str = "2 days", hop: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each type in hopping windows."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("at", window, hop).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select("event_type", F.col("w.start").alias("start_at"), "n")


def replayed(spark: SparkSession, folder: str, name: str, query, sink: str) -> DataFrame:
    """A folder's Parquet files of events read as a stream through query until none is left, and what it emitted."""
    from tessera.sources.tables import table

    schema = table(spark, folder, name).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(folder)
    run = query(stream).writeStream.format("memory").queryName(sink).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(sink)
