"""Event-time sessions of a stream, rows that arrive twice, and a count of those that come too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.sources.storage import fresh_path


def session_windows(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n, total): runs of a key's events with less than `gap` between them, as they close.

    A session ends `gap` after its last event and is given once the watermark has passed its end. An event that is later
    than `late` is dropped. Partial sessions merge before and after the shuffle, so a key with very many events brings
    a row for each of its sessions in a task, not one for each event.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", F.round("total", 4).alias("total"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """events without rows whose key came before within the watermark's delay; state is kept for that long only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """(rows, late): what the stream wrote at path so far, and how many rows its operators dropped in this run because
    they came after the watermark. A later call with the same path goes on where this one ended."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "windows")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])
    return spark.read.schema(stream.schema).parquet(path), late
