"""Label files and events that keep arriving. Departures need no state; counts per time window have a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagefold.operators.drift import departures, file_headers


def departure_stream(files: DataFrame, declared: dict, key: str = "file_path", body: str = "body", inner: str | None = None) -> DataFrame:
    """Departures of each arriving file, as for a batch: parsing and comparing are row by row."""
    return departures(file_headers(files, key, body, inner), declared, key)


def windowed_timings(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Count, total and greatest value per type and window; events later than ``late`` are dropped once their window is out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total"), F.max("value").alias("max")).select(F.col("window.start").alias("start"), "event_type", "count", "total", "max")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended exactly once to parquet; restarts go on where they stopped."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
