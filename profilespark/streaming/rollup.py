"""Events rolled up by hour and type, in batch or as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rollup(events: DataFrame) -> DataFrame:
    """hour, event_type, n, total. Rows without a time are left out."""
    rows = events.where("ts IS NOT NULL").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def stream_rollup(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """The same of a streaming frame, appended to parquet once an hour is past the watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = rows.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
