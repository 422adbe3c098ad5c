"""Operators that run alike over a stream and over a table.

Given a stream they need a watermark, which they set on ``ts``; given a table the
watermark has no effect and the result is that of the whole stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).option("recursiveFileLookup", "true").parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """``(window_start, event_type, events, value)`` per window, sliding ones if ``slide`` is given."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """``(user_id, session_start, session_end, events)``: a user's events with no pause of ``gap``."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once, duplicates being known as long as the watermark."""
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def micro_batches(events: DataFrame, seconds: float = 0.1, size: int = 6, expire: float = 2.0) -> DataFrame:
    """``(batch_start, batch_part, requests, expired)``: arrivals of each interval in parts of ``size``; those served later than ``expire`` are counted.

    A part waits one interval for each part before it.
    """
    micros = int(seconds * 1_000_000)
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / micros)
    counts = events.groupBy(start.alias("_s")).agg(F.count("*").alias("_n"))
    parts = counts.select("_s", "_n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / size).cast("int") - 1)).alias("batch_part"))
    requests = F.least(F.lit(size), F.col("_n") - F.col("batch_part") * size)
    return parts.select(F.timestamp_micros(F.col("_s") * micros).alias("batch_start"), "batch_part", requests.alias("requests"), F.when(F.col("batch_part") * seconds > expire, requests).otherwise(0).alias("expired"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there to Parquet, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
