"""Log lines as streams: bounded-state de-duplication and template mining by masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import level_of, mask_types, strip, timestamp_of


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files of a folder as (line, ts, level, arrived)."""
    text = spark.readStream.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")
    return text.select("line", timestamp_of(F.col("line")).alias("ts"), level_of(F.col("line")).alias("level"), F.current_timestamp().alias("arrived"))


def dedup_stream(lines: DataFrame, time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first of equal lines within the watermark; state is dropped behind it."""
    return lines.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["line"])


def template_windows(lines: DataFrame, minutes: int = 60, time_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Lines of each masked template in tumbling windows."""
    masked = lines.withColumn("template", mask_types(F.col("line")))
    if lines.isStreaming:
        masked = masked.withWatermark(time_col, delay)
    counted = masked.groupBy(F.window(time_col, f"{minutes} minutes").alias("w"), "template").agg(F.count(F.lit(1)).alias("lines"))
    return counted.select(F.col("w.start").alias("start"), "template", "lines")
