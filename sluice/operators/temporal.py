"""Lines in time: parsing, windows, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.text import level_of, strip, timestamp_of
from .templates import drain_miner


def parse_lines(lines: DataFrame, year: int | None = None) -> DataFrame:
    """line_no, line (stripped), ts, level."""
    return lines.select("line_no", strip(F.col("line")).alias("line"), timestamp_of(F.col("line"), year).alias("ts"), level_of(F.col("line")).alias("level"))


def windows(parsed: DataFrame, minutes: int = 60) -> DataFrame:
    """Timed lines with ``window_key``, the number of their window since the epoch."""
    return parsed.where("ts IS NOT NULL").withColumn("window_key", F.floor(F.unix_timestamp("ts") / F.lit(minutes * 60)).cast("long"))


def select_temporal(parsed: DataFrame, minutes: int, most: int, timeless: int = 100) -> DataFrame:
    """pos, line, window_key: the first ``most`` timed lines by first appearance of their window, then timeless ones."""
    timed = windows(parsed, minutes)
    begun = timed.groupBy("window_key").agg(F.min("line_no").alias("begun"))
    timed = timed.join(begun, "window_key").orderBy("begun", "line_no").limit(most)
    rest = parsed.where("ts IS NULL").orderBy("line_no").limit(timeless)
    both = timed.select(F.lit(0).alias("part"), "begun", "line_no", "line", "window_key").unionByName(rest.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("begun"), "line_no", "line", F.lit(None).cast("long").alias("window_key")))
    return both.select((F.row_number().over(Window.orderBy("part", "begun", "line_no")) - 1).cast("long").alias("pos"), "line", "window_key")


def hourly(parsed: DataFrame) -> DataFrame:
    return parsed.where("ts IS NOT NULL").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("lines"))


def levels(parsed: DataFrame) -> DataFrame:
    return parsed.where("ts IS NOT NULL AND level IS NOT NULL").groupBy("level").agg(F.count(F.lit(1)).alias("lines"))


def window_templates(parsed: DataFrame, minutes: int = 60, similarity: float = 0.4) -> DataFrame:
    """window_key, cluster, template, lines, example: the templates mined in each window apart, and those of timeless lines (no window_key).

    The template is that of the cluster's first line, which is also its example.  A line without a time is in one group of
    its own kind; windows are mined in parallel.
    """
    timed = windows(parsed, minutes).select("line_no", "line", "window_key")
    rest = parsed.where("ts IS NULL").select("line_no", "line", F.lit(None).cast("long").alias("window_key"))
    both = timed.unionByName(rest)
    mined = drain_miner(both, similarity, by="window_key").join(both.select("line_no", "window_key"), "line_no")
    counted = mined.groupBy("window_key", "cluster").agg(F.min_by("template", "line_no").alias("template"), F.count(F.lit(1)).alias("lines"), F.min_by("line", "line_no").alias("example"))
    return counted.select("window_key", "cluster", "template", "lines", "example")


def temporal_summary(parsed: DataFrame, minutes: int = 60, similarity: float = 0.4) -> dict[str, DataFrame]:
    """What lines say over time: templates by window, timeless templates, and the distributions by hour and level."""
    mined = cut(window_templates(parsed, minutes, similarity))
    return {"windows": mined.where("window_key IS NOT NULL"), "timeless": mined.where("window_key IS NULL").drop("window_key"), "hourly": hourly(parsed), "levels": levels(parsed)}
