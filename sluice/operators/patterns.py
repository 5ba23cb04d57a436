"""Patterns: clusters counted, filtered, ranked and shown by examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import priority


def count_patterns(mined: DataFrame, least: int = 1) -> DataFrame:
    """cluster, template (of the first line), count; clusters of ``least`` lines or more."""
    counted = mined.groupBy("cluster").agg(F.min_by("template", "line_no").alias("template"), F.count(F.lit(1)).alias("count"))
    return counted.where(F.col("count") >= least)


def rank_patterns(counted: DataFrame, most: int) -> DataFrame:
    """The ``most`` patterns of the highest priority, with ``priority`` and ``rank`` from 1; ties in first-seen order."""
    top = counted.withColumn("priority", priority(F.col("count"), F.col("template"))).orderBy(F.desc("priority"), "cluster").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "cluster")))  # at most ``most`` rows


def examples(mined: DataFrame, ranked: DataFrame, each: int) -> DataFrame:
    """pos, line, rank: the first ``each`` lines of each ranked pattern.

    Each task first keeps its own first lines of a cluster, so a cluster of any
    size sends few rows on.
    """
    top = mined.select("line_no", "line", "cluster").join(F.broadcast(ranked.select("cluster", "rank")), "cluster")  # limited by max_patterns
    salted = Window.partitionBy("cluster", "salt").orderBy("line_no")
    top = top.withColumn("salt", F.pmod(F.xxhash64("line_no"), F.lit(32))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= each)
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("line_no"))).where(F.col("n") <= each)
    return top.select((F.row_number().over(Window.orderBy("rank", "n")) - 1).cast("long").alias("pos"), "line", "rank")
