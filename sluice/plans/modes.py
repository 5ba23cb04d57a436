"""The reduction modes: lines in, (pos, line) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..config import Level, Mode, Settings
from ..operators import anomaly, lines as L, patterns, sampling, templates, temporal


def _numbered(parts: list[DataFrame]) -> DataFrame:
    """Parts of (key, line), each in the order of its key, one after the other."""
    both = None
    for i, part in enumerate(parts):
        part = part.select(F.lit(i).alias("part"), F.col("key").cast("double"), F.col("line_no").cast("long"), "line")
        both = part if both is None else both.unionByName(part)
    return both.select((F.row_number().over(Window.orderBy("part", "key", "line_no")) - 1).cast("long").alias("pos"), "line")


def mine(lines: DataFrame, settings: Settings, fuzzy: bool = False, miner: str = "drain") -> DataFrame:
    unique = L.exact_dedup(lines)
    if fuzzy and settings.fuzzy_threshold is not None:
        unique = L.near_dedup(cut(unique), settings.fuzzy_threshold)
    if miner == "mask":
        return templates.mask_miner(unique)
    return templates.drain_miner(unique, settings.drain_similarity, settings.max_clusters, settings.typed_masking)


def pattern_mode(lines: DataFrame, settings: Settings, fuzzy: bool = False, miner: str = "drain") -> DataFrame:
    """The first examples of the patterns of the highest priority, of distinct lines."""
    mined = cut(mine(lines, settings, fuzzy, miner))
    ranked = patterns.rank_patterns(patterns.count_patterns(mined, settings.min_pattern_occurrences), settings.max_patterns)
    return patterns.examples(mined, ranked, settings.examples_per_pattern).select("pos", "line")


def _unusual(lines: DataFrame, settings: Settings) -> tuple[DataFrame | None, DataFrame]:
    unique = L.exact_dedup(lines)
    if settings.anomaly_max_rows:
        unique = sampling.sample_lines(unique, settings.anomaly_max_rows)
    return anomaly.split_anomalies(cut(unique), settings.anomaly_contamination)


def anomaly_mode(lines: DataFrame, settings: Settings) -> DataFrame:
    """The most unusual lines, then a sample of the others."""
    odd, normal = _unusual(lines, settings)
    some = sampling.sample_lines(normal, settings.max_patterns // 4).withColumn("key", F.lit(0.0))
    if odd is None:
        return _numbered([some])
    return _numbered([odd.orderBy("score", "line_no").limit(settings.max_patterns // 2).withColumnRenamed("score", "key"), some])


def temporal_mode(lines: DataFrame, settings: Settings, year: int | None = None) -> DataFrame:
    parsed = temporal.parse_lines(lines, year)
    return temporal.select_temporal(parsed, settings.temporal_window_minutes, settings.max_patterns).select("pos", "line")


def hybrid_mode(lines: DataFrame, settings: Settings, fuzzy: bool = False) -> DataFrame:
    """Half unusual lines, half pattern examples, distinct, at most ``max_patterns``."""
    half = settings.max_patterns // 2
    odd, _ = _unusual(lines, settings)
    parts = [pattern_mode(lines, settings, fuzzy).orderBy("pos").limit(half).select(F.col("pos").alias("key"), F.col("pos").alias("line_no"), "line")]
    if odd is not None:
        parts.insert(0, odd.orderBy("score", "line_no").limit(half).withColumnRenamed("score", "key"))
    first = _numbered(parts).groupBy("line").agg(F.min("pos").alias("pos")).orderBy("pos").limit(settings.max_patterns)
    return first.select((F.row_number().over(Window.orderBy("pos")) - 1).cast("long").alias("pos"), "line")


def reduce_lines(lines: DataFrame, mode: Mode, level: Level, settings: Settings) -> DataFrame:
    fuzzy = level in (Level.ENHANCED, Level.MAXIMUM)
    if mode is Mode.PATTERN:
        return pattern_mode(lines, settings, fuzzy)
    if mode is Mode.ANOMALY:
        return anomaly_mode(lines, settings)
    if mode is Mode.TEMPORAL:
        return temporal_mode(lines, settings)
    return hybrid_mode(lines, settings, fuzzy)
