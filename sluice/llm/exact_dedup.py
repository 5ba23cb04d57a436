"""Exact de-duplication by skew-safe combining, in DataFrame operations only.

Rows with equal normalised texts meet in three steps: inside each task (the
partial aggregate), inside each salted digest group, and at last between the
winners of the salts.  Each step groups by the digest *and the full text*, so
that no two different texts are ever taken for one.  The salt of a row is its
task's, so a group of copies of any size is one row a task after the first step
and at most ``salts`` rows after the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, text_or_empty


def _combine(keyed: DataFrame) -> DataFrame:
    """(digest, norm, salt, id) -> one row for each distinct text: digest, norm, keep, size."""
    salted = keyed.groupBy("digest", "norm", "salt").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    return salted.groupBy("digest", "norm").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  The largest id of a
    group stays.  Null texts count as empty.  Null ids lose against any other
    id; a group of null ids only has a null ``keep_id`` and all of it is kept.
    Rows that repeat one id and text each count in ``group_size`` and share the
    verdict.  An empty table gives an empty result; other columns are not read.
    """
    norm = ascii_lower(text_or_empty(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id", "norm", F.sha2("norm", 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    )
    winners = cut(
        _combine(keyed)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("contents"), F.max("keep").alias("keep"), F.max("size").alias("size"))
    )
    plain = winners.where("contents = 1").select("digest", "keep", "size")
    found = keyed.select("id", "digest").join(plain, "digest")
    contested = winners.where("contents > 1").select("digest")
    if not contested.isEmpty():  # different texts of one digest: only their full content tells them apart
        again = keyed.join(contested, "digest", "left_semi")
        found = found.unionByName(
            again.join(_combine(again).withColumnRenamed("digest", "d").withColumnRenamed("norm", "t"), (F.col("digest") == F.col("d")) & (F.col("norm") == F.col("t")))
            .select("digest", "id", "keep", "size")
        )
    return found.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
