"""Lines as DataFrames: numbering, normalising, exact and near de-duplication.

Lines are (line_no, line).  Order is that of ``line_no``, which every operator
carries along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.text import strip, words

#: Bands and rows a band for a similarity threshold, of 64 hash values.
BANDS = {0.8: (5, 11), 0.9: (3, 21)}
#: Undecided rows that near de-duplication leaves to one task.
REST = 500_000


def from_list(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    """Lines as they are, blanks included."""
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def from_table(df: DataFrame, order_by: str | Column | None = None) -> DataFrame:
    """The first column of a table as lines; numbered by ``order_by``, an integer column, or by partition."""
    number = F.monotonically_increasing_id() if order_by is None else (F.col(order_by) if isinstance(order_by, str) else order_by).cast("long")
    return df.select(number.alias("line_no"), df[df.columns[0]].cast("string").alias("line"))


def normalise(lines: DataFrame) -> DataFrame:
    """Stripped lines; nulls and blanks go."""
    return lines.where("line IS NOT NULL").withColumn("line", strip(F.col("line"))).where("line <> ''")


def exact_dedup(lines: DataFrame) -> DataFrame:
    """The first of equal lines, over all of the input."""
    return lines.groupBy("line").agg(F.min("line_no").alias("line_no")).select("line_no", "line")


def dedup_stats(lines: DataFrame) -> DataFrame:
    """total, unique and duplicates, in one row."""
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counted.agg(total.cast("long").alias("total"), F.count(F.lit(1)).alias("unique"), (total - F.count(F.lit(1))).cast("long").alias("duplicates"))


def banding(threshold: float, values: int = 64) -> tuple[int, int]:
    """Bands and rows that balance false candidates and misses about a threshold."""
    if threshold in BANDS:
        return BANDS[threshold]
    steps = [i / 1000 for i in range(1000)]

    def loss(b: int, r: int) -> float:
        hit = [1 - (1 - s**r) ** b for s in steps]
        return sum(h for h, s in zip(hit, steps, strict=True) if s < threshold) + sum(1 - h for h, s in zip(hit, steps, strict=True) if s >= threshold)

    return min(((b, r) for b in range(1, values + 1) for r in range(1, values // b + 1)), key=lambda x: loss(*x))


def _in_order(open_: DataFrame) -> DataFrame:
    """The lines of (line_no, bucket) that go, found in one pass by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[int] = set()
        line, own, gone = None, [], []

        def decide() -> None:
            if held.isdisjoint(own):
                held.update(own)
            else:
                gone.append(line)

        for batch in batches:
            for number, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != line:
                    if own:
                        decide()
                    line, own = number, []
                own.append(bucket)
        if own:
            decide()
        yield pa.RecordBatch.from_arrays([pa.array(gone, type=pa.int64())], names=["line_no"])

    return open_.select("line_no", "bucket").repartition(1).sortWithinPartitions("line_no").mapInArrow(run, "line_no long")


def near_dedup(lines: DataFrame, threshold: float) -> DataFrame:
    """Lines that share no MinHash band with an earlier line that stays.

    A line stays once it is the least undecided line of all its buckets; all
    later lines of those buckets go.  Rounds repeat, with one aggregate each and no
    pairs, until what is undecided has no more than REST rows, and one task
    goes through it in order; so long chains of conflicts cost no round a link.
    """
    bands, rows = banding(threshold)
    found = lines.withColumn("w", words(F.col("line")))
    signature = F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lambda i: F.array_min(F.transform("w", lambda w: F.xxhash64(w, i))))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, F.lit(rows))))
    buckets = found.withColumn("sig", signature).select("line_no", F.explode(keys).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    open_ = cut(buckets.join(shared, "bucket", "left_semi"))
    gone: DataFrame | None = None
    while few := open_.limit(REST + 1).count():
        if few <= REST:
            dropped = cut(_in_order(open_))
            gone = dropped if gone is None else gone.unionByName(dropped)
            break
        heads = open_.groupBy("bucket").agg(F.min("line_no").alias("head"))
        marked = cut(open_.join(heads, "bucket"))
        kept = marked.groupBy("line_no").agg(F.bool_and(F.col("line_no") == F.col("head")).alias("stays")).where("stays").select(F.col("line_no").alias("kept"))
        # the head of a bucket that stays takes all the others of it along
        of_kept = marked.join(kept, F.col("head") == F.col("kept"), "left")
        decided = cut(of_kept.groupBy("line_no").agg(F.bool_or((F.col("kept") != F.col("line_no")) & F.col("kept").isNotNull()).alias("goes"), F.bool_and(F.col("line_no") == F.col("head")).alias("stays")).where("goes OR stays").select("line_no", "goes"))
        dropped = decided.where("goes").select("line_no")
        gone = dropped if gone is None else gone.unionByName(dropped)
        open_ = cut(open_.join(decided, "line_no", "left_anti"))
    return lines if gone is None else lines.join(gone, "line_no", "left_anti")
