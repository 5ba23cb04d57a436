"""Line de-duplication over levelled sorted runs of line hashes.

Documents are taken in batches of descending ids.  A batch's lines become a
run: one row for each line hash, sorted by it, with the number of documents
and the largest id among them.  The batch is merge-anti-joined with the runs
before it: hashes that no run holds enter with their keeper, the others add to
the count only.  When a level holds ``fan`` runs they are merged into one run
of the next level, so that a batch meets O(fan * log(batches)) runs.

In the end the runs know, for every line key, in how many documents it occurs
and which document keeps it; lines of frequent keys go from all the others.
Keys that hold a notable share of all (line, document) pairs are few by their
count, so they are broadcast; all others are too small to be skewed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, NumericType, StructField, StructType

from .common import LOWER, SPACE, UPPER, cut, free_names, fresh_path, ship, stored, text_or_empty, tidy

_LOWER = str.maketrans(UPPER, LOWER)
#: A key with more than one in so many of all pairs is broadcast: that many rows at most.
HOT = 50_000


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    line = line.strip(SPACE)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def key_hash(line: str, least_chars: int) -> bytes | None:
    """128 bits of a line's key, if it is long enough."""
    if len(line) < least_chars:
        return None
    key = line_key(line)
    return xxhash.xxh3_128_digest(key.encode()) if len(key) >= least_chars else None


class LineRuns:
    """Sorted runs of line hashes in the shared folder; ``levels[i]`` lists the runs of level i.

    ``add(batch)`` takes (hash, id) rows, one for each document and key, and
    returns the hashes that are new with their keepers.  Batches must come in
    descending id ranges, nulls last; later batches never take a key over.
    """

    def __init__(self, fan: int = 3):
        self.fan = fan
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        counted = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        if known := self.runs():
            # one merge join: the unmatched side is the anti-join, the matched side only adds to the counts
            seen = reduce(DataFrame.unionByName, [run.where("keeper IS NOT NULL").select("hash") for run in known]).withColumn("known", F.lit(True))
            counted = counted.join(seen.hint("merge"), "hash", "left").withColumn("keeper", F.when(F.col("known").isNull(), F.col("keeper"))).drop("known")
        run = cut(counted.sortWithinPartitions("hash"))
        self._push(run, 0)
        return run.where("keeper IS NOT NULL").select("hash", "keeper")

    def _push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            merged = cut(self.merged(self.levels[level]).sortWithinPartitions("hash"))
            self.levels[level] = []
            self._push(merged, level + 1)

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame:
        """The runs as one: the count of documents and the keeper of each hash."""
        runs = self.runs() if runs is None else runs
        return reduce(DataFrame.unionByName, runs).groupBy("hash").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def _pairs(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, hash): one row for each row of ``docs`` and each of its keys."""
    ship(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = {h for line in text.split("\n") if (h := key_hash(line, least_chars))} if len(text) >= least_chars else ()
                rows += [i] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array(hashes, type=pa.binary())], names=["id", "hash"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, hash binary")


def _batch(docs: DataFrame, id_col: str, batches: int) -> Column:
    """The batch of an id: 0 for the largest ones, ``batches`` for none; ids that are no numbers are one batch."""
    number = F.lit(0)
    if isinstance(docs.schema[id_col].dataType, NumericType) and batches > 1:
        at = [i / batches for i in range(1, batches)]
        bounds = docs.agg(F.percentile_approx(id_col, at)).first()[0] or []
        number = reduce(lambda x, b: x + (F.col("id") <= F.lit(b)).cast("int"), bounds, number)
    return F.when(F.col("id").isNull(), F.lit(batches)).otherwise(number)


def _without(rows: DataFrame, columns: list[str], text_col: str, drop: str, least_chars: int) -> DataFrame:
    """``columns`` of the rows with the texts that the hashes in ``drop`` leave, and n_lines and n_dropped."""
    at, wide = columns.index(text_col), rows.select(*columns, drop)
    schema = StructType([*(wide.schema[c] for c in columns), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(columns)), strict=True):
                lines = (text or "").count("\n") + 1
                n_lines.append(lines)
                if text and gone.is_valid:
                    hashes = set(gone.as_py())
                    left = [x for x in text.split("\n") if key_hash(x, least_chars) not in hashes]
                    text, lines = "\n".join(left), len(left)
                texts.append(text)
                n_dropped.append(n_lines[-1] - lines)
            kept = batch.columns[: len(columns)]
            kept[at] = pa.array(texts, type=kept[at].type)
            counts = [pa.array(x, type=pa.int64()) for x in (n_lines, n_dropped)]
            yield pa.RecordBatch.from_arrays([*kept, *counts], names=[*columns, "n_lines", "n_dropped"])

    return wide.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 9, fan: int = 3) -> DataFrame:
    """``docs`` with the texts that remain, and the columns n_lines and n_dropped.

    A text splits at ``\\n``; a null or empty one is one empty line.  A line's key
    is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of
    at least ``least_chars`` code points that occur in at least ``least_docs``
    documents lose all their lines but those in the largest id.  A document
    that lost nothing keeps its very text (a null text stays null); one that
    lost every line becomes empty.  Rows of one id count as one document and
    are cut alike; rows of a null id share one document, below all others.
    Ids may be of any ordered type.  Extra columns pass through, except that
    n_lines and n_dropped are replaced.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    path = fresh_path(spark, "line-hashes")
    pairs = _pairs(docs, id_col, text_col, least_chars).withColumn("batch", _batch(docs, id_col, batches))
    pairs.write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema(StructType([*pairs.schema.fields[:2], StructField("batch", IntegerType())])).parquet(path)

    runs = LineRuns(fan)
    for (batch,) in sorted(pairs.select("batch").distinct().collect()):  # no more than batches + 1 numbers
        runs.add(pairs.where(F.col("batch") == batch).select("hash", "id").distinct())
    drop, drop_id = free_names(docs, 2)
    if runs.levels:
        frequent = stored(runs.merged().where(F.col("n") >= least_docs), "frequent-lines")
        share = F.col("n") * HOT > F.lit(pairs.count())
        hot, cold = F.broadcast(frequent.where(share).drop("n")), frequent.where(~share).drop("n")
        pairs = pairs.select("hash", "id")
        found = pairs.join(hot, "hash").unionByName(pairs.join(hot.select("hash"), "hash", "left_anti").join(cold, "hash"))
        lost = found.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias(drop_id)).agg(F.collect_set("hash").alias(drop))
        rows = docs.select(*columns).join(lost, F.col(id_col).eqNullSafe(F.col(drop_id)), "left")
    else:
        rows = docs.select(*columns).withColumn(drop, F.lit(None).cast("array<binary>"))
    return _without(rows, columns, text_col, drop, least_chars)
