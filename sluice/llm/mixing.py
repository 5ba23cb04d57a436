"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Each source has a weight, which sets its
target (its share of all words taken), and a schedule, which says when it is
read: a list of multipliers for equally long phases.  The integral of the
schedule, scaled to the target, is the source's cumulative demand D(u).  The
documents of a source stand in hash order; the offset x of a document in that
order is met at the training position u with D(u) = x, so inverting D assigns
positions.  The mix is the documents range-sorted by position.

Offsets are prefix sums in two steps, over hash buckets of a source and inside
each bucket, so that a source with a third of all rows spreads over
``16 ** BUCKET_CHARS`` groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, stored, text_or_empty

#: Hex digits of the order hash that name a bucket: 4096 of them a source.
BUCKET_CHARS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: For each weight, the multipliers of three equal phases: steady, rising and falling.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also weight, target and turn (which weight and schedule it has).

    The budget, ``budget`` times all sizes, is shared by weight; no source gets
    more than ``most`` times its size, what it cannot take is shared by the
    rest.  With sources in ascending order of cap / weight, source i is capped
    when its fair share of what the ones before it leave reaches its cap.

    One row a source comes here, so a single sorted window holds the table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    ranked = sizes.withColumn("turn", turn)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    shared = ranked.withColumns(
        {
            "left": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)) - (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")),
            "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", F.when(F.col("ratio") > F.col("left") / F.col("open"), F.col("left") / F.col("open")))
    first = F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    return shared.withColumn("target", F.when(first.isNull(), F.col("cap")).otherwise(first * F.col("weight"))).select("source", "source_size", "weight", "turn", "target")


def invert_demand(offset: Column, target: Column, turn: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The training position at which a source's cumulative demand reaches ``offset``."""
    by_turn = None
    for k, phases in enumerate(schedules):
        n, total, before, at = len(phases), sum(phases), 0.0, None
        for i, m in enumerate(phases):
            start, stop = target * F.lit(before / total), target * F.lit((before + m) / total)
            here = F.lit(i / n) + (offset - start) / (stop - start) / F.lit(float(n))
            at = F.when(offset < stop, here) if at is None else at.when(offset < stop, here)
            before += m
        by_turn = F.when(turn == k, at) if by_turn is None else by_turn.when(turn == k, at)
    return by_turn


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], schedules: Sequence[Sequence[float]], budget: float, most: float, key: Sequence[Column] = ()) -> DataFrame:
    """id, h, k0, k1, ... (``key``), size, source_size, target, at, taken, position, again of every row."""
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    names = [f"k{i}" for i in range(len(key))]
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_or_empty(text_col)).alias("size"), order.alias("h"), *(k.alias(n) for k, n in zip(key, names, strict=True)))
    sized = stored(sized.withColumn("bucket", F.substring("h", 1, BUCKET_CHARS)), "mix-sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, most)
    in_order = Window.partitionBy("source").orderBy("bucket")
    starts = buckets.withColumn("start", F.sum("bucket_size").over(in_order) - F.col("bucket_size")).drop("bucket_size")
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = starts.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    placed = sized.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col("id").asc_nulls_first(), "size", *names)
    placed = placed.withColumn("at", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    whole = F.floor("target").cast("long")
    once = lambda goal: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("at"))).cast("long")
    placed = placed.withColumn("taken", once(whole) + once(whole - F.col("source_size")))
    met = lambda offset: F.round(invert_demand(offset.cast("double"), F.col("target"), F.col("turn"), schedules), 9)
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, met(F.col("at"))))
    return placed.withColumn("again", F.when(once(whole - F.col("source_size")) > 0, met(F.col("at") + F.col("source_size"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """id, size, source_size, target, taken, position, again, of every row, range-sorted by position.

    ``taken`` is the number of the document's words that the mix takes, repeats
    counted: a source is read from its start in hash order, once and then once
    more, until its target (rounded down) is met.  ``position`` is the place of
    its first reading and ``again`` that of its second, which starts one source size
    later; each is null where it takes nothing.  Null and empty texts have
    size 0; a null source is a source of its own, the last; rows of one id
    follow each other by size.  An empty table gives an empty mix.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, schedules, budget, most)
    # what is never reached comes after the end, spread by its offset
    late = F.coalesce("position", F.lit(1.0) + F.col("at") / (F.col("source_size") + F.lit(1.0)))
    return (
        placed.withColumn("late", late)
        .orderBy("late", "h")
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "position", "again")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``, in training order.

    Texts are never cut: a document comes as often as ``taken / size`` rounds to
    (halves up), which is 0, 1 or 2 times, each copy at the position of its own
    reading; equal positions stand in hash order.  Ids may be null or repeated:
    rows are told apart by 128 bits of all their columns, and rows that agree in
    all of them come as often as the mix takes them all together.
    """
    columns = docs.columns
    digest = [F.xxhash64(F.lit(i), *columns) for i in (0, 1)]
    takes = _placed(docs, id_col, text_col, source_col, weights, schedules, budget, most, digest).where("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    takes = takes.select("k0", "k1", "h", F.slice(F.array("position", "again"), F.lit(1), times).alias("positions")).where(F.size("positions") > 0)
    takes = takes.groupBy("k0", "k1", "h").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    k0, k1, h, positions, position = free_names(docs, 5)
    takes = takes.select(F.col("k0").alias(k0), F.col("k1").alias(k1), F.col("h").alias(h), F.col("positions").alias(positions))
    single = docs.withColumns(dict(zip((k0, k1), digest, strict=True))).dropDuplicates([k0, k1])  # already dealt as the join wants it
    return (
        single.join(takes, [k0, k1])
        .withColumn(position, F.explode(positions))
        .repartitionByRange(position, h)
        .sortWithinPartitions(position, h)
        .select(*columns)
    )
