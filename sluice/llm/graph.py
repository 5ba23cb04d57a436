"""Connected components of an edge table: forests of partitions, then contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, tidy


@tidy
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the least node of each of its components; at most one edge a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for low in range(0, max(1, len(nodes)), 1 << 16):
        part = nodes[low : low + (1 << 16)]
        ends = np.fromiter(map(root, part), dtype=np.int64, count=len(part))
        yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(part, type=pa.int64())], names=["a", "b"])


def _forest(edges: DataFrame) -> DataFrame:
    """As few edges as join what ``edges`` join within each partition.

    Repeated edges are combined before they move, and hashing both ends deals the rest evenly, hubs or not.
    """
    ship(edges.sparkSession)
    single = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return single.mapInArrow(_stars, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node that an edge joins to another; root is the least node reachable.

    Each turn points every node to its least neighbour (or itself), follows the
    pointers to their ends and moves all edges there.  All nodes but the local
    minima vanish in a turn.  Nothing is gathered on the driver but whether
    anything is left to do.
    """
    edges = cut(_forest(edges))
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")))
        while True:  # doubled twice at a time, so that a chain of n takes log4(n) turns
            ahead = step.withColumn("first", F.col("to"))
            for _ in range(2):
                onward = ahead.select(F.col("node").alias("n"), F.col("to").alias("far"))
                ahead = ahead.join(onward, F.col("to") == F.col("n")).select("node", "first", F.col("far").alias("to"))
            ahead = cut(ahead)
            step = ahead.select("node", "to")
            if ahead.where("first <> to").isEmpty():
                break
        onward = step.select(F.col("node").alias("n"), F.col("to").alias("far"))
        if found is None:
            found = step.withColumnRenamed("to", "root")
        else:
            found = cut(found.join(onward, F.col("root") == F.col("n"), "left").select("node", F.coalesce("far", "root").alias("root")))
        ends = edges.join(onward, F.col("a") == F.col("n")).select(F.col("far").alias("a"), "b")
        edges = cut(_forest(ends.join(onward, F.col("b") == F.col("n")).select("a", F.col("far").alias("b"))))
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
