"""Template mining: which lines are variants of one another.

Miners give (line_no, line, template, cluster): ``cluster`` is the number of
the cluster's first line, ``template`` that first line as the miner saw it.
"""

from __future__ import annotations

import zipfile
from collections import OrderedDict
from collections.abc import Iterator
from operator import eq
from pathlib import Path
from tempfile import mkdtemp

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.text import mask_types, words

_SCHEMA = "line_no long, line string, template string, cluster long"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parents[1]
        target = Path(mkdtemp(prefix="sluice-")) / "sluice.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(here.rglob("*.py")):
                out.write(file, file.relative_to(here.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def mask_miner(lines: DataFrame) -> DataFrame:
    """Lines that are equal once typed values are masked; DataFrame operations only."""
    masked = lines.withColumn("template", mask_types(F.col("line")))
    first = masked.groupBy("template").agg(F.min("line_no").alias("cluster"))
    return masked.join(first, "template").select("line_no", "line", "template", "cluster")


class Miner:
    """Online clustering of token rows of one length by the share of equal positions."""

    def __init__(self, similarity: float, most: int | None = None):
        self.similarity, self.most = similarity, most
        #: template tokens and the number of wildcards among them, the least recently used cluster first
        self.clusters: OrderedDict[int, tuple[list[str], int]] = OrderedDict()

    def add(self, key: int, tokens: list[str]) -> int:
        """The cluster that ``tokens`` joins; ``key`` names it if it is new."""
        own = [t if t != "<*>" else None for t in tokens] if "<*>" in tokens else tokens  # a wildcard equals nothing
        best, most, fewest = None, -1, -1
        for name, (template, wild) in self.clusters.items():
            equal = sum(map(eq, template, own))
            if equal > most or (equal == most and wild > fewest):
                best, most, fewest = name, equal, wild
        if best is not None and (most / max(1, len(tokens)) >= self.similarity or not tokens):
            if most + fewest < len(tokens):
                merged = [a if a == b else "<*>" for a, b in zip(self.clusters[best][0], tokens, strict=True)]
                self.clusters[best] = merged, merged.count("<*>")
            self.clusters.move_to_end(best)
            return best
        self.clusters[key] = list(tokens), tokens.count("<*>")
        if self.most and len(self.clusters) > self.most:
            self.clusters.popitem(last=False)
        return key


#: Lines of a group that one task mines; larger groups are mined in pieces.
PIECE = 20_000


def drain_miner(lines: DataFrame, similarity: float = 0.4, max_clusters: int | None = None, typed_masking: bool = False, by: str | None = None, split_leading: bool = True, piece: int = PIECE) -> DataFrame:
    """Online template mining after He et al. (ICWS 2017), in line order.

    Lines with different numbers of tokens, or different first tokens (those
    with digits counting as one), never share a cluster, so groups are mined
    apart, in parallel; ``split_leading=False`` groups by the number of tokens
    only.  ``by`` names a column whose values are mined apart as well.
    ``max_clusters`` bounds each group, the least recently used going first.

    A group of up to ``piece`` lines is mined in one pass.  A larger one is dealt
    into pieces by the hash of the line numbers; each is mined, and the templates found
    are mined once more, as lines in the order of their first ones.  So no group
    is one task's work, however many lines share their length and first token.
    """
    ship(lines.sparkSession)
    seen = mask_types(F.col("line")) if typed_masking else F.col("line")
    tokens = words(F.col("seen"))
    first = F.element_at(tokens, 1)
    lead = F.when((F.size(tokens) > 0) & ~first.rlike("[0-9]") & F.lit(split_leading), first).otherwise("<*>")
    group = F.md5(F.concat_ws(" ", F.size(tokens).cast("string"), lead, *([F.lit("by"), F.col(by).cast("string")] if by else [])))
    rows = lines.withColumn("seen", seen).select("line_no", "line", F.trim("seen").alias("template"), group.alias("grp"))
    large = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece).select("grp", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    large = cut(large)  # of n lines there are n / piece such groups at most
    rows = rows.join(large, "grp", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("line_no"), F.col("pieces"))).otherwise(F.lit(-1)).cast("long"))
    mined = _mined(rows, similarity, max_clusters)
    if large.isEmpty():
        return mined.select("line_no", "line", "template", "cluster")
    mined = cut(mined)
    whole, parts = mined.where("piece < 0").select("line_no", "line", "template", "cluster"), mined.where("piece >= 0")
    found = parts.groupBy("grp", "cluster").agg(F.max_by("tokens", "line_no").alias("tokens"), F.min_by("template", "line_no").alias("template"))
    joined = cut(_joined(found, similarity, max_clusters))
    return whole.unionByName(parts.select("line_no", "line", F.col("cluster").alias("own")).join(joined, "own").select("line_no", "line", "template", "cluster"))


def _mined(rows: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """The rows with cluster, its first line's text, and (of lines in pieces) its tokens up to that line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, miner, shown = None, None, {}
        for batch in batches:
            clusters, templates, tokens = [], [], []
            for number, text, *here in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if here != at:
                    at, miner, shown = here, Miner(similarity, most), {}
                cluster = miner.add(number, text.split())
                clusters.append(cluster)
                templates.append(shown.setdefault(cluster, text))
                tokens.append(" ".join(miner.clusters[cluster][0]) if here[1] >= 0 and cluster in miner.clusters else None)
            new = (pa.array(templates, type=pa.string()), pa.array(clusters, type=pa.int64()), pa.array(tokens, type=pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new, batch.column(3), batch.column(4)], names=["line_no", "line", "template", "cluster", "tokens", "grp", "piece"])

    ordered = rows.select("line_no", "line", "template", "grp", "piece").repartition("grp", "piece").sortWithinPartitions("grp", "piece", "line_no")
    return ordered.mapInArrow(run, f"{_SCHEMA}, tokens string, grp string, piece long")


def _joined(found: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """(own, cluster, template): the clusters of pieces, and those of their group that they are part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, miner, shown = None, None, {}
        for batch in batches:
            clusters, templates = [], []
            for name, tokens, text, grp in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if grp != group:
                    group, miner, shown = grp, Miner(similarity, most), {}
                clusters.append(miner.add(name, tokens.split()))
                templates.append(shown.setdefault(clusters[-1], text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clusters, type=pa.int64()), pa.array(templates, type=pa.string())], names=["own", "cluster", "template"])

    ordered = found.select("cluster", "tokens", "template", "grp").repartition("grp").sortWithinPartitions("grp", "cluster")
    return ordered.mapInArrow(run, "own long, cluster long, template string")
