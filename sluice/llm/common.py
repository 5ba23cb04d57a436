"""What the operators share: the shared folder, lineage cuts and text keys."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word: space and the five controls from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: One word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder of our own is used only where the setting is absent (tests).
    """
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir", None)
    if place is None:
        place = context.getCheckpointDir()
        if place is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        place = place.rsplit("/", 1)[0] if place else tempfile.mkdtemp(prefix="sluice-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return place


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[dict[str, str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are ``stored`` in here are deleted at the end, but for those handed to the function it gives.

    What leaves the block must hang on kept tables (or checkpoints) only.
    """
    own: dict[str, str] = {}
    _scratch.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.pop(df._stored_at, None)
        return df

    try:
        yield keep
    finally:
        _scratch.remove(own)
        for path in own:
            remove_path(spark, path)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, what: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read that: a cut of lineage whose readers take only the columns they need.

    ``batch_rows`` bounds the Arrow batches of ``df``'s Python stages, where rows are wide.
    """
    path, conf = fresh_path(df.sparkSession, what), df.sparkSession.conf
    before = conf.get(_BATCH_ROWS)
    try:
        if batch_rows is not None:
            conf.set(_BATCH_ROWS, batch_rows)
        df.write.parquet(path)
    finally:
        conf.set(_BATCH_ROWS, before)
    if _scratch:
        _scratch[-1][path] = what
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def broadcast_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a stored table of a few narrow columns, to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for stages whose work is not in proportion to their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker gives its free memory back: workers live on between stages, beside the executor's heap."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a group, told by the first ``columns``, ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = 0  # of the group that may go on
        by = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        changes = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in by]))
        if len(changes):
            first = int(changes[-1]) + 1
        last = held[-1] if held else None
        if last is not None and any(last.column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(columns)):
            yield pa.Table.from_batches(held)
            held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through its own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return list(itertools.islice((name for i in itertools.count() if (name := f"own_{i}") not in taken), n))


@contextlib.contextmanager
def without_collection() -> Iterator[None]:
    """No cycle collection for work that makes very many small objects and no cycles; as it was afterwards."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that on pure ASCII, and fast; other texts are translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="sluice-")) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
