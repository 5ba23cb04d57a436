"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` (a folder of our own where that is unset) and read it from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if context.getConf().get("spark.checkpoint.dir", None) is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sluice-"))
    return df.checkpoint(eager=True)
