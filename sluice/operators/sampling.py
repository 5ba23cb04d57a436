"""Samples of lines, and how many rows fit into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds of a batch, what its size is a multiple of, and the bytes held for each byte of a line.
LEAST_ROWS, MOST_ROWS, STEP, OVERHEAD = 1000, 1_000_000, 1000, 3


def sample_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("line_no").cast("string"), F.col("line")))


def sample_lines(lines: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` lines, uniformly and repeatably: those of the least hashes."""
    return lines.orderBy(sample_key(seed), "line_no").limit(max(k, 0))


def sample_fraction(lines: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Each line with probability ``fraction``, decided by its hash."""
    share(fraction)
    return lines.where(F.conv(F.substring(sample_key(seed), 1, 8), 16, 10).cast("long") < round(fraction * 2**32))


def share(value: float) -> float:
    """``value`` as a share of a whole: above 0, at most 1."""
    if value != value or value <= 0 or value > 1:
        raise ValueError(f"a share of rows lies above 0 and is 1 at most; this is {value}")
    return float(value)


def row_budget(average: Column, budget: int) -> Column:
    """How many rows of an average number of bytes a budget of bytes holds, as a column; the least where that is unknown."""
    rows = F.floor(F.lit(budget) / F.greatest(F.lit(1.0), average * OVERHEAD))
    stepped = rows - rows % STEP
    return F.coalesce(F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), stepped)), F.lit(LEAST_ROWS)).cast("long")
