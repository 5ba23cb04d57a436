"""Drawing batches until enough distinct representative lines are found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import LEAST_ROWS, OVERHEAD, row_budget

#: Rows of the first batch of a source whose lines are not known yet.
FIRST_ROWS = 10_000
_SCALE = 1 << 40


def hashed_batches(lines: DataFrame, seed: int | None) -> Callable[[int, int], DataFrame]:
    """Batches of about so many rows, in no order: lines whose hash, another one each time, is below a bound.

    Nothing is sorted or gathered for it, and a batch of all rows is all rows.
    """
    total = lines.count()

    def draw(rows: int, turn: int) -> DataFrame:
        if rows >= total:
            return lines
        number = F.floor(F.rand() * _SCALE) if seed is None else F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "line_no", "line"), F.lit(_SCALE))
        return lines.where(number < int(_SCALE * rows / total))

    return draw


def collect_target(
    source: DataFrame | Callable[[int], DataFrame], reducer, *, target_rows: int, max_fetches: int = 50, max_batch_memory_gb: float | None = None, batch_rows_: int | None = None, plateau_rounds: int = 2, seed: int | None = None
) -> tuple[list[str], dict]:
    """Up to ``target_rows`` lines and how they were found.

    ``source`` is (line_no, line), or a function that draws so many random rows
    of them where the data are, such as ``read_jdbc_batch``.  Each round reduces a
    batch and adds lines not seen; the next batch is as large as the budget allows
    for lines of the size just seen, unless ``batch_rows_`` fixes it.  It stops at the
    target, when a batch is empty, after ``plateau_rounds`` rounds without a new
    line, after ``max_fetches``, or when the lines found outgrow the budget.
    """
    budget_gb = max_batch_memory_gb if max_batch_memory_gb is not None else reducer.settings.max_memory_gb
    limits = {"target_rows": target_rows, "max_fetches": max_fetches, "plateau_rounds": plateau_rounds, "batch_rows_": batch_rows_, "max_batch_memory_gb": budget_gb}
    for name, value in limits.items():
        if value is not None and value <= 0:
            raise ValueError(f"{name} is {value}, and has to be more than nothing")
    draw = hashed_batches(source, seed) if isinstance(source, DataFrame) else lambda rows, turn: source(rows)
    budget = int(budget_gb * 2**30)
    rows = batch_rows_ or FIRST_ROWS
    found: dict[str, None] = {}
    held, idle, reason, turn = 0, 0, "max_fetches", 0
    for turn in range(1, max_fetches + 1):
        batch = draw(rows, turn)
        seen = batch.agg(F.count(F.lit(1)).alias("rows"), row_budget(F.avg(F.octet_length("line")), budget).alias("next")).first()
        if not seen["rows"]:
            reason = "exhausted"
            break
        rows = batch_rows_ or seen["next"]
        new = [line for line in dict.fromkeys(reducer.reduce(batch).lines()) if line not in found][: target_rows - len(found)]
        found.update(dict.fromkeys(new))
        held += sum(len(line.encode()) for line in new) * OVERHEAD
        idle = 0 if new else idle + 1
        if len(found) >= target_rows:
            reason = "target"
        elif idle >= plateau_rounds:
            reason = "plateau"
        elif held > budget:
            reason, rows = "memory", max(LEAST_ROWS, rows // 2)
        else:
            continue
        break
    return list(found), {"target_rows": target_rows, "collected": len(found), "fetches": turn, "final_batch_rows": rows, "peak_memory_gb": held / 2**30, "stop_reason": reason}
