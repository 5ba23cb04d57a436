"""The reducer: a source, a mode and settings in; lines and statistics out."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .checkpoints import cut
from .config import Level, Mode, OutputFormat, Settings, preset
from .operators.lines import from_list
from .plans.modes import reduce_lines
from .sources.readers import read_text, size_bytes
from .sources.sinks import FileSink

GB = 1024**3


@dataclass
class Reduction:
    """The reduced lines as a DataFrame (pos, line), with statistics and settings."""

    frame: DataFrame
    stats: dict
    settings: Settings = field(repr=False)

    def lines(self) -> list[str]:
        """The lines in order; their number is bounded by the settings."""
        return [r["line"] for r in self.frame.orderBy("pos").collect()]

    def as_dict(self) -> dict:
        return {"lines": self.lines(), "stats": self.stats, "config": self.settings.as_dict()}


def strategy(size: int, max_memory_gb: float) -> str:
    """How an engine bound to ``max_memory_gb`` would read a file; this one always reads all of it."""
    cap = max_memory_gb * GB
    return "full" if size < 0.2 * cap else "chunked" if size < 5 * cap else "sampled"


class Reducer:
    def __init__(self, spark: SparkSession | None = None, level: Level | str = Level.STANDARD, mode: Mode | str = Mode.PATTERN, settings: Settings | None = None, **options):
        self.level = Level(level.lower()) if isinstance(level, str) else level
        self.mode = Mode(mode.lower()) if isinstance(mode, str) else mode
        options = {k: v for k, v in options.items() if v or k not in ("max_memory_gb", "max_patterns")}
        self.settings = (settings or preset(self.level)).changed(**options)
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.stats: dict = {}
        from .log import set_up

        self.log = set_up(self.settings)

    def reduce(self, source: DataFrame | Sequence[str], *, output_file: str | None = None, sink=None, label: str | None = None, size: int | None = None) -> Reduction:
        """Reduce (line_no, line) rows, or a list of lines."""
        if isinstance(source, Iterator):
            raise TypeError("a source is read more than once; an iterator is not, so pass a list or a DataFrame")
        began = time.time()
        lines = source if isinstance(source, DataFrame) else from_list(self.spark, source)
        total = lines.count()
        frame = cut(reduce_lines(lines, self.mode, self.level, self.settings))
        kept, took = frame.count(), time.time() - began
        mb = size / 1024**2 if size is not None else None
        self.stats = {
            "input_file": label or "lines",
            "input_lines": total,
            "input_size_mb": mb,
            "output_lines": kept,
            "reduction_percent": (1 - kept / max(total, 1)) * 100 if total else 0,
            "processing_time_seconds": took,
            "processing_rate_mb_per_sec": mb / max(took, 0.001) if mb is not None else None,
            "mode": self.mode.value,
            "level": self.level.value,
            "memory_limit_gb": self.settings.max_memory_gb,
        }
        result = Reduction(frame, self.stats, self.settings)
        if output_file:
            save(result, output_file)
        if sink is not None:
            sink.write(frame)
        self.log.info("%s lines -> %s lines (%.1f%%) in %.1f s", total, kept, self.stats["reduction_percent"], took)
        return result

    def process_file(self, path: str, output_file: str | None = None) -> Reduction:
        return self.reduce(read_text(self.spark, path), output_file=output_file, label=path, size=size_bytes(self.spark, path))

    def estimate(self, path: str) -> dict:
        size = size_bytes(self.spark, path)
        if size is None:
            raise FileNotFoundError(f"File not found: {path}")
        gb, s = size / GB, self.settings
        how = strategy(size, s.max_memory_gb)
        return {"file_size_gb": gb, "memory_required_gb": min(gb * 0.3, s.max_memory_gb), "strategy": how, "estimated_time_seconds": gb * 30, "will_sample": how == "sampled", "estimated_output_lines": min(int(gb * 1000), s.max_patterns * s.examples_per_pattern)}


def save(result: Reduction, path: str) -> None:
    """A local file in the settings' format; plain lines get a ``.meta.json`` beside them."""
    s, now, target = result.settings, datetime.now().isoformat(), Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    about = {"stats": result.stats, "config": s.as_dict(), "timestamp": now}
    if s.output_format is OutputFormat.JSON:
        target.write_text(json.dumps({"lines": result.lines(), **about}, indent=2 if s.pretty_json else None), encoding="utf-8")
    elif s.output_format is OutputFormat.JSONL:
        target.write_text("".join(json.dumps({"line": x, "timestamp": now}) + "\n" for x in result.lines()), encoding="utf-8")
    else:
        FileSink(path).write(result.frame)
        target.with_suffix(".meta.json").write_text(json.dumps(about, indent=2), encoding="utf-8")
