"""Sinks for reduced lines, which are (pos, line) in the order of pos."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import kafka_client


def as_jsonl(lines: DataFrame) -> DataFrame:
    """Each line as a JSON document, in ``value``."""
    return lines.select("pos", F.to_json(F.struct("line")).alias("value"))


class FolderSink:
    """Lines, or one JSON document a line, as text files that Spark writes in order."""

    def __init__(self, path: str, form: str = "line"):
        if form not in ("line", "jsonl"):
            raise ValueError(f"unknown format {form!r}")
        self.path, self.form = path, form

    def write(self, lines: DataFrame) -> int:
        rows = lines.select("pos", F.col("line").alias("value")) if self.form == "line" else as_jsonl(lines)
        rows.orderBy("pos").select("value").write.mode("overwrite").text(self.path)
        return lines.count()


class FileSink:
    """One local file, for results of a bounded size: lines, JSON lines, or one JSON document."""

    def __init__(self, path: str, form: str = "line"):
        if form not in ("line", "json", "jsonl"):
            raise ValueError(f"unknown format {form!r}")
        self.path, self.form = Path(path), form

    def write(self, lines: DataFrame) -> int:
        texts = [r["line"] for r in lines.orderBy("pos").select("line").collect()]
        self.path.parent.mkdir(parents=True, exist_ok=True)
        if self.form == "json":
            text = json.dumps({"lines": texts, "timestamp": datetime.now().isoformat()}, indent=2)
        else:
            text = "".join((json.dumps({"line": t}) if self.form == "jsonl" else t) + "\n" for t in texts)
        self.path.write_text(text, encoding="utf-8")
        return len(texts)


class KafkaSink:
    """Messages of a topic, with one fixed key or none."""

    def __init__(self, config: str | dict, topic: str, key: str | None = None, verify_ssl: bool = True):
        self.options = {"kafka.compression.type": "lz4"} | kafka_client(config, verify_ssl) | {"topic": topic}
        self.key = key

    def write(self, lines: DataFrame) -> int:
        rows = lines.orderBy("pos").select(F.lit(self.key).cast("string").alias("key"), F.col("line").alias("value"))
        rows.write.format("kafka").options(**self.options).save()
        return lines.count()
