"""Command line: reduce a file or a DSN's lines."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from . import __version__
from .config import Level, Mode, OutputFormat
from .engine import Reducer, save
from .plans.target import collect_target
from .sources.readers import batches_of, open_dsn, read_text, size_bytes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice", description="Reduce log lines to a representative sample.")
    p.add_argument("input_file", nargs="?")
    p.add_argument("-o", "--output")
    p.add_argument("--format", choices=[f.value for f in OutputFormat], default="line")
    p.add_argument("--pretty-json", action="store_true")
    p.add_argument("-l", "--level", choices=[x.value for x in Level], default="standard")
    p.add_argument("-m", "--mode", choices=[x.value for x in Mode], default="pattern")
    for name in ("--dsn", "--query", "--topic", "--group", "--log-file"):
        p.add_argument(name)
    p.add_argument("--max-memory", type=float)
    p.add_argument("--max-patterns", type=int)
    p.add_argument("--log", action="store_true")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--estimate", action="store_true")
    p.add_argument("--metadata", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--sample", type=float)
    p.add_argument("--sample-seed", type=int)
    p.add_argument("--target-rows", type=int)
    p.add_argument("--max-fetches", type=int, default=50)
    p.add_argument("--max-batch-memory", type=float)
    p.add_argument("-V", "--version", action="version", version=f"sluice {__version__}")
    return p


def run(args: argparse.Namespace) -> None:
    out, err = sys.stdout, sys.stderr
    if not args.input_file and not args.dsn:
        raise ValueError("an input file or --dsn is needed")
    if args.sample is not None and not args.dsn and not args.target_rows:
        raise ValueError("--sample is for databases")
    reducer = Reducer(None, args.level, args.mode, max_memory_gb=args.max_memory, max_patterns=args.max_patterns, enable_logging=args.log, log_file=args.log_file, log_level=args.log_level, output_format=args.format, pretty_json=args.pretty_json)
    spark = reducer.spark
    if args.estimate:
        if not args.input_file:
            raise ValueError("--estimate is for files")
        print("\n".join(f"{k}: {v}" for k, v in reducer.estimate(args.input_file).items()), file=out)
        return
    if args.dsn and args.target_rows and args.query and not args.dsn.startswith("kafka://"):
        source, label, size = batches_of(spark, args.dsn, args.query), args.dsn.split("://")[0], None
    elif args.dsn:
        source, label, size = open_dsn(spark, args.dsn, query=args.query, topic=args.topic, group=args.group, sample=args.sample, sample_seed=args.sample_seed), args.dsn.split("://")[0], None
    else:
        source, label, size = read_text(spark, args.input_file), args.input_file, size_bytes(spark, args.input_file)
    if args.target_rows:
        lines, stats = collect_target(source, reducer, target_rows=args.target_rows, max_fetches=args.max_fetches, max_batch_memory_gb=args.max_batch_memory, seed=args.sample_seed)
        whole = {"lines": lines, "stats": stats}
        if args.output:
            with open(args.output, "w", encoding="utf-8") as file:
                emit(lines, args.format, args.pretty_json, whole if args.metadata else None, file)
    else:
        result = reducer.reduce(source, label=label, size=size)
        lines, stats, whole = result.lines(), result.stats, None
        if args.output:
            save(result, args.output)
        elif args.metadata:
            whole = result.as_dict()
    if not args.output:
        emit(lines, args.format, args.pretty_json, whole if args.metadata else None, out)
    if args.stats:
        print("\n".join(f"{k}: {v}" for k, v in stats.items()), file=err)


def emit(lines: list[str], form: str, pretty: bool, whole: dict | None, out) -> None:
    if form == "json":
        print(json.dumps(whole or {"lines": lines, "timestamp": datetime.now().isoformat()}, indent=2 if pretty else None), file=out)
    else:
        for line in lines:
            print(json.dumps({"line": line}) if form == "jsonl" else line, file=out)


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except Exception as error:
        print(f"Error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
