import json

import pytest

from sluice import Reducer, Settings, SourceError, collect_target
from sluice.cli import main
from sluice.log import set_up
from sluice.operators import lines as L
from sluice.sources import readers
from sluice.sources.sinks import FileSink, FolderSink
from sluice.streaming.lines import dedup_stream, read_stream, template_windows

LINES = [f"2024-01-01 12:00:{i:02d} INFO request {i} served" for i in range(40)] + [f"2024-01-01 12:01:{i:02d} ERROR shard={i % 4} failed req {i}" for i in range(20)]


@pytest.mark.parametrize("mode", ["pattern", "anomaly", "temporal", "hybrid"])
@pytest.mark.parametrize("level", ["standard", "enhanced"])
def test_modes_reduce(spark, mode, level):
    result = Reducer(spark, level, mode, max_patterns=20).reduce(LINES)
    got = result.lines()
    assert 0 < len(got) <= 60 and set(got) <= set(LINES)
    assert result.stats["input_lines"] == 60 and result.stats["output_lines"] == len(got)


def test_repeated_lines_without_variants_vanish_and_reuse_agrees(spark):
    reducer = Reducer(spark)
    assert reducer.reduce(["same line"] * 50).lines() == []
    assert reducer.reduce(LINES).lines() == reducer.reduce(LINES).lines()
    assert reducer.reduce([]).lines() == []


def test_errors(spark):
    with pytest.raises(TypeError):
        Reducer(spark).reduce(iter(LINES))
    for bad in ({"level": "x"}, {"mode": "x"}, {"nonsense": 1}, {"output_format": "x"}):
        with pytest.raises(ValueError):
            Reducer(spark, **bad)
    with pytest.raises(FileNotFoundError):
        Reducer(spark).process_file("/no/such/file")
    with pytest.raises(ValueError):
        FileSink("x", "csv")


def test_files_in_all_formats(spark, tmp_path):
    source = tmp_path / "in.log"
    source.write_bytes("\n".join([*LINES, "", "  "]).encode() + b"\nbad \xff byte\n")
    for form in ("line", "json", "jsonl"):
        out = tmp_path / f"out.{form}"
        result = Reducer(spark, output_format=form).process_file(str(source), str(out))
        assert result.stats["input_lines"] == 61
        text = out.read_text()
        lines = json.loads(text)["lines"] if form == "json" else [json.loads(x)["line"] for x in text.splitlines()] if form == "jsonl" else text.splitlines()
        assert lines == result.lines()
    assert json.loads((tmp_path / "out.meta.json").read_text())["stats"]["input_lines"] == 61
    assert Reducer(spark).estimate(str(source))["strategy"] == "full"
    frame = Reducer(spark).reduce(LINES).frame
    assert FolderSink(str(tmp_path / "folder")).write(frame) == frame.count()
    assert spark.read.text(str(tmp_path / "folder")).count() == frame.count()


def test_read_text_drops_bad_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a\xffb\n\xc3\xa9\n")
    assert sorted(r["line"] for r in readers.read_text(spark, str(tmp_path / "x.log")).collect()) == ["ab", "é"]


def test_query_source_binds_parameters(spark):
    L.from_list(spark, ["keep", " ", "also"]).createOrReplaceTempView("log_lines")
    got = readers.read_query(spark, "SELECT line, line_no FROM log_lines WHERE line_no <> :n", {"n": 2}, "line_no")
    assert [r["line"] for r in got.collect()] == ["keep"]


def test_connector_options():
    o = readers.jdbc_options("postgresql://h/db", "SELECT a FROM t", sample=0.5, sample_seed=1)
    assert o["url"] == "jdbc:postgresql://h/db" and o["sessionInitStatement"].startswith("SELECT setseed") and "random() < 0.5" in o["query"]
    k = readers.kafka_options("b:9092", ["x", "y"], "g", verify_ssl=False)
    assert k["subscribe"] == "x,y" and k["kafka.bootstrap.servers"] == "b:9092" and k["startingOffsets"] == "earliest" and k["endingOffsets"] == "latest"
    assert readers.mask_credentials({"sasl.password": "p", "ssl.key.password": "", "acks": "all"}) == {"sasl.password": "***", "ssl.key.password": "", "acks": "all"}
    assert readers.kafka_options("b", "x", assignment_timeout=1)["kafka.default.api.timeout.ms"] == "1000"
    assert readers.clickhouse_query("SELECT a FROM t", 0.1) == "SELECT a FROM t SAMPLE 0.1"
    assert readers.clickhouse_query("SELECT 'limit' AS a FROM (SELECT 1 LIMIT 2)", 0.1).endswith("SAMPLE 0.1")
    assert readers.clickhouse_query("SELECT a FROM t WHERE b = {x:String}", None, {"x": "it's"}, {"max_threads": 2}) == "SELECT a FROM t WHERE b = CAST('it\\'s' AS String) SETTINGS max_threads = 2"
    for bad in (lambda: readers.clickhouse_query("SELECT a FROM t WHERE b", 0.1), lambda: readers.clickhouse_query("SELECT 1", parameters={"x": 1}), lambda: readers.jdbc_options("mysql://h/d", "q", params={"a": 1})):
        with pytest.raises(ValueError):
            bad()


def test_database_urls():
    assert readers.jdbc_target("postgresql+psycopg://me:p%40ss@host:5432/db") == {"url": "jdbc:postgresql://host:5432/db", "user": "me", "password": "p@ss"}
    assert readers.jdbc_target("sqlite:////tmp/x.db") == {"url": "jdbc:sqlite:/tmp/x.db"} and readers.jdbc_target("sqlite:///x.db") == {"url": "jdbc:sqlite:x.db"}
    assert readers.jdbc_target("jdbc:mysql://h/d") == {"url": "jdbc:mysql://h/d"}


def test_kafka_errors_name_the_source(spark):
    with pytest.raises(SourceError, match="x,y"):
        readers.read_kafka(spark, "localhost:1", "g", ["x", "y"], assignment_timeout=1)


@pytest.mark.parametrize("args", [{"dsn": "kafka://b"}, {"dsn": "kafka://b", "topic": "t", "group": "g", "sample": 0.1}, {"dsn": "clickhouse://h"}, {"dsn": "postgresql://h"}])
def test_dsn_needs(spark, args):
    with pytest.raises(ValueError):
        readers.open_dsn(spark, **args)


def test_target_loop(spark):
    source = L.from_list(spark, [f"INFO kind{i % 40} value {i}" for i in range(400)])
    reducer = Reducer(spark, settings=Settings(fuzzy_threshold=None, drain_similarity=0.7))
    lines, stats = collect_target(source, reducer, target_rows=10, batch_rows_=200, seed=1)
    assert len(lines) == 10 == len(set(lines)) and stats["stop_reason"] == "target"
    assert collect_target(source.limit(0), reducer, target_rows=3)[1]["stop_reason"] == "exhausted"
    assert collect_target(source, reducer, target_rows=10_000, batch_rows_=400, seed=1)[1]["stop_reason"] == "plateau"
    drawn = []

    def batches(rows):
        drawn.append(rows)
        return source.where(f"line_no % 4 = {len(drawn)}")

    lines, stats = collect_target(batches, reducer, target_rows=10_000)
    assert drawn[0] == 10_000 and drawn[1] == 1_000_000 == stats["final_batch_rows"] and stats["stop_reason"] == "exhausted" and stats["fetches"] == 4 and lines
    assert collect_target(source, reducer, target_rows=10_000, batch_rows_=400, max_batch_memory_gb=1e-7)[1]["stop_reason"] == "memory"
    for bad in ({"target_rows": 0}, {"target_rows": 1, "max_fetches": 0}, {"target_rows": 1, "batch_rows_": -1}, {"target_rows": 1, "max_batch_memory_gb": 0}):
        with pytest.raises(ValueError):
            collect_target(source, reducer, **bad)


def test_logging(tmp_path, monkeypatch):
    path = tmp_path / "own" / "x.log"
    log = set_up(Settings(enable_logging=True, log_file=str(path), log_format="json"))
    log.info("some %s", "thing")
    assert json.loads(path.read_text())["message"] == "some thing"
    monkeypatch.setenv("LOG_LEVEL", "error")
    log = set_up(Settings(enable_logging=True, log_file=str(path)))
    log.info("unheard")
    assert len(path.read_text().splitlines()) == 1 and len(log.handlers) == 1
    assert set_up(Settings(enable_logging=True), own_handlers=False).propagate and not set_up(Settings()).propagate


def test_cli(spark, tmp_path, capsys):
    source = tmp_path / "in.log"
    source.write_text("\n".join(LINES))
    assert main([str(source), "--format", "jsonl", "--stats"]) == 0
    got = capsys.readouterr()
    assert all("line" in json.loads(x) for x in got.out.splitlines()) and "input_lines: 60" in got.err
    assert main([str(source), "--estimate"]) == 0
    assert main([]) == 1 and main(["/no/file"]) == 1 and main([str(source), "--sample", "0.5"]) == 1
    assert main([str(source), "--target-rows", "3", "--sample-seed", "1"]) == 0


def test_target_rows_of_a_database_are_drawn_there(spark, monkeypatch, capsys):
    queries = []

    def read(spark, url, query, **how):
        queries.append(query)
        return L.from_list(spark, LINES if len(queries) == 1 else [])

    monkeypatch.setattr(readers, "read_jdbc", read)
    assert main(["--dsn", "sqlite:///x.db", "--query", "SELECT line FROM t", "--target-rows", "500"]) == 0
    assert queries == [f"SELECT * FROM (SELECT line FROM t) AS batch ORDER BY random() LIMIT {n}" for n in (10_000, 1_000_000)]
    assert set(capsys.readouterr().out.splitlines()) <= set(LINES)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([*LINES[:5], *LINES[:5], "", "2024-01-02 00:00:00 INFO late 1"]))
    stream = read_stream(spark, str(tmp_path / "in"))
    for name, df in (("first_lines", dedup_stream(stream)), ("counts", template_windows(stream))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert spark.table("first_lines").count() == 6
    assert [r["lines"] for r in spark.table("counts").collect()] == [10]
