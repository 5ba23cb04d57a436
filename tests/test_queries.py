import pytest
from oracle import differences

import __spark_entry__
from sluice import queries as core
from sluice.config import Level, Mode
from sluice.engine import Reducer


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert differences(core.QUERIES[name](spark, sf_dir), core.ORACLE_SQL[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - core.ORACLE_SQL.keys()))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_reduce_to_target_looks_at_all_events(spark):
    """10,000 events fit in one batch of the production size."""
    sf_dir = "/root/testdata/sf0.01"
    whole = Reducer(spark, Level.STANDARD, Mode.PATTERN).reduce(core.event_lines(spark, sf_dir)).lines()
    assert {r["line"] for r in core.reduce_to_target(spark, sf_dir).collect()} == set(whole)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_drain_patterns_equal_a_serial_pass(spark, sf_dir):
    """The query's templates, counts and order from one plain pass over the distinct lines."""
    from sluice import queries as Q
    from sluice.operators.templates import Miner

    first = {}
    for r in Q.event_lines(spark, sf_dir).collect():
        first[r["line"]] = min(r["line_no"], first.get(r["line"], r["line_no"]))
    miners, count, text = {}, {}, {}
    for line, number in sorted(first.items(), key=lambda x: x[1]):
        tokens = line.split()
        lead = "<*>" if any(c.isdigit() for c in tokens[0]) else tokens[0]
        cluster = miners.setdefault((len(tokens), lead), Miner(0.5)).add(number, tokens)
        count[cluster] = count.get(cluster, 0) + 1
        text.setdefault(cluster, line)
    weight = lambda t: 200 if "CRITICAL" in t or "FATAL" in t else 100 if "ERROR" in t or "FAIL" in t else 50 if "WARN" in t else 1
    score = {c: n * weight(text[c].upper()) * (1 + text[c].count("<*>") * 0.5) * (1 + len(text[c].split()) * 0.1) for c, n in count.items() if n >= 2}
    want = sorted(score, key=lambda c: (-score[c], c))[:500]
    got = Q.drain_patterns(spark, sf_dir).orderBy("rank").collect()
    assert [(r["cluster"], r["template"], r["count"]) for r in got] == [(c, text[c], count[c]) for c in want]
