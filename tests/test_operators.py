import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.config import Settings
from sluice.errors import SamplingNotSupported
from sluice.functions import text as T
from sluice.operators import anomaly, lines as L, patterns, sampling, templates, temporal
from sluice.sources import dialects


def rows(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_exact_dedup_keeps_the_first(spark):
    lines = L.from_list(spark, ["line 1", "line 2", "line 1", "line 3", "line 2", "line 4"])
    assert rows(L.exact_dedup(lines).orderBy("line_no"), "line") == ["line 1", "line 2", "line 3", "line 4"]
    assert tuple(L.dedup_stats(lines).first()) == (6, 4, 2)
    assert tuple(L.dedup_stats(lines.limit(0)).first()) == (0, 0, 0)


def test_normalise_strips_unicode_space_and_skips_blanks(spark):
    df = spark.createDataFrame([(0, "\t a b  "), (1, None), (2, " \n"), (3, "x")], "line_no long, line string")
    assert rows(L.normalise(df).orderBy("line_no"), "line") == ["a b", "x"]


@pytest.mark.parametrize(
    ("line", "masked"),
    [
        ("from 10.0.0.1 port 22", "from <IP> port <NUM>"),
        ("id 123e4567-e89b-12d3-a456-426614174000 done", "id <UUID> done"),
        ("mac 00:1A:2b:3c:4d:5e up", "mac <MAC> up"),
        ("addr fe80::1 up", "addr <IPV6> up"),
        ("ptr 0xdeadbeef01 and deadbeef", "ptr <HEX> and <HEX>"),
        ("long 12345678901234 word2vec", "long <NUM> word2vec"),
    ],
)
def test_typed_masks(spark, line, masked):
    assert spark.range(1).select(T.mask_types(F.lit(line)).alias("m")).first()["m"] == masked


def test_times_and_levels(spark):
    lines = L.from_list(spark, ["2024-02-30 00:00:00 error x", "2024-01-02T03:04:05 INFO y", '1.2.3.4 [10/Oct/2000:13:55:36] "GET"', "Jan  5  01:02:03 host WARNING", "none"])
    parsed = temporal.parse_lines(lines, 2023).orderBy("line_no").collect()
    assert [str(r["ts"]) if r["ts"] else None for r in parsed] == [None, "2024-01-02 03:04:05", "2000-10-10 13:55:36", "2023-01-05 01:02:03", None]
    assert [r["level"] for r in parsed] == ["ERROR", "INFO", None, None, None]


def test_temporal_selection_orders_by_first_appearance(spark):
    lines = L.from_list(spark, ["2024-01-02 10:00:00 a", "2024-01-01 10:00:00 b", "free", "2024-01-02 10:30:00 c"])
    got = temporal.select_temporal(temporal.parse_lines(lines), 60, 3).orderBy("pos")
    assert [x[-1] for x in rows(got, "line")] == ["a", "c", "b", "e"]


def serial_drain(lines, similarity):
    miners, out = {}, []
    for i, line in enumerate(lines):
        tokens = line.split()
        out.append(miners.setdefault(len(tokens), templates.Miner(similarity)).add(i, tokens))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcx7"), min_size=1, max_size=4).map(" ".join), min_size=1, max_size=30))
def test_drain_by_groups_equals_one_serial_pass(spark, lines):
    mined = templates.drain_miner(L.from_list(spark, lines), 0.5, split_leading=False)
    assert rows(mined.orderBy("line_no"), "cluster") == serial_drain(lines, 0.5)


def test_a_large_group_is_mined_in_pieces(spark):
    """Clear templates come out the same in pieces as in one pass, with the same counts and first lines."""
    rng = random.Random(8)
    kinds = ["user {} logged in from host", "user {} logged out of host", "disk {} is full on node", "job {} took {} seconds overall"]
    lines = L.from_list(spark, [f"{i} {rng.choice(kinds).format(rng.randrange(10**6), rng.randrange(99))}" for i in range(600)])
    count = lambda mined: {r["cluster"]: (r["template"], r["count"]) for r in patterns.count_patterns(mined).collect()}
    whole = count(templates.drain_miner(lines, 0.5))
    assert len(whole) >= 3 and count(templates.drain_miner(lines, 0.5, piece=50)) == whole


def test_drain_patterns_rank_and_examples(spark):
    text = [f"INFO request {i} done" for i in range(10)] + [f"ERROR disk {i} broken" for i in range(5)] + ["CRITICAL all down 1", "CRITICAL all down 2", "once only"]
    mined = templates.drain_miner(L.from_list(spark, text), 0.5)
    ranked = patterns.rank_patterns(patterns.count_patterns(mined, 2), 10)
    assert [r["template"].split()[0] for r in ranked.orderBy("rank").collect()] == ["ERROR", "CRITICAL", "INFO"]
    assert rows(patterns.examples(mined, ranked, 2).orderBy("pos"), "line") == ["ERROR disk 0 broken", "ERROR disk 1 broken", "CRITICAL all down 1", "CRITICAL all down 2", "INFO request 0 done", "INFO request 1 done"]


def test_cluster_bound(spark):
    text = [f"alpha{i % 50} beta{i % 50} gamma{i % 50}" for i in range(100)]
    assert templates.drain_miner(L.from_list(spark, text), 0.5, max_clusters=5).count() == 100


def greedy(lines, keys):
    kept, held = [], set()
    for i in sorted(lines):
        if not held & keys[i]:
            kept.append(i)
            held |= keys[i]
    return kept


@pytest.mark.parametrize("rest", [0, 60, 500_000])
def test_near_dedup_is_the_greedy_choice(spark, monkeypatch, rest):
    monkeypatch.setattr(L, "REST", rest)
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghijklmnopqrst", k=20)) for _ in range(12)]
    text = [" ".join(w if rng.random() > 0.04 else "zz" for w in rng.choice(base).split()) for _ in range(120)]
    lines = L.exact_dedup(L.from_list(spark, text))
    bands, width = L.banding(0.8)
    sig = F.transform(F.sequence(F.lit(0), F.lit(bands * width - 1)), lambda i: F.array_min(F.transform(T.words(F.col("line")), lambda w: F.xxhash64(w, i))))
    keys = {r["line_no"]: {(b, tuple(r["sig"][b * width : (b + 1) * width])) for b in range(bands)} for r in lines.withColumn("sig", sig).collect()}
    got = rows(L.near_dedup(lines, 0.8).orderBy("line_no"), "line_no")
    assert got == greedy(keys.keys(), keys) and len(got) < len(keys)


def test_banding():
    assert L.banding(0.8) == (5, 11) and L.banding(0.9) == (3, 21)


def test_anomalies_find_the_odd_line(spark):
    text = [f"INFO request {i} handled in 12ms" for i in range(60)] + ["FATAL kernel panic not syncing"]
    odd, normal = anomaly.split_anomalies(L.from_list(spark, text), 0.1)
    found = rows(odd.orderBy("score"), "line")
    assert found[0].startswith("FATAL") and odd.count() + normal.count() == 61
    assert anomaly.split_anomalies(L.from_list(spark, text[:5]), 0.1)[0] is None


def test_samples(spark):
    lines = L.from_list(spark, [f"line {i}" for i in range(1000)])
    first = sorted(rows(sampling.sample_lines(lines, 50, 1), "line_no"))
    assert first == sorted(rows(sampling.sample_lines(lines.repartition(7), 50, 1), "line_no")) and len(first) == 50
    assert sampling.sample_lines(lines, 0).count() == 0 and sampling.sample_lines(lines, 5000).count() == 1000
    assert 50 < sampling.sample_fraction(lines, 0.1).count() < 150


def test_sample_sql():
    assert dialects.sampled_query("postgresql", "SELECT 1", 0.5) == (None, "SELECT * FROM (SELECT 1) AS sampled WHERE random() < 0.5")
    prepare, _ = dialects.sampled_query("postgresql", "SELECT 1", 0.5, 7)
    assert -1 <= float(prepare.removeprefix("SELECT setseed(").removesuffix(")")) <= 1
    assert dialects.sampled_query("mysql", "q", 0.5, 7)[1].endswith("rand(7) < 0.5") and dialects.sampled_query("sqlite", "q", 0.5)[1].endswith("< 1073741824")
    assert dialects.sampled_table("postgresql", "s.t", "c", 0.1, 3, "bernoulli", "x") == 'SELECT "c" FROM "s"."t" TABLESAMPLE BERNOULLI (10.0) REPEATABLE (3) WHERE (x)'
    assert dialects.sampled_table("mariadb", "t`x", "c", 0.1, where="x") == "SELECT `c` FROM `t``x` WHERE (x) AND rand() < 0.1"
    assert dialects.sampled_table("clickhouse", "t`x", "c", 0.1, where="a > 1") == "SELECT `c` FROM `t``x` SAMPLE 0.1 WHERE (a > 1)"
    assert dialects.random_batch("sqlite", "q", 5).endswith("ORDER BY random() LIMIT 5")
    for call in (lambda: dialects.sampled_query("sqlite", "q", 0.5, 1), lambda: dialects.sampled_query("oracle", "q", 0.5), lambda: dialects.random_batch("oracle", "q", 1), lambda: dialects.sampled_table("clickhouse", "t", "c", 0.1, 1)):
        with pytest.raises(SamplingNotSupported):
            call()
    for call in (lambda: dialects.sampled_query("mysql", "q", 0), lambda: dialects.random_batch("mysql", "q", 0), lambda: dialects.sampled_table("postgresql", "t", "c", 0.1, method="x")):
        with pytest.raises(ValueError):
            call()


def test_row_budget(spark):
    got = lambda average, budget: spark.range(1).select(sampling.row_budget(F.lit(average).cast("double"), budget)).first()[0]
    assert got(None, 100) == 1000 and got(100, 3_000_000) == 10_000 and got(1, 2**60) == 1_000_000 and got(100, 0) == 1000


def test_window_templates_are_mined_apart(spark):
    text = [f"2024-01-01 {h:02d}:00:0{i} INFO job {i} done" for h in (1, 2) for i in range(4)] + [f"job {i} done" for i in range(3)]
    parsed = temporal.parse_lines(L.from_list(spark, text))
    got = {(r["window_key"] is None, r["cluster"]): (r["lines"], r["example"]) for r in temporal.window_templates(parsed, 60, 0.5).collect()}
    assert got == {(False, 0): (4, text[0]), (False, 4): (4, text[4]), (True, 8): (3, text[8])}
    summary = temporal.temporal_summary(parsed, 60, 0.5)
    assert summary["timeless"].first()["lines"] == 3 and summary["hourly"].count() == 2 and summary["levels"].first()["lines"] == 8


def test_window_templates_equal_serial_passes(spark):
    rng = random.Random(4)
    text = [f"2024-01-01 0{rng.randrange(3)}:00:00 {rng.choice('ab')} {rng.choice('xyz')} {rng.randrange(5)} end" for _ in range(120)]
    parsed = temporal.parse_lines(L.from_list(spark, text))
    miners, clusters = {}, {}
    for i, line in enumerate(text):
        tokens = line.split()
        name = miners.setdefault(line[:13], templates.Miner(0.5)).add(i, tokens)
        clusters[name] = clusters.get(name, 0) + 1
    assert {r["cluster"]: r["lines"] for r in temporal.window_templates(parsed, 60, 0.5).collect()} == clusters


def plain_scores(text):
    """TF-IDF and the unfamiliar share of each line, term by term."""
    df, tf = {}, {}
    for line in text:
        terms = anomaly.terms_of(line)
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
        for t in terms:
            tf[t] = tf.get(t, 0) + 1
    total = len(text)
    common = {t for t in df if df[t] > 0.9 * total}
    rest = sorted((t for t in df if t not in common and df[t] >= (2 if total > 100 else 1)), key=lambda t: -tf[t])
    most = max(1, min(1000, total // 10))
    kept = {t for t in rest[:most] if len(rest) <= most or tf[t] > tf[rest[most]]}
    out = []
    for line in text:
        terms = anomaly.terms_of(line)
        weights = {t: terms.count(t) * (math.log((1 + total) / (1 + df[t])) + 1) for t in set(terms) & kept}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1
        out.append(({t: w / norm for t, w in weights.items()}, sum(t not in kept and t not in common for t in terms) / len(terms)))
    return kept, common, out


def test_vectors_equal_plain_tf_idf(spark):
    rng = random.Random(6)
    text = [" ".join(rng.choices(["disk", "full", "user", "login", "10", "retry"], k=rng.randrange(2, 7))) + " end" for _ in range(150)]
    kept, common, plain = plain_scores(text)
    found, known = anomaly.vocabulary(L.from_list(spark, text), len(text))
    assert {t for t, _ in found} == kept and set(known) == common
    names = [t for t, _ in found]
    got = anomaly.vectors(text, {t: (i, idf) for i, (t, idf) in enumerate(found)}, frozenset(known))
    for row, (weights, strange) in zip(got, plain, strict=True):
        assert all(abs(row[i] - weights.get(t, 0)) < 1e-5 for i, t in enumerate(names)) and abs(row[-1] - strange) < 1e-6


def test_depths_equal_a_walk(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((300, 4)).astype(np.float32)
    tree = anomaly.grow(x, rng)

    def walk(node, row):
        return node[0] if len(node) == 1 else walk(node[2] if row[node[0]] <= node[1] else node[3], row)

    assert anomaly.depths(tree, x).tolist() == [walk(tree, row) for row in x]


def test_settings_from_env(monkeypatch):
    monkeypatch.setenv("A_MAX_PATTERNS", "7")
    monkeypatch.setenv("B_MAX_PATTERNS", "8")
    monkeypatch.setenv("B_FUZZY_THRESHOLD", "none")
    monkeypatch.setenv("B_TYPED_MASKING", "yes")
    s = Settings.from_env("A", "B")
    assert (s.max_patterns, s.fuzzy_threshold, s.typed_masking) == (7, None, True)
    with pytest.raises(ValueError):
        s.changed(nonsense=1)
