"""The operators against brute force on small fixtures, and their corner cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import differences

import __spark_entry__
from sluice.llm import bpe, embedding_dedup, exact_dedup, graph, line_dedup, mixing, near_dedup, pii, quality, token_counts, warc
from sluice.llm.common import fresh_path
from sluice.llm.oracle import ORACLE_SQL
from sluice.llm.queries import QUERIES, vocabulary

DOCS = "doc_id long, text string, source string, digest string, kept string"


def docs(spark, texts, source="s"):
    """Documents with extra columns whose names clash with those of the operators."""
    rows = [(i, t, source if isinstance(source, str) else source[i], "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def near_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(40)]
    texts = [None, "", " \t\n", "one two", "One  two", "one two three"]
    for _ in range(40):  # near copies, many of them near each other through others only
        copy = base[:]
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(30)]
    texts += [" ".join(word() for _ in range(30)) for _ in range(20)]
    return texts + texts[6:12]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir) == []


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()} and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("kind", ["empty", "nulls", "same"])
def test_corner_tables(spark, kind):
    rows = {"empty": [], "nulls": [(None, None, None, None, None), (1, None, None, None, None), (2, "", "a", "x", "y")], "same": [(7, "aa bb cc", "s", "x", "y")] * 3}[kind]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0)] if kind == "nulls" else [], "doc_id long, quality int")
    vocabulary_ = vocabulary()
    n = len(rows)
    assert exact_dedup.exact_dedup(d).count() == n
    assert line_dedup.line_dedup(d).count() == n
    assert mixing.mix(d).count() == n
    assert near_dedup.near_dedup(d).count() == n
    assert pii.find_pii(d).count() == n
    assert bpe.token_digests(d, *vocabulary_).count() == n
    assert token_counts.token_counts(d, vocabulary_[0]).count() == n
    model = quality.fit_quality(d, labels)
    assert [r["score"] for r in quality.score_quality(d, model).collect() if not 0 <= r["score"] <= 1] == []
    assert quality.score_quality(d, model).count() == n and quality.keep_good(d, model).columns == d.columns
    assert line_dedup.line_dedup(d).columns[:5] == d.columns


def test_corner_vectors_and_pages(spark):
    vectors = "vec_id long, embedding array<float>, label int, key string, part string, u long"
    pages = "page_id long, url string, html string, shard string, digest string, first long"
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], vectors)).count() == 0
    rows = [(None, None, None, "a", "b", 1), (1, [], 0, "a", "b", 1), (2, [0.0], 0, "a", "b", 1), (3, [float("nan")], 0, "a", "b", 1), (4, [1.0], 0, "a", "b", 1), (5, [2.0], 0, "a", "b", 1), (5, [2.0], 0, "a", "b", 1), (6, [1.0], None, "a", "b", 1), (7, [1.0, None], 0, "a", "b", 1)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, vectors)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 0, 6), (7, 0, 7)]
    rows = [(None, None, None, "s", "d", 1), (1, "u", "", "s", "d", 1), (1, "u", "", "s", "d", 1), (2, None, "h" * 3_000_000, "s", "d", 1), (3, "v", "h" * 3_000_000, "s", "d", 1)]
    path = fresh_path(spark, "warc-corners")
    warc.write_warc(spark.createDataFrame(rows, pages), path)
    got = warc.read_warc(spark, path).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [(0, "response", None, 0), (1, "response", None, 0), (1, "response", None, 0), (2, "revisit", 3, 3_000_000), (3, "response", None, 3_000_000)]


def test_very_long_texts_and_clashing_names(spark):
    """Texts of a million characters, with and without spaces and line ends, beside columns named as anything inside the operators."""
    words = " ".join(f"w{i}" for i in range(150_000))
    lines = "\n".join(f"line number {i} which is rather long, I would say" for i in range(20_000))
    texts = [words, words + " more", "x" * 1_000_000, lines, lines, lines + "\nA", lines + "\nB", lines + "\nC", "Ab" * 400_000, "aB" * 400_000]
    names = ["id", "key", "text_hash", "own_0", "own_1", "_left", "_drop", "k0", "h", "at", "position", "n", "digest", "hash", "bucket", "start"]
    rows = [(i, t, "ab"[i % 2], *["x"] * len(names)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    near = {r["doc_id"]: r for r in near_dedup.near_dedup(d).collect()}
    assert [near[i]["component_id"] for i in range(len(texts))] == [0, 0, 2, 3, 3, 3, 3, 3, 8, 8] and near[0]["n_shingles"] == 149_996
    cleaned = line_dedup.line_dedup(d)
    assert cleaned.columns == [*d.columns, "n_lines", "n_dropped"]
    left = {r["doc_id"]: r for r in cleaned.collect()}
    assert (left[3]["text"], left[6]["text"], left[7]["text"], left[3]["n_dropped"]) == ("", "B", texts[7], 20_000)
    exact = {r["doc_id"]: r for r in exact_dedup.exact_dedup(d).collect()}
    assert (exact[3]["keep_id"], exact[3]["group_size"], exact[8]["keep_id"], exact[9]["kept"]) == (4, 2, 9, True)
    assert sum(r["size"] for r in mixing.mix(d).collect()) == sum(len(t.split()) for t in texts)
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns and {r["text"] for r in mixed.collect()} <= set(texts)
    model = quality.QualityModel(b"", b"", 0.5, (0.0,) * 3, (1.0,) * 3, (0.0, 1.0, 1.0, 1.0))
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(d, model).collect()}
    plain = quality.compressor(b"")
    for i, t in enumerate(texts):  # recomputed piece by piece
        size = sum(len(plain.compress(t.encode()[a : a + 1000])) for a in range(0, len(t.encode()), 1000))
        ratio = np.log(size / len(t.encode()) + 0.01)
        assert abs(scores[i] - 1 / (1 + np.exp(-(0 + ratio + ratio**2)))) < 1e-9
    assert pii.sanitise(d).columns == d.columns and bpe.token_digests(d, *vocabulary()).count() == token_counts.token_counts(d, vocabulary()[0]).count() == len(texts)


def test_quality_scores_brute(spark):
    """Scores recomputed from the model's dictionaries in plain Python, and the difference of both sizes behind them."""
    rng = random.Random(3)
    make = lambda good: " ".join(rng.choices(["stone", "river", "window", "morning"] if good else ["buy", "cheap", "click", "now!!!"], k=60))
    texts = [make(i % 3 > 0) for i in range(240)] + ["", None, "é" * 700]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    model = quality.fit_quality(docs(spark, texts), labels)
    good, bad = quality.compressor(model.good), quality.compressor(model.bad)
    for r in quality.score_quality(docs(spark, texts), model).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        pieces = [raw[a : a + 1000] for a in range(0, len(raw), 1000)] or [b""]
        g, b = (sum(len(c.compress(p)) for p in pieces) for c in (good, bad))
        ratio = np.log(min(g, b) / max(len(raw), 1) + 0.01)
        x = [(v - m) / s for v, m, s in zip(((g - b) / max(g + b, 1), ratio, ratio**2), model.mean, model.spread, strict=True)]
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.weights[0] + np.dot(x, model.weights[1:]))))) < 1e-9


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    got = dict((r["node"], r["root"]) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    texts = ["A b", "a B", None, "", "É", "é", "a b "]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        group = [j for j, u in enumerate(texts) if lower(u or "") == lower(t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(group), len(group), i == max(group))
        assert got[i]["text_sha256"] == hashlib.sha256(lower(t or "").encode()).hexdigest()


def test_line_dedup_brute(spark):
    rng = random.Random(1)
    common = ["Common line number %d that is rather long, é" % i for i in range(4)]
    texts = ["\n".join(rng.choice([*common, "  " + common[0].upper().replace("É", "é") + "\t", "short", "", f"own {rng.random()} line of some length, yes indeed"]) for _ in range(rng.randrange(6))) for _ in range(60)] + [None]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, set[int]] = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    for batches, fan in ((4, 3), (7, 2), (1, 3)):
        got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, texts), batches=batches, fan=fan).collect()}
        for i, t in enumerate(texts):
            all_lines = (t or "").split("\n")
            left = [x for x in all_lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
            assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"] or "") == (len(all_lines), len(all_lines) - len(left), "\n".join(left))


def test_mix_targets_and_positions(spark):
    rng = random.Random(2)
    names = [rng.choice(["a", "b", "c", None]) for _ in range(200)]
    got = mixing.mix(docs(spark, ["w " * rng.randrange(40) for _ in names], names)).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r["target"], r["source_size"]), []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
    for (target, size), rows in by.items():
        assert sum(r["taken"] for r in rows) == int(target) and target <= 2 * size + 1e-9
    assert abs(sum(t for t, _ in by) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at)


def test_mixed_documents_stand_at_the_positions_of_their_readings(spark):
    names = ["a"] * 100 + ["b"] * 300
    words = [5 + i % 7 for i in range(len(names))]
    out = [r["doc_id"] for r in mixing.mixed_documents(docs(spark, ["w " * n for n in words], names)).collect()]
    sizes = {s: sum(n for n, t in zip(words, names, strict=True) if t == s) for s in "ab"}
    targets = {"a": 2 * sizes["a"], "b": 1.5 * sum(sizes.values()) - 2 * sizes["a"]}  # a is capped
    schedules, readings = dict(zip("ab", mixing.SCHEDULES, strict=False)), {}
    for s in "ab":
        at = 0
        for i in sorted((i for i, t in enumerate(names) if t == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            for offset in (at, at + sizes[s]):
                left, u = offset / targets[s] * sum(schedules[s]), 0.0
                for m in schedules[s]:  # the time at which the integral of the schedule reaches the offset
                    u += min(left, m) / m / len(schedules[s])
                    left -= min(left, m)
                readings.setdefault(i, []).append(u)
            at += words[i]
    seen: dict[int, int] = {}
    got = []
    for i in out:
        got.append(readings[i][seen.setdefault(i, 0)])
        seen[i] += 1
    assert all(seen[i] == 2 for i in range(100)) and all(a <= b + 2e-9 for a, b in zip(got, got[1:], strict=False))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(items)
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))], links


def test_near_dedup_brute(spark):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    texts = near_texts()
    sets = [shingles(t) for t in texts]
    roots, _ = brute_components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs(spark, texts)).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(s), r, r == i) for i, (s, r) in enumerate(zip(sets, roots, strict=True))]


def test_embedding_dedup_brute(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    vecs = [rng.standard_normal(16) for _ in range(150)] + [centre + 0.05 * rng.standard_normal(16) for _ in range(60)]
    vecs += [v + 0.02 * rng.standard_normal(16) for v in vecs[:30]] + [vecs[0]] * 3
    rows = [(i, [float(np.float32(x)) for x in v], i % 2 if i < 200 else 0) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [None] + [1.0] * 15, 0), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:8], 0)]
    v32 = [None if v is None or None in v else np.array(v) for _, v, _ in rows]

    def linked(a, b):
        (i, _, la), (j, _, lb) = a, b
        x, y = v32[i], v32[j]
        if la is None or la != lb or x is None or y is None or len(x) != len(y) or not np.isfinite(x).all() or not np.isfinite(y).all() or not x.any() or not y.any():
            return False
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    roots, links = brute_components(rows, linked)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(frame).collect()}
    assert sum(got[i]["n_links"] > links[i] for i in range(len(rows))) == 0
    assert [got[i]["n_links"] for i in range(len(rows))] == [links[i] for i in range(len(rows))]
    assert [got[i]["component_id"] for i in range(len(rows))] == [roots[i] for i in range(len(rows))]
    assert embedding_dedup.embedding_dedup(frame.limit(0)).count() == 0


def test_embedding_dedup_finds_rare_links_in_poor_lists(spark):
    """Few links, far apart in one poor order: the audit must see it, and the cell must come out exact."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 32))
    x = np.concatenate((x, x[:12] + 0.24 * rng.standard_normal((12, 32)))).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.93
    np.fill_diagonal(links, False)
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(frame, k=2, orders=1, window=1).collect()}
    assert links.sum() >= 20 and [got[i] for i in range(len(x))] == links.sum(axis=1).tolist()


def test_embedding_dedup_of_dense_groups_is_exact(spark, monkeypatch):
    """Groups far larger than a list and than a block: all links are counted, and no cell is compared whole."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    monkeypatch.setattr(embedding_dedup, "unsettled", lambda sample, exact, least_recall: sample.select("part").limit(0))
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((3, 24))
    x = np.concatenate([c + 0.2 * rng.standard_normal((size, 24)) for c, size in zip(centres, (220, 90, 40), strict=True)] + [rng.standard_normal((300, 24))]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.93
    np.fill_diagonal(links, False)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    roots, _ = brute_components(rows, lambda a, b: links[a[0], b[0]])
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), k=4, most_k=16).collect()}
    assert links.sum(axis=1).max() > 100
    assert [got[i]["n_links"] for i in range(len(x))] == links.sum(axis=1).tolist() and [got[i]["component_id"] for i in range(len(x))] == [roots[i] for i in range(len(x))]


def test_embedding_dedup_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (2, [0.0, 1.0], 0), (None, [0.0, 1.0], 1), (3, None, 0)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 2, 1), (3, 0, 3)]


def test_embedding_audit_is_per_cell(spark):
    """A cell whose lists know half of its links is not settled by another that knows all."""
    rows = [(i, part, 4, 1000, 4000, i % 1000 < 300) for part, start in (("good", 0), ("bad", 1000)) for i in range(start, start + 600)]
    sample = spark.createDataFrame(rows, "id long, part string, n long, size long, known long, taken boolean")
    exact = spark.createDataFrame([(0, i, i, 0, 4 if c == "good" else 8) for i, c, *_ in rows if i % 1000 < 300], "kind int, a long, b long, n long, m long")
    assert [r["part"] for r in embedding_dedup.unsettled(sample, exact, 0.95).collect()] == ["bad"]


@pytest.fixture(scope="module")
def coders():
    path, pattern = vocabulary()
    with open(path, "rb") as file:
        content = file.read()
    ranks = bpe.read_ranks(content)
    return bpe.coder(content, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(coders):
    own, library = coders
    rng = random.Random(1)
    pieces = [*"aaab  \n\t\r é中文1234'st ll,.!\x1c\x85  😀", "the", "ing", " 's", "\n\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(3000)] + ["a" * 3000, " " * 50, "ab" * 2000, "", " ", "a \n b", "x" * 200 + " " + "y" * 20000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == ",".join(map(str, library.encode_ordinary(text)))
        assert own.decode(ids) == text.encode()


def test_bpe_round_trip(spark, coders):
    path, pattern = vocabulary()
    texts = ["Hello, wörld!", None, "", "a\tb  c\n"]
    encoded = bpe.encode_documents(docs(spark, texts), path, pattern)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: coders[1].encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert public_tokenizers.PATTERN == pattern


def test_longest_match_brute(spark, coders):
    tokens = set(coders[0].ranks)
    most = max(map(len, tokens))

    def greedy(text):
        n = 0
        for word in re.findall(rb"[^ \t-\r]+", text.encode()):
            rest = b" " + word
            while rest:
                size = next(k for k in range(min(most, len(rest)), 0, -1) if rest[:k] in tokens)
                rest, n = rest[size:], n + 1
        return n

    rng = random.Random(3)
    texts = ["".join(rng.choices([*"abcde \n中é😀", "tion", "the", "Straße ", "ing"], k=rng.randrange(60))) for _ in range(400)] + [None, "", " ", "a" * 5000]
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, texts), vocabulary()[0]).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [greedy(t or "") for t in texts]
    assert [got[i]["n_words"] for i in range(len(texts))] == [len((t or "").encode().split()) for t in texts]
    small = token_counts.LongestMatch(iter([bytes([b]) for b in range(256)] + [b"abcdx", b"bc", b"bcd", b"cdef", b" ab"]))
    assert small.count(b"abcdef") == 2 and small.count(b"abcdx") == 4


def test_pii_brute(spark):
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def base(text):
        out = []
        for k, rx in shapes.items():
            for m in re.finditer(rx, text):
                d = re.sub("[^0-9]", "", m.group())
                if (k != "ip" or all(int(p) <= 255 for p in m.group().split("."))) and (k != "card" or (14 <= len(d) <= 19 and luhn(d))) and (k != "phone" or 10 <= len(d) <= 15):
                    out.append((m.start(), list(shapes).index(k), f"{k}:{m.start()}:{m.end()}"))
        return ",".join(x[2] for x in sorted(out))

    rng = random.Random(9)
    bits = ["a@b.co", "x.y%z@q-r.org.", "a@b.c_d@e.fg", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49 30 1234567890123456", "é", "中", " ", "\n", "@", ".", "+", "7", "@@a.b", "-"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(300)] + [None, "", "a@b.co " * 700, "1" * 5000, "a" * 20000, "1 " * 3000, "+1" + " " * 3000, "a." * 4000 + "@"]
    got = {r["doc_id"]: r for r in pii.find_pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base(t or "")
        assert got[i]["base"] == want, t
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_pii_terms_brute(spark):
    """The method's own spans, recomputed from the definitions in plain Python."""
    import math

    rng = random.Random(12)
    names = ["Zorblax", "Quimby", "Äther", "office", "mail", "today", "report", "the"]
    reach, alpha, support = 64, 1.25, 3
    texts = []
    for i in range(120):
        words = rng.choices(names, [0.1, 0.1, 0.05, 8, 8, 8, 8, 9], k=rng.randrange(3, 30))
        if i % 3 == 0:
            owner = rng.choice(["Zorblax", "Quimby", "Äther"])
            at = rng.randrange(len(words))
            words[at:at] = [owner, {"Zorblax": "zed@mail.org", "Quimby": "+49 30 123456789", "Äther": "10.1.2.3"}[owner]]
        texts.append(" ".join(words))
    shape = re.compile(r"(?P<email>zed@mail\.org)|(?P<phone>\+49 30 123456789)|(?P<ip>10\.1\.2\.3)")
    term = re.compile(r"\w{3,}")
    texts = sorted(set(texts))
    near, holds, in_doc = {}, {}, {}
    for i, t in enumerate(texts):
        for w in set(x.lower() for x in term.findall(t)):
            in_doc.setdefault(w, set()).add(i)
        for e in shape.finditer(t):
            holds.setdefault(e.group(), set()).add(i)
            for part, start in ((t[max(0, e.start() - reach) : e.start()], max(0, e.start() - reach)), (t[e.end() : e.end() + reach], e.end())):
                for m in term.finditer(part):
                    a, b = start + m.start(), start + m.end()
                    torn = (m.start() == 0 and start > 0 and start < e.start()) or (b == e.end() + reach and start == e.end())
                    if not torn:
                        near.setdefault((e.group(), m.group().lower()), set()).add((i, a, b))
    n, want = len(texts), {i: set() for i in range(len(texts))}
    for (e, w), places in near.items():
        n_et = len({i for i, _, _ in places})
        if n_et >= support and math.log2(n / len(holds[e])) > 0 and math.log2(n_et * n / (len(holds[e]) * len(in_doc[w]))) >= math.log2(n / len(holds[e])) / alpha:
            for i, a, b in places:
                if not any(a < m.end() and m.start() < b for m in shape.finditer(texts[i])):
                    want[i].add(f"term:{a}:{b}")
    assert sum(map(len, want.values())) > 20
    for r in pii.find_pii(docs(spark, texts)).collect():
        assert {s for s in r["spans"].split(",") if s.startswith("term:")} == want[r["doc_id"]], texts[r["doc_id"]]


def test_sanitise_brute(spark):
    """Every span replaced from left to right, recomputed from the spans that were found."""
    filler = [f"filler{i} words" for i in range(40)]
    texts = [f"{filler[i]} Zorblax writes{' room7' if i % 2 else ''} from zed@mail.org 1.2.3.4@x.org é again" + " gap" * 1500 + " +49 30 123456789 end" for i in range(6)] + [f"{f} again from nobody writes" for f in filler] + [None, ""]
    texts += [f"{filler[6]} room7"]
    found = {r["doc_id"]: r for r in pii.find_pii(docs(spark, texts)).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, texts)).collect()}
    labels = set()
    for i, t in enumerate(texts):
        at, out = 0, ""
        full = {r["start"] for r in found[i]["terms"] if r["full"]}
        for kind, start, end in (x.split(":") for x in found[i]["spans"].split(",") if x):
            start, end = int(start), int(end)
            if start >= at:
                word = t[start:end]
                looks = "<NUMBER>" if re.search("[0-9]", word) else "<NAME>" if word[0].isupper() else "<WORD>"
                label = f"<{kind.upper()}>" if kind != "term" else "" if start in full else looks
                labels.add(label)
                out += t[at:start] + label
            at = max(at, end)
        assert clean[i] == (out + t[at:] if found[i]["spans"] else t)
    assert {"<EMAIL>", "<PHONE>", ""} <= labels and labels & {"<NUMBER>", "<NAME>", "<WORD>"}


def test_pii_is_linear_in_matches(spark):
    import time

    d = docs(spark, ["1." * 100_000, "a@b.co " * 20_000])
    began = time.time()
    assert [r["text"][:8] for r in pii.sanitise(d).orderBy("doc_id").collect()] == ["<IP>.<IP", "<EMAIL> "]
    assert time.time() - began < 60
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_pii(d).collect()}
    assert got[0]["n_ip"] == 25_000 and got[1]["n_email"] == 20_000 and time.time() - began < 60


def test_pii_terms_that_reveal_an_entity(spark):
    filler = [f"filler{i} words" for i in range(30)]
    texts = [f"{filler[i]} Zorblax writes from zed@mail.org again" for i in range(5)] + [f"{f} again from nobody writes" for f in filler]
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs(spark, texts)).collect()}
    for i in range(5):
        start = texts[i].index("Zorblax")
        assert f"term:{start}:{start + 7}" in found[i] and f"term:{texts[i].index('again')}" not in found[i]
    assert all(found[i] == "" for i in range(5, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "<EMAIL>" in clean[0] and "zed@" not in clean[0] and "Zorblax" not in clean[0] and clean[9] == texts[9]


def test_pii_terms_in_whole_texts(spark, tmp_path):
    """The query marks a term wherever it stands in a text that holds its entity, recomputed in plain Python."""
    import math

    rng = random.Random(21)
    alpha, support = 1.25, 3
    owners = {"Zorblax": "zed@mail.org", "Quimby": "+49 30 123456789", "Äther": "10.1.2.3", "İris": "4111 1111 1111 1111"}
    texts = []
    for i in range(160):
        words = rng.choices(["office", "mail", "today", "report", "the", "zed", *owners], [8, 8, 8, 8, 9, 0.1, 0.004, 0.004, 0.004, 0.004], k=rng.randrange(3, 300))
        for owner in rng.sample(list(owners), rng.choice([0, 0, 1, 2])):
            words[0:0] = [owner]
            words.append(rng.choice(["", "", "привет"]) + owners[owner] + ("中文字" if i % 4 == 0 else ""))
            words += ["by", *rng.choices(["office", "the", owner], k=rng.randrange(4))] + ["1.2.3.4@x.org"] * (i % 7 == 0)
        texts.append(" ".join(words))
    texts += [texts[0], None, "", "привет 中文字"]
    email, term = re.compile(r"[\w.]+@[\w-]+(\.[a-z0-9]+)+", re.ASCII), re.compile(r"\w{3,}")
    known = re.compile(r"\+49 30 123456789|10\.1\.2\.3|4111 1111 1111 1111|1\.2\.3\.4")
    holds, in_doc, places = {}, {}, []
    for i, t in enumerate(t or "" for t in texts):
        spans = [m for rx in (email, known) for m in rx.finditer(t)]
        rest = list(t)
        for m in spans:
            holds.setdefault(m.group().lower(), set()).add(i)
            rest[m.start() : m.end()] = " " * len(m.group())
        own = {}
        for m in term.finditer("".join(rest)) if spans else ():
            own.setdefault(m.group().lower(), []).append((m.start(), m.end()))
        places.append(own)
        for w in {m.group().lower() for m in term.finditer(t)} | set(own):
            in_doc.setdefault(w, set()).add(i)
    n, want = len(texts), {i: set() for i in range(len(texts))}
    for e, rows in holds.items():
        for w in {w for i in rows for w in places[i]}:
            both = {i for i in rows if w in places[i]}
            if len(both) >= support and len(rows) < n and math.log2(len(both) * n / (len(rows) * len(in_doc[w]))) >= math.log2(n / len(rows)) / alpha:
                for i in both:
                    want[i] |= {(a, b, len(both) == len(in_doc[w])) for a, b in places[i][w]}
    want = {i: {(a, b, any(x[:2] == (a, b) and x[2] for x in of)) for a, b, _ in of} for i, of in want.items()}
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["spans"] for r in QUERIES["op9_pii"](spark, str(tmp_path)).collect()}
    assert sum(b < texts[i].index(next(filter(texts[i].__contains__, owners.values()))) - 64 for i, of in want.items() for _, b, _ in of) > 20
    for i in range(n):
        assert {s for s in got[i].split(",") if s.startswith("term:")} == {f"term:{a}:{b}" for a, b, _ in want[i]}, texts[i]
    found = {r["doc_id"]: r for r in pii.find_pii(docs(spark, texts), reach=None).collect()}
    assert all({(x["start"], x["end"], x["full"]) for x in found[i]["terms"]} == want[i] and found[i]["spans"] == got[i] for i in range(n))
    assert len({f for of in want.values() for *_, f in of}) == 2


def test_pii_copies_with_many_entities_and_words(spark):
    """7000 entities and 3000 words that the same four long texts hold: judged as one, not as 21 million pairs."""
    body = "".join(f"u{j % 7000}@b.co w{j % 3000:04} " for j in range(10_000))
    d = docs(spark, [f"x{i}@b.co {body}" for i in range(4)] + ["plain words"])
    terms = {r["doc_id"]: r["terms"] for r in pii.find_pii(d, reach=None).collect()}
    assert [len(terms[i]) for i in range(5)] == [10_000] * 4 + [0] and all(t["full"] for t in terms[0])


def test_quality_separates_held_out_documents(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["plain", "words", "form", "a", "text", "that", "reads", "well"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW$$", "###", "CLICK%%"]) for _ in range(80))
    texts = [good() if i % 3 else bad() for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    d = docs(spark, texts)
    model = quality.fit_quality(d, labels)
    got = quality.score_quality(d, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["held_out"]]) > 0.97
    assert quality.keep_good(d, model).count() == sum(r["predicted"] for r in got)
    assert model == quality.fit_quality(d.repartition(5), labels.repartition(3))


def test_warc_round_trip_is_deterministic(spark):
    page = "<p>é</p>" * 200
    rows = [(i, f"http://x/{i}", page if i % 3 == 0 else f"<p>{i}</p>" * (i * 10)) for i in range(40)] + [(41, None, None), (None, "u\r\nv", "z"), (42, "same", "tiny"), (43, "same", "tiny"), (39, "again", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = [fresh_path(spark, "warc-test") for _ in range(2)]
    files = [warc.write_warc(p, path, shards=4, roll_bytes=1500) for p, path in zip((pages, pages.repartition(7)), paths, strict=True)]
    assert [f["sha256"] for f in files[0]] == [f["sha256"] for f in files[1]] and len(files[0]) > 3
    got = sorted(warc.read_warc(spark, paths[0]).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r["page_id"])
        copy = len(html.encode()) >= 1000 and html == page and r["page_id"] != 39
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "revisit" if copy else "response", 39 if copy else None)
        assert copy or r["payload"] == html.encode()
    empty = fresh_path(spark, "warc-test")
    assert warc.write_warc(pages.limit(0), empty) == [] and warc.read_warc(spark, empty).count() == 0




def test_warc_takes_sparse_ids_and_is_read_in_small_parts(spark, monkeypatch):
    ids = [1, 2**36 + 1, 2**53 + 1, 2**53 + 3, 9 * 10**18, -5, None, *range(1000, 1400)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", "p" * 1200 if n % 2 else f"<p>{i}" * (n % 50)) for n, i in enumerate(ids)], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-sparse")
    files = warc.write_warc(pages, path, shards=6)
    assert len(files) > 3 and max(f["records"] for f in files) < 200
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    got = warc.read_warc(spark, path).collect()
    want = {r["page_id"]: r["html"] for r in pages.collect()}
    last = max(i for n, i in enumerate(ids) if n % 2 and i is not None)
    assert sorted((r["page_id"] is not None, r["page_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i in ids)
    for r in got:
        full = want[r["page_id"]]
        assert (r["refers_to"], r["payload_bytes"]) == (last if full == "p" * 1200 and r["page_id"] != last else None, len(full))
        assert r["payload_digest"] == hashlib.sha1(full.encode()).hexdigest() and (r["payload"] is None or r["payload"].decode() == full)
