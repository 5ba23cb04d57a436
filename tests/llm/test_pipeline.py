"""The pipeline's stages against plain Python on the small tables."""

from __future__ import annotations

import hashlib
import re

import pytest
import tiktoken

import corpus_pipeline
from sluice.llm import bpe
from sluice.llm.common import fresh_path, table
from sluice.llm.queries import vocabulary


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, sf_dir):
    frames = [table(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, frames[-1], sf_dir).write.parquet(path)
        frames.append(spark.read.parquet(path))
    start, good, lines, single, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    assert all(f.columns == frames[0].columns for f in frames[:5])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"] for r in good}
    clean = [d for d, q in labels.items() if q == 1]
    assert len(kept) < len(start) and sum(d in kept for d in clean) >= 0.95 * len(clean)
    assert {r["doc_id"] for r in lines} == kept and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in lines)
    sets = {r["doc_id"]: shingles(r["text"]) for r in single}
    assert sets.keys() <= kept
    for r in lines:  # who went is near something that was there; who stayed is near no other that stayed
        mine = shingles(r["text"])
        near = [o["doc_id"] for o in lines if o["doc_id"] != r["doc_id"] and mine and (t := shingles(o["text"])) and 100 * len(mine & t) >= 75 * len(mine | t)]
        assert bool(near) if r["doc_id"] not in sets else not [d for d in near if d in sets]
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r["doc_id"] in sets
    assert max(times.values()) <= 2
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(single)) < 0.1 * words(single)
    path, pattern = vocabulary()
    with open(path, "rb") as file:
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in mixed}
    assert len(tokens) == len(mixed)
    for r in tokens:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (2, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (2, "quite another text that shares the id of a copy", "en", "a", 47),
    (None, "a text without any id that should stay", "en", "b", 39), (None, "a text without any id that should stay", "en", "b", 39), (None, "one more of these, with other words in it", "en", None, 41),
    (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "x " * 200_000, "en", "a", 400_000), (6, "same row", "en", "c", 8), (6, "same row", "en", "c", 8),
]


@pytest.mark.parametrize("rows", [[], ROWS], ids=["empty", "corners"])
def test_stages_take_corner_tables(spark, tmp_path, sf_dir, rows):
    """Null and repeated ids, null, empty and long texts, repeated rows, an extra column; and no rows at all."""
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    here = str(tmp_path / "sf")
    docs = table(spark, here, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, here).columns == docs.columns
    assert corpus_pipeline.keep_quality(spark, docs, here).count() in (0, len(rows))  # a constant model
    assert corpus_pipeline.drop_lines(spark, docs, here).count() == len(rows)
    single = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, here).collect()]
    assert sorted(single, key=str) == sorted({(r[0], r[1]) for r in rows} - {(2, ROWS[1][1])}, key=str)
    mixed = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, here).collect()]
    takes = corpus_pipeline.mixed_documents(docs).count()
    assert len(mixed) == takes and {t for t in mixed} <= {(r[0], r[1]) for r in rows if r[1]}
    assert corpus_pipeline.tokenise(spark, docs, here).count() == len(rows)
    assert corpus_pipeline.run(spark, here).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if not rows:
        assert corpus_pipeline.run(spark, here).count() == 0


def test_mix_is_in_training_order_and_whole(spark):
    """Copies stand at the positions of their own readings, for null and repeated ids and repeated rows as well."""
    from sluice.llm import mixing

    rows = [(i % 50 if i % 7 else None, "w " * (i % 23), "abc"[i % 3], i % 2) for i in range(300)] + [(1, "same thing twice", "a", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _position int")
    takes = mixing.mix(docs).where("taken > 0").collect()
    want = {}
    for r in takes:
        key = r["doc_id"], r["size"]
        want.setdefault(key, []).extend([r["position"], r["again"]][: int(r["taken"] / r["size"] + 0.5)])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = [(r["doc_id"], len(r["text"].split())) for r in mixed.collect()]
    assert len(got) == sum(map(len, want.values()))
    # the order: by brute force, all readings by their positions
    places = sorted(p for positions in want.values() for p in positions)
    at = {key: sorted(positions) for key, positions in want.items()}
    taken = {}
    for place, key in zip(places, got, strict=True):
        taken.setdefault(key, []).append(place)
    assert all(abs(a - b) < 1e-9 for key, positions in taken.items() for a, b in zip(positions, at[key], strict=True))
