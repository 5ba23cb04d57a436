"""Unusual lines: TF-IDF over word n-grams, scored by an isolation forest.

The vocabulary (at most 1000 terms) and the forest (grown from sub-samples of
256 lines) have fixed bounds and are sent to all tasks; terms are counted and
lines scored where they are.

Terms beyond the vocabulary would leave a line of nothing but new words without
any feature.  So there is one more feature, the share of a line's terms that are
neither in the vocabulary nor in nearly all lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .sampling import sample_key
from .templates import ship

TREES, SUBSAMPLE, MAX_TERMS, MAX_DF = 100, 256, 1000, 0.9
_TOKEN = re.compile(r"\b\w\w+\b")


def terms_of(line: str) -> list[str]:
    """Lower-case words of two characters or more, and their n-grams up to three."""
    tokens = _TOKEN.findall(line.lower())
    return [" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]


def vocabulary(lines: DataFrame, total: int) -> tuple[list[tuple[str, float]], list[str]]:
    """The most frequent terms with their inverse document frequency, and the terms of nearly all lines.

    Terms that tie at the end of the vocabulary are left out, all of them, unless nothing else is there; then the least
    hashes are taken.  So no term is preferred by its spelling.  The terms of more than MAX_DF of all lines are no more
    than the mean number of terms in a line, divided by MAX_DF.
    """
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for line in batch.column(0).to_pylist():
                found: dict[str, int] = {}
                for t in terms_of(line):
                    found[t] = found.get(t, 0) + 1
                names += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(counts, type=pa.int64())], names=["term", "n"])

    counted = lines.select("line").mapInArrow(run, "term string, n long").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))
    least, most = 2 if total > 100 else 1, max(1, min(MAX_TERMS, total // 10))
    counted = cut(counted.where((F.col("df") >= least) | (F.col("df") > MAX_DF * total)))
    common = [r["term"] for r in counted.where(F.col("df") > MAX_DF * total).select("term").collect()]
    top = counted.where(F.col("df") <= MAX_DF * total).orderBy(F.desc("tf"), F.xxhash64("term"), "term").limit(most + 1).collect()
    if len(top) > most:
        top = [r for r in top if r["tf"] > top[most]["tf"]] or top[:most]
    return [(r["term"], math.log((1 + total) / (1 + r["df"])) + 1) for r in top], common


def vectors(lines: list[str], terms: dict[str, tuple[int, float]], common: frozenset[str] = frozenset()) -> np.ndarray:
    """A row for each line: its normalised TF-IDF, and in the last column its share of unfamiliar terms."""
    out, strange = np.zeros((len(lines), len(terms) + 1), dtype=np.float32), np.zeros(len(lines), dtype=np.float32)
    for i, line in enumerate(lines):
        found, new = terms_of(line), 0
        for t in found:
            if (known := terms.get(t)) is not None:
                out[i, known[0]] += known[1]
            elif t not in common:
                new += 1
        strange[i] = new / len(found) if found else 0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.where(norms == 0, 1, norms)
    out[:, -1] = strange
    return out


def expected_depth(n: int) -> float:
    """The mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int = 0, most: int = 8) -> tuple:
    """A tree after Liu, Ting and Zhou (ICDM 2008): (feature, value, left, right) or (depth,)."""
    spread = np.flatnonzero(x.min(axis=0) < x.max(axis=0)) if len(x) else np.empty(0, dtype=int)
    if depth >= most or len(x) <= 1 or not len(spread):
        return (depth + expected_depth(len(x)),)
    feature = int(rng.choice(spread))
    low, high = float(x[:, feature].min()), float(x[:, feature].max())
    value = float(rng.uniform(low, high))
    left = x[:, feature] <= value
    return feature, value, grow(x[left], rng, depth + 1, most), grow(x[~left], rng, depth + 1, most)


def depths(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The depth at which each row of ``x`` ends; nodes hand on row numbers, never rows."""
    out, waiting = np.empty(len(x)), [(tree, np.arange(len(x)))]
    while waiting:
        node, rows = waiting.pop()
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            left = x[rows, node[0]] <= node[1]
            waiting += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def score_lines(lines: DataFrame, seed: int = 42) -> DataFrame | None:
    """``lines`` with ``score``, lower where a line is more unusual; None for fewer than 10 lines or no terms."""
    total = lines.count()
    if total < 10:
        return None
    kept, known = vocabulary(lines, total)
    if not kept:
        return None
    terms, common = {t: (i, idf) for i, (t, idf) in enumerate(kept)}, frozenset(known)
    # at most TREES * SUBSAMPLE lines reach the driver
    sampled = [r["line"] for r in lines.orderBy(sample_key(seed), "line_no").limit(TREES * SUBSAMPLE).select("line").collect()]
    rng, size = np.random.default_rng(seed), min(SUBSAMPLE, len(sampled))
    forest = []
    for _ in range(TREES):
        chosen = rng.choice(len(sampled), size, replace=False)
        forest.append(grow(vectors([sampled[i] for i in chosen], terms, common), rng, most=max(1, math.ceil(math.log2(max(2, size))))))
    model = lines.sparkSession.sparkContext.broadcast((terms, common, forest))
    norm = expected_depth(size) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, common, trees = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                x = vectors(part.column(1).to_pylist(), terms, common)
                score = -(2.0 ** (-np.mean([depths(t, x) for t in trees], axis=0) / norm))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(score, 12))], names=["line_no", "line", "score"])

    return lines.select("line_no", "line").mapInArrow(run, "line_no long, line string, score double")


def split_anomalies(lines: DataFrame, contamination: float, seed: int = 42) -> tuple[DataFrame | None, DataFrame]:
    """Unusual lines (line_no, line, score) and the rest; None where nothing can be told."""
    cores = lines.sparkSession.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() < cores:  # scoring takes far longer than moving so few lines
        lines = lines.repartition(cores, "line_no")
    scored = score_lines(lines, seed)
    if scored is None:
        return None, lines
    scored = cut(scored)
    limit = scored.agg(F.percentile_approx("score", contamination, 100_000)).first()[0]
    odd = F.col("score") < F.lit(limit)
    return scored.where(odd), scored.where(~odd).select("line_no", "line")
