"""Near-duplicate documents by bottom-k sketches.

A document's set holds the hashes of its distinct word shingles; its sketch is
the k least of them, under one hash function.  Documents with equal sets are one
class and one representative stands for it.  Inverted lists lead from retained
values to representatives; members of a list are compared by the overlaps of
their sketches, the sketch of the union estimates their similarity, and the full
sets decide.  A sketch that holds the whole set decides at once.

What keeps the lists short, and what may be lost by it:

* Of two similar documents' sketches at least ``least`` values are common, so the
  ``s - least + 1`` rarest values of each hold a common one, and only those enter
  the lists.  Frequent passages thus matter only to documents of little else.
  ``least`` is exact where all similar sets fit into sketches.  Elsewhere it is
  the tail bound of a draw without replacement (Chernoff, Serfling) at 1e-12 a
  pair, which is less than what 64-bit hashes of the full sets themselves risk.
* Lists with equal members are one list.

What keeps the work in a list bounded:

* A list of up to ``BLOCK`` members is compared in one place, and leaves as a
  spanning forest: the links that whole sketches prove, and of the pairs that
  need their texts only the most similar ones that would join its parts.  Members
  of pairs beyond these are named.
* A longer list is dealt into blocks, each with the same few pilots, so that a
  dense group is joined through them without its pairs.
* Components of these links follow.  Where named members, or those of a dealt
  list, are still apart, the list is taken up once more: members outside its
  largest component are compared with all that are in another one.  No pair
  within a component is looked at, and none across is left out.  Their documents
  get longer sketches, so that nearly all of these pairs are decided in place too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, partitions, scratch, ship, stored, text_or_empty, tidy, whole_groups
from .graph import components

#: Values that a sketch retains.
K = 128
#: Values of the longer sketches that the second turn takes of its few documents.
LONG_K = 1024
#: Members of a list that are compared in one place, and those of a longer list that all its blocks hold.
BLOCK, PILOTS = 1024, 32
#: The chance that a similar pair shares fewer values than ``least``.
RISK = 1e-12
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without ASCII white space, A-Z lower-cased.  A text of fewer
    words than ``size`` has one shingle, all of them; one without words none.
    """
    words = text.lower().split()  # on bytes, both know ASCII only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        acc = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            acc = acc * _MULTIPLIER + h[i : len(words) - width + 1 + i]
        acc = (acc ^ (acc >> np.uint64(30))) * _MIX
        acc = (acc ^ (acc >> np.uint64(27))) * _MIX2
        acc ^= acc >> np.uint64(31)
    acc.sort()
    return acc[np.append(True, acc[1:] != acc[:-1])]


@lru_cache(maxsize=1 << 16)
def least_shared(n: int, k: int, percent: int) -> int:
    """How many of the k least values of a union are common, for a set of n values and any that is similar to it."""
    largest = n * 100 // percent  # of the unions that are still similar; the least has n values
    least = -(-n * percent // 100)
    if largest <= k:
        return least
    t, evidence = percent / 100, -math.log(RISK)

    def safe(found: int) -> bool:
        x = found / k
        chernoff = k * ((x * math.log(x / t) if x else 0.0) + (1 - x) * math.log((1 - x) / (1 - t)))
        return chernoff >= evidence or 2 * (t - x) ** 2 * k / (1 - (k - 1) / largest) >= evidence

    least = min(least, int(k * t))
    while least > 1 and not safe(least - 1):
        least -= 1
    return least


def sketches(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int, size: int) -> DataFrame:
    """key (of the row), id, text_hash, n (shingles), least (shared with a similar set), digest (of the set), sketch (its k least values)."""
    ship(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, least, digests, values, offsets = [], [], [], [], [0]
            for text in batch.column(3).to_pylist():
                found = shingle_hashes(text, size)
                n.append(len(found))
                least.append(least_shared(len(found), k, percent))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                values.append(found[:k].view(np.int64))
                offsets.append(offsets[-1] + len(values[-1]))
            flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat))
            columns = [*batch.columns[:3], pa.array(n, type=pa.int64()), pa.array(least, type=pa.int32()), pa.array(digests, type=pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "text_hash", "n", "least", "digest", "sketch"])

    text = text_or_empty(text_col)
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"key long, id {kind}, text_hash long, n long, least int, digest binary, sketch array<long>")


def overlaps(flat: np.ndarray, row: np.ndarray, members: int, split: int = 0) -> np.ndarray:
    """How many values each two members have in common; ``row``, in order, has the member of each value of ``flat``.

    With ``split``, of each member before it with each member from it on.
    """
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order].astype(np.int32)
    new = np.append(True, flat[1:] != flat[:-1])
    counts = np.diff(np.append(np.flatnonzero(new), len(flat)))
    column = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    shape = (split, members - split) if split else (members, members)
    few = 32  # pairs of such short columns are counted one by one, longer columns by a product of matrices
    short = counts[column] <= few
    r, c = row[short], column[short]
    cells = []
    for d in range(1, few):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        low, high = r[same], r[same + d]
        if split:
            across = (low < split) & (high >= split)
            low, high = low[across], high[across] - split
        cells.append(low * np.int32(shape[1]) + high)
    common = np.bincount(np.concatenate(cells), minlength=shape[0] * shape[1]).astype(np.float32).reshape(shape) if cells else np.zeros(shape, dtype=np.float32)
    if not split:
        common += common.T.copy()
    r, c = row[~short], column[~short]
    if len(c):
        c = np.cumsum(np.append(False, c[1:] != c[:-1]))
        for low in range(0, int(c[-1]) + 1, 2048):
            here = slice(*np.searchsorted(c, (low, low + 2048)))
            block = np.zeros((members, min(2048, int(c[-1]) + 1 - low)), dtype=np.float32)
            block[r[here], c[here] - low] = 1
            common += block[:split] @ block[split:].T if split else block @ block.T
    return common


def union_shares(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """For rows of two arrays of sketches: how many of the k least values of their union both have.

    Shorter sketches are filled up with the largest number, which must not come among the k.
    """
    both = np.concatenate((a, b), axis=1)
    both.sort(axis=1)
    twice = both[:, 1:] == both[:, :-1]
    place = np.cumsum(~twice, axis=1, dtype=np.int32)  # of each value but the first among the distinct ones, from 0
    return np.count_nonzero(twice & (place < k), axis=1)


def _labels(linked: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The components of a symmetric matrix of links, on top of those that ``label`` has already."""
    label = label.copy()
    while True:
        low = np.where(linked, label[None, :], len(label)).min(axis=1)
        low = np.minimum(low, label)
        step = np.full(len(label), len(label))
        np.minimum.at(step, label, low)  # a component goes where its least neighbour is
        new = step[label]
        while (new[new] < new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _tree(score: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the best spanning forest of ``score`` (-1: none) between components of members."""
    parts, of = np.unique(label, return_inverse=True)
    found, waiting = [], np.ones(len(parts), dtype=bool)
    best, source = np.full(len(score), -1.0), np.zeros(len(score), dtype=np.int64)
    for first in range(len(parts)):
        part = first
        while waiting[part]:
            waiting[part] = False
            for member in np.flatnonzero(of == part).tolist():
                better = score[member] > best
                best[better], source[better] = score[member][better], member
            open_ = np.where(waiting[of], best, -1.0)
            at = int(open_.argmax())
            if open_[at] < 0:
                break
            found.append((int(source[at]), at))
            part = int(of[at])
        best[:] = -1.0
    return found


class Unit:
    """Members that are compared with each other: keys, components, sizes of their sets, sketches."""

    def __init__(self, keys: np.ndarray, comp: np.ndarray, n: np.ndarray, ends: np.ndarray, values: np.ndarray, percent: int, k: int):
        self.keys, self.comp, self.n, self.ends, self.values, self.percent, self.k = keys, comp, n, ends - ends[0], values, percent, k
        self.least = np.array([least_shared(x, k, percent) for x in n.tolist()], dtype=np.int32)

    def matrices(self, split: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of members before ``split`` with those from it on (0: all with all): what they have in common, which pairs of
        different components are links for certain, and which may be."""
        a, b = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
        common = overlaps(self.values, np.repeat(np.arange(len(self.keys)), np.diff(self.ends)), len(self.keys), split)
        na, nb = self.n[a, None], self.n[None, b]
        asked = (self.comp[a, None] != self.comp[None, b]) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * self.percent)
        whole = (na <= self.k) & (nb <= self.k)
        linked = asked & whole & (common * 100 >= (na + nb - common) * self.percent)
        maybe = asked & ~whole & (common >= np.minimum(self.least[a, None], self.least[None, b]))
        return common, linked, maybe

    def allowed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs the estimates by the sketches of their unions allow, and these estimates."""
        table = np.full((len(self.keys), self.k), np.iinfo(np.uint64).max, dtype=np.uint64)
        row = np.repeat(np.arange(len(self.keys)), np.diff(self.ends))
        table[row, np.arange(len(self.values)) - np.repeat(self.ends[:-1], np.diff(self.ends))] = self.values
        step = max(1, (1 << 18) // self.k)
        shares = [union_shares(table[i[a : a + step]], table[j[a : a + step]], self.k) for a in range(0, len(i), step)]
        shares = np.concatenate(shares) if shares else np.empty(0, dtype=np.int64)
        return shares >= np.minimum(self.least[i], self.least[j]), shares

    def first_turn(self) -> tuple[list, list, list]:
        """Proven links that make a forest, the best pairs that might join its trees, and members of other such pairs."""
        _, linked, maybe = self.matrices()
        label = _labels(linked, np.arange(len(self.keys)))
        sure = [(i, int(x)) for i, x in enumerate(label.tolist()) if i != x]
        i, j = np.nonzero(np.triu(maybe & (label[:, None] != label[None, :]), 1))
        good, shares = self.allowed(i, j)
        i, j, shares = i[good], j[good], shares[good]
        if not len(i):
            return sure, [], []
        score = np.full(maybe.shape, -1.0, dtype=np.float32)
        score[i, j] = score[j, i] = shares
        pairs = _tree(score, label)
        return sure, pairs, [] if len(pairs) == len(i) else np.unique(np.concatenate((i, j))).tolist()

    def second_turn(self, split: int) -> tuple[list, list]:
        """Proven links that join components, one for each two of them, and all other pairs that may."""
        _, linked, maybe = self.matrices(split)
        if not split:
            linked, maybe = np.triu(linked, 1), np.triu(maybe, 1)
        i, j = np.nonzero(linked)
        j = j + split
        _, first = np.unique(np.stack((np.minimum(self.comp[i], self.comp[j]), np.maximum(self.comp[i], self.comp[j]))), axis=1, return_index=True)
        joined = {(x, y) for a, b in zip(self.comp[i[first]].tolist(), self.comp[j[first]].tolist(), strict=True) for x, y in ((a, b), (b, a))}
        p, q = np.nonzero(maybe)
        good, _ = self.allowed(p, q + split)
        open_ = [(a, b) for a, b in zip(p[good].tolist(), (q[good] + split).tolist(), strict=True) if (self.comp[a], self.comp[b]) not in joined]
        return list(zip(i[first].tolist(), j[first].tolist(), strict=True)), open_


def compared_units(placed: DataFrame, percent: int, k: int, turn: int) -> DataFrame:
    """(list, kind, a, b) of units of lists; kind 0: a proven link, 1: a pair to be compared in full, 2: a member (a) of pairs left.

    ``placed`` has a row for each member of a unit: list, unit, side, key, comp, n, sketch.  Members of the same comp are
    joined already; in a unit with two sides the pairs across them matter.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            lists, units, sides, keys, comps, ns = (table.column(i).to_numpy() for i in range(6))
            sketch = table.column(6).combine_chunks()
            ends, values = sketch.offsets.to_numpy(), sketch.values.to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.append(True, (lists[1:] != lists[:-1]) | (units[1:] != units[:-1])))
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(lists)], strict=True):
                if b - a < 2:
                    continue
                unit, left = Unit(keys[a:b], comps[a:b], ns[a:b], ends[a : b + 1], values[ends[a] : ends[b]], percent, k), []
                if turn == 1:
                    sure, pairs, left = unit.first_turn()
                else:
                    split = int(np.count_nonzero(sides[a:b] == 0))
                    sure, pairs = unit.second_turn(split) if 0 < split < b - a else unit.second_turn(0) if split else ([], [])
                name = int(lists[a])
                out += [(name, kind, *sorted((int(unit.keys[i]), int(unit.keys[j])))) for kind, found in ((0, sure), (1, pairs)) for i, j in found]
                out += [(name, 2, int(unit.keys[i]), None) for i in left]
            columns = [pa.array(x, type=t) for x, t in zip(zip(*out, strict=True) if out else ([], [], [], []), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "kind", "a", "b"])

    rows = placed.select("list", "unit", "side", "key", "comp", "n", "sketch")
    return rows.repartition(partitions(rows.sparkSession), "list", "unit").sortWithinPartitions("list", "unit", "side").mapInArrow(run, "list long, kind int, a long, b long")


def texts_of(keys: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of the rows in ``keys``, once each."""
    wanted = sets.select("key", "id", "text_hash").join(keys.select("key").distinct(), "key", "left_semi").withColumnRenamed("id", "w")
    wanted = broadcast_if_small(stored(wanted, "near-wanted"))
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    texts = source.join(wanted, F.col("id").eqNullSafe(F.col("w")) & (source["text_hash"] == wanted["text_hash"])).select("key", "text")
    return texts.dropDuplicates(["key"])


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, both, either): the sizes of the intersection and the union of the full sets."""
    ta, tb = (texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    rows = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            both, either = [], []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last[0] != a:
                    last = a, shingle_hashes(ta.as_py(), size)
                left, right = last[1], shingle_hashes(tb.as_py(), size)
                both.append(len(np.intersect1d(left, right, assume_unique=True)))
                either.append(len(left) + len(right) - both[-1])
            counts = [pa.array(x, type=pa.int64()) for x in (both, either)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *counts], names=["a", "b", "both", "either"])

    return rows.mapInArrow(run, "a long, b long, both long, either long")


def longer_sketches(texts: DataFrame, k: int, size: int) -> DataFrame:
    """key, n, sketch (the k least values of the set) of texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(text.as_py(), size) for text in batch.column(1)]
            sketch = pa.array([x[:k].view(np.int64) for x in sets], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], type=pa.int64()), sketch], names=["key", "n", "sketch"])

    return texts.mapInArrow(run, "key long, n long, sketch array<long>")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(list, size, key): the members of each list of a retained value, one of each set of lists with the same members."""
    values = reps.select("key", "least", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    entries = values.join(shared, "value").groupBy("key", "least").agg(F.array_sort(F.collect_list(F.struct("freq", "value"))).alias("e"))
    # values of no other document are the rarest of all and take their places among the s - least + 1
    entries = entries.where(F.size("e") >= F.col("least"))
    lists = stored(entries.select("key", F.explode(F.slice("e", F.lit(1), F.size("e") - F.col("least") + 1)).alias("x")).select(F.col("x.value").alias("list"), "key"), "near-lists")
    same = lists.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("h2"))
    chosen = same.where("size > 1").groupBy("size", "h1", "h2").agg(F.min("list").alias("list")).select("list", "size")
    return lists.join(chosen, "list").select("list", "size", "key")


def _components_of_sets(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int, k: int, long_k: int, block: int, pilots: int) -> tuple[DataFrame, DataFrame]:
    """The table of all rows' sets, and (digest, least_id, root) of the distinct ones."""
    sets = stored(sketches(docs, id_col, text_col, percent, k, size), "near-sets", 2000)
    classes = stored(sets.where("n > 0").groupBy("digest").agg(F.min("key").alias("rep"), F.min("id").alias("least_id")), "near-classes")
    reps = sets.join(broadcast_if_small(classes.select("rep")), F.col("key") == F.col("rep"), "left_semi")
    lists = stored(inverted_lists(reps), "near-members")
    listed = broadcast_if_small(stored(lists.select("key").distinct(), "near-listed"))
    facts = sets.join(listed, "key", "left_semi").select("key", "n", "sketch")

    def verified(found: DataFrame) -> DataFrame:
        pairs = found.where("kind = 1").select("a", "b").distinct()
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key"))
        texts = stored(texts_of(keys, sets, docs, id_col, text_col), "near-texts")
        links = stored(compared(pairs, texts, size), "near-compared", 200).where(F.col("both") * 100 >= F.col("either") * percent)
        return found.where("kind = 0").select("a", "b").unionByName(links.select("a", "b"))

    blocks = F.ceil(F.col("size") / block).cast("int")
    hashed = lambda by: F.pmod(F.xxhash64(F.lit("block"), "key"), by).cast("int")
    pilot = F.pmod(F.xxhash64(F.lit("pilot"), "key"), F.col("size")) < pilots
    units = F.when(blocks == 1, F.array(F.lit(0))).when(pilot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(hashed(blocks)))
    placed = lists.select("list", F.explode(units).alias("unit"), "key").join(facts, "key")
    placed = placed.select("list", F.col("unit").cast("long").alias("unit"), F.lit(0).alias("side"), "key", F.col("key").alias("comp"), "n", "sketch")
    found = stored(compared_units(placed, percent, k, 1), "near-found", 2000)
    joined = components(verified(found))

    # the second turn, of named members and of dealt lists: those outside a list's largest component with all that are in another
    unsettled = found.where("kind = 2").select("list", F.col("a").alias("key")).join(lists.where(blocks == 1).select("list").distinct(), "list", "left_semi")
    unsettled = unsettled.unionByName(lists.where(blocks > 1).select("list", "key"))
    now = stored(unsettled.join(joined, F.col("key") == F.col("node"), "left").select("list", "key", F.coalesce("root", "key").alias("comp")), "near-unsettled")
    shares = now.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("held"))
    apart = shares.groupBy("list").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("held", "comp")).alias("main"), F.sum("held").alias("size")).where("comps > 1")
    apart = stored(apart.select("list", "size", F.col("main.comp").alias("main"), F.col("main.held").alias("inside")), "near-apart")
    if not apart.isEmpty():
        mains, others = (F.greatest(F.lit(1), F.ceil(c / block)).cast("int") for c in (F.col("inside"), F.col("size") - F.col("inside")))
        number = lambda kind, i, j: (i.cast("long") * (1 << 30) + j) * 2 + kind
        pair = lambda kind, i, j, side: F.struct(number(kind, i, j).alias("unit"), side.cast("int").alias("side"))
        mine = F.when(F.col("comp") == F.col("main"), hashed(F.col("b_main"))).otherwise(hashed(F.col("b_other")))
        inside = F.transform(F.sequence(F.lit(0), F.col("b_other") - 1), lambda i: pair(0, i, F.col("mine"), F.lit(1)))
        outside = F.concat(
            F.transform(F.sequence(F.lit(0), F.col("b_main") - 1), lambda j: pair(0, F.col("mine"), j, F.lit(0))),
            F.transform(F.sequence(F.lit(0), F.col("b_other") - 1), lambda j: pair(1, F.least("mine", j), F.greatest("mine", j), F.col("mine") > j)),
        )
        together = F.array(pair(1, F.lit(0), F.lit(0), F.lit(0)))  # all with all
        where = F.when(F.col("size") <= block, together).when(F.col("comp") == F.col("main"), inside).otherwise(outside)
        members = now.join(apart, "list").withColumns({"b_main": mains, "b_other": others}).withColumn("mine", mine)
        members = members.select("list", "key", "comp", F.explode(where).alias("u"))
        longer = stored(longer_sketches(texts_of(now.join(apart.select("list"), "list", "left_semi"), sets, docs, id_col, text_col), long_k, size), "near-longer", 1000)
        placed = members.select("list", "u.unit", "u.side", "key", "comp").join(longer, "key")
        late = verified(stored(compared_units(placed, percent, long_k, 2), "near-late", 1000))
        for x in "ab":  # between the components that are joined already
            late = late.join(joined, F.col(x) == F.col("node"), "left").withColumn(x, F.coalesce("root", x)).select("a", "b")
        merged = components(late).select(F.col("node").alias("m"), F.col("root").alias("r"))
        old = joined.join(merged, F.col("root") == F.col("m"), "full")
        joined = old.select(F.coalesce("node", "m").alias("node"), F.coalesce("r", "root").alias("root"))

    named = stored(classes.join(joined, F.col("rep") == F.col("node"), "left").select("digest", "least_id", F.coalesce("root", "rep").alias("root")), "near-named")
    return sets, named


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5, k: int = K, long_k: int = LONG_K, block: int = BLOCK, pilots: int = PILOTS) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept, text_hash, component_key.

    Documents link when 100 * intersection >= percent * union of their full
    shingle sets.  Null and empty texts, and texts without words, have empty
    sets and link with nothing, so such a row is its own component.  Ids may be
    of any ordered type; the id of a component is the least of its ids.  Rows
    that repeat an id are told apart by their texts; a component of null ids
    only has a null id, and its rows are kept.  ``text_hash`` (xxhash64 of the
    text, null as empty) leads back to the rows where ids repeat, and
    ``component_key`` is a component's own number, which its id is not then.
    """
    with scratch(docs.sparkSession) as keep:
        sets, named = map(keep, _components_of_sets(docs, id_col, text_col, percent, size, k, long_k, block, pilots))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    named = named.join(least, "root").select(F.col("digest").alias("d"), "component", "root")
    out = sets.select("key", "id", "n", "digest", "text_hash").join(named, F.when(F.col("n") > 0, F.col("digest")) == F.col("d"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash", F.coalesce("root", "key").alias("component_key"))
    kept = F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull())
    return out.select(id_col, "n_shingles", "component_id", kept.alias("kept"), "text_hash", "component_key")
