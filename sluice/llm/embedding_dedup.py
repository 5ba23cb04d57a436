"""Near-duplicate embeddings by NN-descent inside each label.

Vectors of one label (and one length) form a cell.  Several sorted orders of
random sign codes give every vector its first neighbours.  Rounds of
neighbours-of-neighbours joins then improve the lists: around each vector where
something changed its neighbours and reverse neighbours meet, all pairs among
them are measured, and the best ``k`` of each vector stay.  A list that is full of
links is saturated and gets ``GROWTH`` times the length, up to ``most_k``.  Rounds end when
none adds a link or lengthens a list.

Vectors whose longest lists are saturated are dense.  A link between a dense vector
and another one stands in the other's list.  Links among dense vectors are counted
in blocks, within each component of the dense vectors' known links; only counts and
spanning edges leave a block, so a dense group costs no row for each pair.

An audit compares samples of each cell, of vectors with known links and of vectors
without, with their whole cell.  A cell where more than ``1 - least_recall`` of
the links are missing by that is compared whole, in blocks, which is the exact way out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, ship, stored, tidy, whole_groups
from .graph import components

#: Sign bits of a code.
BITS = 40
_SALTS = 8
#: By how much a saturated list is enlarged.
GROWTH = 4
#: Vectors of a block.
BLOCK = 1024


def pack(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """key (of the row), id, label, dim, vec (little-endian bytes) of every row; label, dim and vec are null where it cannot link."""
    ship(vectors.sparkSession)
    v = F.col(vec_col)
    sound = F.col(label_col).isNotNull() & v.isNotNull()
    sound &= F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            there = lists.is_valid().to_pylist()
            packed = [values[a:b].tobytes() if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], there, strict=True)]
            dims = pa.array([b - a if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), there, strict=True)], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], dims, pa.array(packed, type=pa.binary())], names=["key", "id", "label", "dim", "vec"])

    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.when(sound, F.col(label_col).cast("string")).alias("label"), F.when(sound, v).alias("v"))
    return rows.mapInArrow(run, f"key long, id {vectors.schema[id_col].dataType.simpleString()}, label string, dim int, vec binary")


def _unit(vecs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), dtype=kind).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _triples(u: list, v: list, s: list) -> pa.RecordBatch:
    join = lambda x, t: pa.array(np.concatenate(x) if x else [], type=t)
    return pa.RecordBatch.from_arrays([join(u, pa.int64()), join(v, pa.int64()), join(s, pa.float64())], names=["u", "v", "sim"])


def first_neighbours(reps: DataFrame, kind: str, orders: range, window: int) -> DataFrame:
    """(u, v, sim) of vectors that stand near each other in an order of sign codes."""

    @tidy
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _unit(part.column(3).to_pylist(), kind)
                for t in orders:
                    planes = np.random.default_rng((t, dim)).standard_normal((dim, BITS))
                    code = ((x @ planes) > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, t, dtype=np.int32)), pa.array(code)], names=["id", "label", "dim", "vec", "t", "code"])

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 0, 3)), strict=True))
            u, v, s = [], [], []
            start = 0
            while start < len(rows):
                stop = start
                while stop < len(rows) and rows[stop][:3] == rows[start][:3]:
                    stop += 1
                x, ids = _unit([r[4] for r in rows[start:stop]], kind), np.array([r[3] for r in rows[start:stop]], dtype=np.int64)
                for d in range(1, min(window, stop - start - 1) + 1):
                    sim = (x[d:] * x[:-d]).sum(axis=1)
                    u += [ids[d:], ids[:-d]]
                    v += [ids[:-d], ids[d:]]
                    s += [sim, sim]
                start = stop
            held = rows[-window:]
            yield _triples(u, v, s)

    coded = reps.select("id", "label", "dim", "vec").mapInArrow(codes, "id long, label string, dim int, vec binary, t int, code long")
    ordered = coded.repartitionByRange("label", "dim", "t", "code", "id").sortWithinPartitions("label", "dim", "t", "code", "id")
    return ordered.mapInArrow(near, "u long, v long, sim double")


def best(triples: DataFrame) -> DataFrame:
    """(u, v, sim, fresh, k) -> (u, k, near): the k most similar of each u, as (down = -sim, v, fresh); known pairs are not fresh."""
    single = triples.where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
    lists = single.groupBy("u").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("down"), "v", "fresh"))).alias("near"), F.max("k").alias("k"))
    return lists.select("u", "k", F.slice("near", F.lit(1), F.col("k")).alias("near"))


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.select("u", "k", F.explode("near").alias("e")).select("u", "k", F.col("e.v").alias("v"), (-F.col("e.down")).alias("sim"), F.col("e.fresh").alias("fresh"))


def full(threshold: float) -> Column:
    """Whether all places of a list hold links."""
    return (F.size("near") >= F.col("k")) & (-F.element_at("near", -1)["down"] >= threshold)


def descend(graph: DataFrame, reps: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(u, v, sim) found by one neighbours-of-neighbours join around all that has a fresh edge; ``graph`` has u, k, near, longer."""
    edges = edges_of(graph)
    back = edges.select(F.col("v").alias("w"), F.col("u").alias("x"), "sim", F.col("k"))
    # the best reverse neighbours, first by salt, so that no hub gathers in one task
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("sim").desc(), F.xxhash64("w", "x")))
    back = back.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(_SALTS)))
    back = back.withColumn("r", rank("w", "salt")).where("r <= k").withColumn("r", rank("w")).where("r <= k")
    around = edges.select(F.col("u").alias("w"), F.col("v").alias("x")).unionByName(back.select("w", "x")).unionByName(graph.select(F.col("u").alias("w"), F.col("u").alias("x"))).distinct()
    changed = edges.where("fresh").select(F.explode(F.array("u", "v")).alias("w"))
    grown = edges_of(graph.where("longer")).select(F.explode(F.array("u", "v")).alias("w"))
    around = around.join(changed.unionByName(grown).distinct(), "w", "left_semi")
    # a list that was full of links and got longer has use for links only
    least = F.when(F.col("longer"), F.lit(np.nextafter(threshold, -1).item())).otherwise(F.lit(-2.0))
    worst = graph.select(F.col("u").alias("g"), F.when(F.size("near") >= F.col("k"), -F.element_at("near", -1)["down"]).otherwise(least).alias("worst"))
    held = reps.select("id", "vec").join(worst, F.col("id") == F.col("g"), "left").select("id", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    rows = around.join(held, F.col("x") == F.col("id")).select("w", "x", "vec", "worst").repartition("w").sortWithinPartitions("w")

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            w, ids, worst = (table.column(i).to_numpy() for i in (0, 1, 3))
            vecs = table.column(2).to_pylist()
            u, v, s = [], [], []
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(w)], strict=True):
                x = _unit(vecs[a:b], kind)
                sim = x @ x.T
                i, j = np.nonzero(np.triu(sim > np.minimum(worst[a:b, None], worst[None, a:b]), 1))
                i, j, found = i + a, j + a, sim[i, j]
                for p, q in ((i, j), (j, i)):
                    better = found > worst[p]
                    u.append(ids[p[better]])
                    v.append(ids[q[better]])
                    s.append(found[better])
            yield _triples(u, v, s)

    return rows.mapInArrow(meet, "u long, v long, sim double")


def neighbour_graph(reps: DataFrame, kind: str, threshold: float, k: int, most_k: int, orders: int, window: int, least_rounds: int = 2) -> DataFrame:
    """(u, k, near): the lists of all vectors, refined until a round adds no link and lengthens no list."""
    flagged = lambda t, fresh, k: t.withColumns({"fresh": F.lit(fresh), "k": F.lit(k)})
    graph = stored(best(flagged(first_neighbours(reps, kind, range(orders), window), True, k)), "nn-graph")
    for n in itertools.count(1):
        longer = full(threshold) & (F.col("k") < most_k)
        grown = graph.withColumn("longer", longer).withColumn("k", F.when(F.col("longer"), F.least(F.col("k") * GROWTH, F.lit(most_k))).otherwise(F.col("k")))
        known = edges_of(grown).select("u", "v", "sim", F.lit(False).alias("fresh"), "k")
        graph = stored(best(known.unionByName(flagged(descend(grown, reps, kind, threshold), True, 0).select("u", "v", "sim", "fresh", "k"))), "nn-graph")
        more = (full(threshold) & (F.col("k") < most_k)) | F.exists("near", lambda e: e["fresh"] & (-e["down"] >= threshold))
        if n >= least_rounds and graph.where(more).isEmpty():
            return graph


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a spanning forest of the links between rows and columns."""
    rows, columns = links.any(axis=1), np.ones(links.shape[1], dtype=bool)  # not reached yet
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while rows.any():
        front = np.array([int(rows.argmax())])
        rows[front] = False
        while len(front):
            new = np.flatnonzero(links[front].any(axis=0) & columns)
            if not len(new):
                break
            out.append((front[links[np.ix_(front, new)].argmax(axis=0)], new))
            columns[new] = False
            front = np.flatnonzero(links[:, new].any(axis=1) & rows)
            if len(front):
                out.append((front, new[links[np.ix_(front, new)].argmax(axis=1)]))
                rows[front] = False
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def block_links(left: DataFrame, right: DataFrame | None, kind: str, threshold: float) -> DataFrame:
    """The links of ``left`` with ``right`` (None: among themselves) of the same ``part``, compared in blocks.

    Both have part, id, vec, weight.  (kind, a, b, n, m): kind 0: vector a has m links in one block, of weight n; kind 1: a
    link (a, b) of a block's spanning forest.
    """
    hashed = lambda n: F.pmod(F.xxhash64(F.lit("block"), "id"), n).cast("int")
    blocks = lambda rows, name: rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    place = lambda i, j, side: F.struct((i.cast("long") * (1 << 31) + j).alias("unit"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    if right is None:
        rows = left.join(blocks(left, "own"), "part").withColumn("mine", hashed(F.col("own")))
        units = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: place(F.least("mine", j), F.greatest("mine", j), (F.col("mine") > j).cast("int")))
        placed = rows.select("part", F.explode(units).alias("u"), "id", "vec", "weight")
    else:
        counts = blocks(left, "own").join(blocks(right, "other"), "part")
        a, b = (rows.join(counts, "part").withColumn("mine", hashed(F.col(n))) for rows, n in ((left, "own"), (right, "other")))
        a = a.select("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("other") - 1), lambda j: place(F.col("mine"), j, 0))).alias("u"), "id", "vec", "weight")
        b = b.select("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: place(j, F.col("mine"), 1))).alias("u"), "id", "vec", "weight")
        placed = a.unionByName(b)
    rows = placed.select(F.xxhash64("part").alias("hash"), "u.unit", "part", "u.side", "id", "vec", "weight")
    rows = rows.repartition(partitions(rows.sparkSession), "part", "unit").sortWithinPartitions("hash", "unit", "part", "side")
    within = right is None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            hashes, units, side, ids, weight = (table.column(i).to_numpy() for i in (0, 1, 3, 4, 6))
            parts = np.array(table.column(2).to_pylist(), dtype=object)
            vecs = table.column(5)
            starts = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (units[1:] != units[:-1]) | (parts[1:] != parts[:-1]))).tolist()
            for a, c in zip(starts, [*starts[1:], len(ids)], strict=True):
                b = a + int(np.count_nonzero(side[a:c] == 0))
                if b == a or (b == c and not within):
                    continue
                x = _unit(vecs.slice(a, c - a).to_pylist(), kind)
                alone = within and b == c  # one block with itself
                left, right = (slice(0, b - a), slice(0, b - a)) if alone else (slice(0, b - a), slice(b - a, c - a))
                li, ri = ids[a:c][left], ids[a:c][right]
                links = (x[left] @ x[right].T >= threshold) & (li[:, None] != ri[None, :])
                i, j = _forest(links) if within else (np.empty(0, np.int64), np.empty(0, np.int64))
                sums = [(li, links @ weight[a:c][right], links.sum(axis=1))]
                if within and not alone:
                    sums.append((ri, links.T @ weight[a:c][left], links.sum(axis=0)))
                u = np.concatenate([s[0] for s in sums])
                kinds = np.concatenate((np.zeros(len(u)), np.ones(len(i)))).astype(np.int32)
                zero = np.zeros(len(i), dtype=np.int64)
                columns = (kinds, np.concatenate((u, li[i])), np.concatenate((u, ri[j])), np.concatenate([s[1] for s in sums] + [zero]), np.concatenate([s[2] for s in sums] + [zero]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "a", "b", "n", "m"])

    return rows.mapInArrow(run, "kind int, a long, b long, n long, m long").where("kind = 1 OR m > 0")


def sampled(reps: DataFrame, counts: DataFrame, audit: int, least_recall: float) -> DataFrame:
    """id, part, n (known links), size (of the stratum), known (links of the cell), taken.

    The strata of a cell are its vectors with known links and those without.  Of each, ``audit`` vectors or more are taken,
    growing with the stratum; of those without links so many that finding none bounds what all of them can miss (by the
    rule of three).  That is no use where a cell has no known link: there four times ``audit`` are taken.
    """
    rows = reps.select("id", "part").join(counts.withColumnRenamed("id", "u"), F.col("id") == F.col("u"), "left").select("id", "part", F.coalesce("m", F.lit(0)).alias("n"))
    cells = rows.groupBy("part").agg(F.count_if(F.col("n") > 0).alias("with"), F.count_if(F.col("n") == 0).alias("without"), F.sum("n").alias("known"))
    rows = rows.join(cells, "part").withColumn("size", F.when(F.col("n") > 0, F.col("with")).otherwise(F.col("without")))
    bound = F.when(F.col("known") > 0, F.col("size") * F.lit(6.0 / (1 - least_recall)) / F.col("known")).otherwise(F.lit(4.0 * audit))
    want = F.greatest(F.lit(float(audit)), F.sqrt("size") * 4, F.when(F.col("n") == 0, bound))
    taken = F.pmod(F.xxhash64(F.lit("audit"), "id"), F.col("size")) < want
    return rows.select("id", "part", "n", "size", "known", taken.alias("taken"))


def unsettled(sample: DataFrame, exact: DataFrame, least_recall: float) -> DataFrame:
    """part of the cells whose lists may know less than ``least_recall`` of the links."""
    true = exact.where("kind = 0").groupBy("a").agg(F.sum("m").alias("true"))
    rows = sample.where("taken").join(true, F.col("id") == F.col("a"), "left")
    lost, linked = F.greatest(F.lit(0), F.coalesce("true", F.lit(0)) - F.col("n")), F.col("n") > 0
    strata = rows.groupBy("part", linked.alias("linked")).agg(F.max("size").alias("size"), F.max("known").alias("known"), F.count(F.lit(1)).alias("s"), F.sum(lost).alias("lost"))
    # nothing is missing of a sample itself; three more may be where few are found and something is known
    doubt = F.when(F.col("linked") | (F.col("known") == 0), 0).otherwise(3)
    missing = F.col("lost") + F.when(F.col("s") < F.col("size"), (F.col("lost") + doubt) * (F.col("size") - F.col("s")) / F.col("s")).otherwise(0.0)
    cells = strata.groupBy("part").agg(F.sum(missing).alias("missing"), F.max("known").alias("known"))
    return cells.where(F.col("missing") * F.lit(least_recall) > F.col("known") * F.lit(1 - least_recall)).select("part")


def _linked(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, threshold: float, k: int, most_k: int, orders: int, window: int, audit: int, least_recall: float) -> tuple[DataFrame, DataFrame]:
    """The table of all rows' vectors, and (label, dim, vec, least_id, n_links, root) of the distinct ones."""
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    packed = stored(pack(vectors if element in ("float", "double") else vectors.withColumn(vec_col, F.col(vec_col).cast("array<double>")), id_col, vec_col, label_col), "nn-vectors")
    classes = packed.where("vec IS NOT NULL").groupBy("label", "dim", "vec").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least_id"))
    classes = stored(classes.withColumn("part", F.concat_ws(":", F.col("dim").cast("string"), "label")), "nn-classes")

    graph = neighbour_graph(classes, kind, threshold, k, most_k, orders, window)
    dense = graph.where(full(threshold)).select(F.col("u").alias("q"))
    links = edges_of(graph).where(F.col("sim") >= threshold).select("u", "v")
    links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    flag = dense.withColumn("dense", F.lit(True))
    links = links.join(flag.withColumnRenamed("q", "qu").withColumnRenamed("dense", "du"), F.col("u") == F.col("qu"), "left").join(flag, F.col("v") == F.col("q"), "left")
    links = stored(links.select("u", "v", (F.col("du").isNotNull() & F.col("dense").isNotNull()).alias("dense")), "nn-links")
    listed, among = links.where("NOT dense").select("u", "v"), links.where("dense").select(F.col("u").alias("a"), F.col("v").alias("b"))
    groups = components(among).select(F.col("node").alias("q"), F.col("root").cast("string").alias("part"))
    exact = stored(block_links(classes.drop("part").join(groups, F.col("id") == F.col("q")).select("part", "id", "vec", "weight"), None, kind, threshold), "nn-dense")

    # the audit, and the exact way out
    counts = listed.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("m")).unionByName(exact.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("m").alias("m"))).groupBy("id").agg(F.sum("m").alias("m"))
    sample = stored(sampled(classes, counts, audit, least_recall), "nn-sample")
    asked = classes.join(sample.where("taken").select("id"), "id", "left_semi").select("part", "id", "vec", "weight")
    poor = stored(unsettled(sample, block_links(asked, classes.select("part", "id", "vec", "weight"), kind, threshold), least_recall), "nn-poor")
    if not poor.isEmpty():
        cells = classes.join(poor, "part", "left_semi")
        gone = cells.select(F.col("id").alias("gone"))
        listed = listed.join(gone, F.col("u") == F.col("gone"), "left_anti")
        whole = block_links(cells.select("part", "id", "vec", "weight"), None, kind, threshold)
        exact = stored(exact.join(gone, F.col("a") == F.col("gone"), "left_anti").unionByName(whole), "nn-exact")

    weights = classes.select(F.col("id").alias("c"), "weight")
    sums = listed.join(weights, F.col("v") == F.col("c")).groupBy("u").agg(F.sum("weight").alias("n"))
    sums = sums.unionByName(exact.where("kind = 0").groupBy(F.col("a").alias("u")).agg(F.sum("n").alias("n"))).groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(listed.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(exact.where("kind = 1").select("a", "b")))
    found = classes.join(sums, F.col("id") == F.col("u"), "left").join(roots, F.col("id") == F.col("node"), "left")
    found = stored(found.select("label", "dim", "vec", "least_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "nn-found")
    return packed, found


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, k: int = 8, most_k: int = 32, orders: int = 8, window: int = 4, audit: int = 512, least_recall: float = 0.95) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    Vectors of equal labels link when their cosine, in double precision, is at
    least ``threshold``; vectors of different lengths do not.  Vectors that are
    null, zero or hold null or non-finite components, and those without a
    label, link with nothing and are their own components.  Equal vectors are one
    class: its members link with each other and share the rest.  Rows that repeat an id,
    or have none, are vectors of their own; a component's id is the least of its ids,
    null if it has none, and then all of it is kept.  An empty table gives no rows.
    """
    with scratch(vectors.sparkSession) as keep:
        packed, found = map(keep, _linked(vectors, id_col, vec_col, label_col, threshold, k, most_k, orders, window, audit, least_recall))
    least = found.groupBy("root").agg(F.min("least_id").alias("component"))
    found = found.join(least, "root").select("label", "dim", "vec", "n_links", "component")
    alone = packed.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = packed.where("vec IS NOT NULL").join(found, ["label", "dim", "vec"]).select("id", F.col("n_links").cast("long").alias("n_links"), "component").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"))
