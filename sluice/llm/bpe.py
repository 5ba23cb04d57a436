"""Byte-level BPE encoding by merge replay, and decoding.

The distinct words of a block of the corpus are laid out as one row of byte
tokens.  An inverted index leads from the rank of a pair to the positions of
the words where the pair stands.  Ranks are replayed in order: a merge is applied
at all its positions in all words at once, and only the pairs with the two touched
neighbours are looked up and entered anew.

Words never interact, so replaying a corpus block by block gives the ids that
one replay over the whole corpus would; it spares moving every (word, document)
pair through a shuffle.  Words seen in earlier blocks of a worker are kept,
within a fixed number.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, tidy, without_collection

#: Characters of text in a block.
BLOCK_CHARS = 4_000_000
#: Entries that a worker keeps from block to block.
KEPT_WORDS = 100_000
#: Longer chunks are not remembered.
LONG = 64
# A space between white space and white space (or the end): where cutting before each space would not be exact.
_FAR = 2**30
_TORN = re.compile(r"\s (?:\s|\Z)")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class ByteBPE:
    """An encoder and decoder for one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.shift = max(ranks.values()).bit_length()
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.merged = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.name_array = np.array([self.names.get(r, "") for r in range(max(self.names) + 1)], dtype=object)
        #: ranks whose merge may give rise to an earlier one: its later positions in a word wait for that
        mask = (1 << self.shift) - 1
        self.early = {side for key, rank in self.pairs.items() for side in (key >> self.shift, key & mask) if rank < side}
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = ranks.get(bytes([a, b]), -1)
        self.words: dict[str, str] = {}
        self.chunks: dict[str, str] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << self.shift) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _FAR)

    def _overtaken(self, rank: int, at: np.ndarray, token: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Those of the positions ``at`` whose merge, in their order, gives rise to a pair of an earlier rank."""
        n, gone, back = len(token) - 1, after[at], before[at]
        onward = after[gone]
        right = np.where(onward < n, self._ranks_of(np.full(len(at), rank), token[onward]), _FAR)
        left = np.where(np.append(False, gone[:-1] == back[1:]), rank, token[np.minimum(back, n)])
        left = np.where(back < n, self._ranks_of(left, np.full(len(at), rank)), _FAR)
        return at[(right < rank) | (left < rank)]

    def replay(self, words: list[bytes]) -> list[str]:
        """The ids of each word, in decimal, joined by commas."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        n, sizes = len(flat), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not n:
            return [""] * len(words)
        stops = np.cumsum(sizes)
        token = np.append(self.single[flat], 0)  # position n stands for none
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[stops[sizes > 0] - 1], before[(stops - sizes)[sizes > 0]], after[n] = n, n, n
        pair = np.full(n + 1, _FAR, dtype=np.int64)  # the rank of the pair that begins at a position
        inner = np.flatnonzero(after[:n] < n)
        first = self.first[flat[inner], flat[inner + 1]]
        pair[inner] = np.where(first >= 0, first, _FAR)
        live = np.ones(n, dtype=bool)
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks < _FAR
            places, ranks = places[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])).tolist() if len(ranks) else []
            for rank, a, b in zip(ranks[np.array(starts, dtype=np.int64)].tolist(), starts, [*starts[1:], len(ranks)] if starts else [], strict=True):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heappush(waiting, rank)

        enter(inner, pair[inner])
        while waiting:
            rank = heappop(waiting)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[pair[at] == rank]  # neighbours' merges may have taken one of the two
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
                every = at
                overlaps = np.append(False, after[at[:-1]] == at[1:])
                if overlaps.any():  # of a run of overlapping pairs the first, third, ... merge
                    place = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(overlaps, 0, place))
                    at = at[(place - start) % 2 == 0]
                if rank in self.early and len(soon := self._overtaken(rank, at, token, after, before)):
                    # an earlier merge becomes possible there: what follows in these words has to wait for it
                    first = soon[np.append(True, word[soon[1:]] != word[soon[:-1]])]
                    of = np.searchsorted(word[first], word[every])
                    near = first[np.minimum(of, len(first) - 1)]
                    later = (word[near] == word[every]) & (every > near)
                    if later.any():
                        index[rank] = [every[later]]
                        heappush(waiting, rank)
                        at = at[~np.isin(at, every[later], assume_unique=True)]
            if not len(at):
                continue
            gone = after[at]
            onward = after[gone]
            token[at], pair[gone], live[gone] = rank, _FAR, False
            after[at], before[onward] = onward, at
            back = before[at]
            follows = onward < n
            new = np.where(follows, self._ranks_of(token[at], token[onward]), _FAR)
            pair[at] = new
            back = back[back < n]
            old = self._ranks_of(token[back], token[after[back]])
            pair[back] = old
            enter(np.concatenate((at, back)), np.concatenate((new, old)))
        live = np.flatnonzero(live)
        names = self.name_array[token[live]].tolist()
        ends = np.searchsorted(live, stops).tolist()
        return [",".join(names[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, words: set[str]) -> dict[str, str]:
        """Words -> ids, replaying those that are not kept."""
        new = list(words.difference(self.words))
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        whole = list(map(self.ranks.get, raw))  # words that are tokens as they stand
        parts = [i for i, r in enumerate(whole) if r is None]
        ids = [self.names.get(r) for r in whole]
        for i, found in zip(parts, self.replay([raw[i] for i in parts]), strict=True):
            ids[i] = found
        self.words.update(zip(new, ids, strict=True))
        return self.words

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text of a block, in decimal, joined by commas.

        Texts are cut before each space, which no word crosses unless white
        space stands on both sides; such texts are split as they are.
        """
        if len(self.words) > KEPT_WORDS or len(self.chunks) > KEPT_WORDS:
            self.words, self.chunks = {}, {}
        split, chunks = self.split, self.chunks
        torn = [_TORN.search(t) is not None for t in texts]
        fresh: set[str] = set()
        heads: set[str] = set()
        for text, slow in zip(texts, torn, strict=True):
            if slow:
                heads.add(text)
            else:
                parts = text.split(" ")
                heads.add(parts[0])
                fresh.update(parts[1:])
        fresh.difference_update(chunks)
        lead = {head: split(head) for head in heads}
        plain = [c for c in fresh if c.isalpha()]  # with its space one word
        mixed = [c for c in fresh if not c.isalpha()]
        spaced = [" " + c for c in plain]
        cut = [split(" " + c) for c in mixed]
        known = self._learn(set(chain(spaced, chain.from_iterable(cut), chain.from_iterable(lead.values()))))
        ids_of = known.__getitem__
        chunks.update(zip(plain, map(ids_of, spaced), strict=True))
        chunks.update(zip(mixed, (",".join(map(ids_of, words)) for words in cut), strict=True))
        out, chunk_ids = [], chunks.__getitem__
        for text, slow in zip(texts, torn, strict=True):
            if slow:
                out.append(",".join(map(ids_of, lead[text])))
            else:
                parts = text.split(" ")
                head = ",".join(map(ids_of, lead[parts[0]]))
                rest = ",".join(map(chunk_ids, parts[1:]))
                out.append(f"{head},{rest}" if head and rest else head or rest)
        for long in [c for c in fresh if len(c) > LONG]:
            del chunks[long]
        for long in [w for w in chain(spaced, *cut, *lead.values()) if len(w) > LONG]:
            self.words.pop(long, None)
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_loaded: dict[tuple[str, str], ByteBPE] = {}


def coder(content: bytes, pattern: str) -> ByteBPE:
    """The worker's encoder for a vocabulary file's content."""
    key = hashlib.sha256(content).hexdigest(), pattern
    if key not in _loaded:
        _loaded[key] = ByteBPE(read_ranks(content), pattern)
    return _loaded[key]


def blocks(sizes: list[int], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``sizes`` characters with about ``most`` of them each."""
    start = size = 0
    for i, own in enumerate(sizes):
        if size and size + own > most:
            yield start, i
            start, size = i, 0
        size += own
    if start < len(sizes):
        yield start, len(sizes)


Derive = Callable[[ByteBPE, str, str], object]


def with_tokens(docs: DataFrame, path: str, pattern: str, derive: dict[str, tuple[pa.DataType, str, Derive]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, and what ``derive`` makes of each text's ids.

    ``derive`` maps a column to its Arrow type, its SQL type and a function of
    (coder, text, ids).  ``path`` is the vocabulary file, read by the driver
    and broadcast: its size does not depend on the data.  Null texts are empty
    and have no ids.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    id_type = source.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(content.value, pattern)
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_pylist()
            for start, stop in blocks(sizes):
                with without_collection():
                    part = batch.column(1).slice(start, stop - start).to_pylist()
                    ids = bpe.encode(part)
                    columns = [pa.array([make(bpe, t, i) for t, i in zip(part, ids, strict=True)], type=kind) for kind, _, make in derive.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], names=[id_col, *derive])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"`{name}` {sql}" for name, (_, sql, _) in derive.items()))


def _count(bpe: ByteBPE, text: str, ids: str) -> int:
    return ids.count(",") + 1 if ids else 0


def _ids(bpe: ByteBPE, text: str, ids: str) -> list[int]:
    return [int(x) for x in ids.split(",")] if ids else []


def _ids_digest(bpe: ByteBPE, text: str, ids: str) -> str:
    return hashlib.sha256(ids.encode()).hexdigest()


def _decoded_digest(bpe: ByteBPE, text: str, ids: str) -> str:
    return hashlib.sha256(bpe.decode(ids)).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, **cols: str) -> DataFrame:
    """id, n_tokens and the token ids of every row."""
    return with_tokens(docs, path, pattern, {"n_tokens": (pa.int64(), "long", _count), "ids": (pa.list_(pa.int32()), "array<int>", _ids)}, **cols)


def token_digests(docs: DataFrame, path: str, pattern: str, **cols: str) -> DataFrame:
    """id, n_tokens, and the SHA-256 of the joined ids and of the decoded bytes, of every row."""
    kinds = {"n_tokens": (pa.int64(), "long", _count), "ids_sha256": (pa.string(), "string", _ids_digest), "decoded_sha256": (pa.string(), "string", _decoded_digest)}
    return with_tokens(docs, path, pattern, kinds, **cols)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of encoded documents; bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    ship(spark)
    with open(path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    source = encoded.select(id_col, ids_col)
    id_type = source.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in read_ranks(content.value).items()}
        for batch in batches:
            texts = [b"".join(map(bytes_of.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, text string")
