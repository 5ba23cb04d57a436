"""Token counts by a linear longest-match automaton.

Words are tokenised greedily: the longest vocabulary token that the rest of a
word begins with is taken, again and again.  A trie of the vocabulary gets
failure links and, for each node, the number of tokens that are popped when
its link is followed (LinMaxMatch, Song et al., 2021).  One pass over a word's
bytes then gives its number of tokens; no token is ever built.

A word is matched with a space before it, so that tokens that begin with a
space are the word-initial ones and the others continue.  The vocabulary must
hold every single byte.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import ship, text_or_empty, tidy, without_collection

#: Words whose counts a worker keeps; beyond it starts anew.
KEPT_WORDS = 500_000
#: Longer words are counted each time.
LONG = 64


class LongestMatch:
    """The automaton of a vocabulary: ``goto`` by node << 8 | byte, ``fail`` and ``pops`` by node; 0 is the root."""

    def __init__(self, tokens: Iterator[bytes]):
        self.goto: dict[int, int] = {}
        ends = {0: False}
        for token in tokens:
            node = 0
            for byte in token:
                node = self.goto.setdefault(node << 8 | byte, len(ends))
                ends.setdefault(node, False)
            ends[node] = node != 0
        if any(byte not in self.goto or not ends[self.goto[byte]] for byte in range(256)):
            raise ValueError("the vocabulary must hold every byte")
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.goto.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        self.fail, self.pops = [0] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children.get(parent, ()):
                queue.append(node)
                if ends[node]:  # the token itself is popped, and matching goes on at the root
                    self.fail[node], self.pops[node] = 0, 1
                else:
                    at, popped = self.fail[parent], self.pops[parent]
                    while (at << 8 | byte) not in self.goto:
                        popped += self.pops[at]
                        at = self.fail[at]
                    self.fail[node], self.pops[node] = self.goto[at << 8 | byte], popped
        self.kept: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """How many tokens the word has."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node = total = 0
        for byte in b" " + word:
            while (onward := goto.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
            node = onward
        while node:
            total += pops[node]
            node = fail[node]
        return total

    def counts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        out = []
        for text in texts:
            words = text.split()
            if len(self.kept) > KEPT_WORDS:
                self.kept = {}
            kept = self.kept
            new = set(words).difference(kept)
            kept.update((w, self.count(w)) for w in new)
            out.append((len(words), sum(map(kept.__getitem__, words))))
            for w in new:
                if len(w) > LONG:
                    del kept[w]
        return out


_loaded: dict[str, LongestMatch] = {}


def automaton(content: bytes) -> LongestMatch:
    """The worker's automaton for a vocabulary file's content."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded[key] = LongestMatch(iter(read_ranks(content)))
    return _loaded[key]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_tokens of the whole text.

    Words are runs without ASCII white space.  Null and empty texts have none.
    ``path`` is the vocabulary file, read by the driver and broadcast: its size
    does not depend on the data.  Repeated rows are counted each.
    """
    ship(docs.sparkSession)
    with open(path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(F.col(id_col), text_or_empty(text_col).cast("binary").alias("text"))
    id_type = source.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(content.value)
        for batch in batches:
            with without_collection():
                found = own.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], type=pa.int64()), pa.array([t for _, t in found], type=pa.int64())], names=[id_col, "n_words", "n_tokens"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, n_words long, n_tokens long")
