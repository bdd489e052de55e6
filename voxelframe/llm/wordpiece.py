"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for the start of a word and one for the rest.
Every node carries a failure link (where matching goes on after the longest pieces of its
string are taken off) and the number of pieces popped on the way, so a word is counted in one
pass over its characters and no piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import slices
from voxelframe.llm.piece import PieceModel

#: Words that a worker remembers before it starts afresh.
CACHE_ENTRIES = 250_000
#: A word that the vocabulary can't spell is one unknown token.
UNKNOWN = -1


class Automaton:
    """``initial``: pieces that may start a word; ``inner``: pieces that may follow another."""

    START, INNER = 0, 1

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((self.START, initial), (self.INNER, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    below = self.children[node]
                    if c not in below:
                        below[c] = len(self.children)
                        self.children.append({})
                        final.append(False)
                    node = below[c]
                final[node] |= bool(piece)
        n = len(self.children)
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque([self.START, self.INNER])
        while queue:  # by depth, so that every link that is followed is already there
            node = queue.popleft()
            for c, child in self.children[node].items():
                if final[child]:
                    self.link[child], self.popped[child] = self.INNER, 1
                else:
                    at, pops = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.children[at]:
                        pops += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.children[at][c], pops
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of one word; ``UNKNOWN`` if it can't be spelt; 0 for the empty word."""
        node, n = self.START, 0
        children, link, popped = self.children, self.link, self.popped
        for c in word:
            while c not in children[node]:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return UNKNOWN
            node = children[node][c]
        while node not in (self.START, self.INNER):
            n += popped[node]
            node = link[node]
            if node < 0:
                return UNKNOWN
        return n


def from_pieces(model: PieceModel) -> Automaton:
    """The word pieces of a piece vocabulary: those marked as a word's start, and the others."""
    starts = [p[1:] for p in model.vocab if p.startswith("▁") and "▁" not in p[1:]]
    return Automaton([p for p in starts if p], [p for p in model.vocab if "▁" not in p])


class _Counter:
    held: tuple[int, _Counter] | None = None

    def __init__(self, blob: bytes):
        self.automaton, self.known = from_pieces(PieceModel(blob)), {}

    @classmethod
    def of(cls, blob: bytes) -> _Counter:
        key = hash(blob)
        if cls.held is None or cls.held[0] != key:
            cls.held = (key, cls(blob))
        return cls.held[1]

    def text(self, text: str) -> tuple[int, int, int]:
        words, known = text.split(), self.known
        try:
            counts = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            count = self.automaton.count
            for w in set(words):
                if w not in known:
                    known[w] = count(w)
            counts = list(map(known.__getitem__, words))
        unknown = counts.count(UNKNOWN)
        return len(words), sum(counts) + 2 * unknown, unknown


def token_counts(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Word-piece length of each whole text: ``n_words``, ``n_tokens``, ``n_unknown``.

    Words are parted by Unicode white space, case is kept. A word that can't be spelt is one
    unknown token. Null, empty and blank texts have no words. Repeated rows are kept.
    """
    blob = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_words long, n_tokens long, n_unknown long"

    def run(batches):
        counter = _Counter.of(blob.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                found = [counter.text(t or "") for t in part.column("__text").to_pylist()]
                columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + columns, [f.name for f in fields] + ["n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, schema)
