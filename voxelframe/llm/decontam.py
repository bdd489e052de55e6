"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are compared in a normal form: ASCII letters lower-cased, words parted by anything ASCII
that is no letter or digit, joined by single spaces, as UTF-8 bytes. A CGK random walk maps a
window of an item's size to a string whose Hamming distance to the item's own follows the edit
distance of the two. Windows are put into hash buckets by what their embeddings hold at sampled
positions, in repeats of several walks; the items of like length that share a bucket with a
window are compared with its neighbourhood by exact edit distance, bit-parallel.

Windows of every size at every byte are out of reach, so windows are laid where a document has
enough runs of bytes in common with an item on nearly one diagonal, the runs of the beginning
giving the window's. How long the runs are, how many are enough, and how many repeats are needed,
is found for items of like length on edited copies of the items at the least similarity, each
step being allowed to lose a third of what the recall allows: runs are the longest with which
enough copies have one. With as many edits as the least similarity allows, a run of four bytes is
always left, so the shortest runs lose nothing. Runs that most items of like length have, such as
those of a template, are left out where the rest is enough. Nothing caps the repeats but what they
are for: samples of fewer positions agree more often, and those of none leave all to the
verification.

Windows that begin close to one another are one window for all items of like length, and what the
buckets say of one text and item is joined to stretches, each of which is verified once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import slices, stored
from voxelframe.llm.wordarrays import PLAIN

#: Bytes of a run, and whether runs that more than half of like items have count: the first that is enough.
RUNS = ((8, False), (8, True), (7, True), (6, True), (5, True), (4, True))
#: Of fewer like items, no run is one that most have.
FEW_ITEMS = 8
#: Runs count together if their diagonals differ by no more than this.
DRIFT = 16
#: Windows for items of like length begin at least so many bytes apart, and differ in length as much.
STEP = 8
#: Random walks, and positions of one sample: the most that need no more repeats than this a walk.
WALKS = 6
SAMPLES = (6, 5, 4, 3, 2, 1)
REPEATS = 128
#: Items of like length have up to this ratio of sizes.
LIKE = 1.25
#: Items whose normal form is shorter than this are searched as they are, from word to word.
SHORT = 20
#: Bytes of items that are searched in one pass over the documents, about.
BLOCK_BYTES = 2 << 20
#: Windows embedded at once, as windows times bytes, and bytes of text looked at at once.
WINDOW_CELLS = 2 << 20
PIECE = 1 << 20
#: Edited copies that a class of items is tried on.
TRIALS = 150
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The normal forms of texts one after the other, each with a last space or none, and where they begin."""
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    data = PLAIN[raw]
    inside = data != 0
    begin = ends - ends[0]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    # The first byte of a text doesn't close a word of the text before.
    first = begin[:-1][begin[:-1] < len(data)]
    keep[first] = inside[first]
    at = np.concatenate([[0], np.cumsum(keep)])
    line = data[keep]
    line[line == 0] = 32
    return line, at[begin]


def normal(text: str) -> bytes:
    return lines(pa.array([text]))[0].tobytes().rstrip(b" ")


def grams(line: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of ``q`` bytes, of eight at most; different runs have different hashes."""
    n = len(line) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    line = np.concatenate([line, np.zeros(8 - q, np.uint8)]) if q < 8 else np.ascontiguousarray(line)
    word = np.ndarray((n,), np.dtype("<u8"), line.data, 0, (1,))
    return (word & np.uint64((1 << 8 * q) - 1) if q < 8 else word) * _MIX


def quads(text: bytes) -> np.ndarray:
    """A 16-bit hash of each run of four bytes."""
    if len(text) < 4:
        return np.empty(0, np.uint16)
    word = np.ndarray((len(text) - 3,), np.dtype("<u4"), text, 0, (1,))
    return ((word * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def best_match(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of ``item`` to any part of ``text``, and where that part ends.

    Myers' bit-vector recurrence on one integer of the item's length.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if score < best:
            best, end = score, at
    return best, end


class Walks:
    """CGK random walks. At each step the byte stood on is written out, and a random bit of step and
    byte says whether to move on: the top bit of the product of the byte's and the step's number."""

    def __init__(self, length: int, rng: np.random.Generator):
        number = lambda *n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.by_byte, self.by_step = number(WALKS, 256), number(WALKS, length)
        self.by_byte[:, 0] = 0  # the end stays where it is

    def embed(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """(position, walk, text): embeddings to the texts' lengths, which must fall; beyond them is nothing."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        out = np.zeros((int(lengths[0]), WALKS, len(texts)), dtype=np.uint8)
        table, row = self.by_byte.ravel(), np.arange(WALKS)[:, None] * 256
        at, stop, top = np.tile(begin, (WALKS, 1)), begin + size, np.uint64(63)
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")
        for j, n in enumerate(active.tolist()):
            if n < at.shape[1]:
                at = at[:, :n]
            c = flat[at]
            out[j, :, :n] = c
            at = np.minimum(at + ((table[c + row] * self.by_step[:, j, None]) >> top).astype(np.int64), stop[:n])
        return out


def edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """A copy with so many random bytes replaced, dropped or put in."""
    out = bytearray(text)
    for _ in range(edits):
        at, kind = int(rng.integers(0, max(1, len(out)))), int(rng.integers(0, 3))
        if kind == 0:
            out[at : at + 1] = b"%c" % int(rng.integers(97, 123))
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, int(rng.integers(97, 123)))
    return bytes(out)


class Like:
    """Items of like length: the samples that put them, and windows of their size, into buckets."""

    def __init__(self, texts: list[bytes], walks: Walks):
        self.texts, self.walks = texts, walks
        self.width = max(map(len, texts))
        self.length = int(1.5 * min(map(len, texts))) + 1

    def embedded(self, texts: list[bytes]) -> np.ndarray:
        return self.walks.embed(texts, np.full(len(texts), self.length))

    def choose(self, equal: np.ndarray, recall: float, rng: np.random.Generator) -> None:
        """Sample size and repeats, from the share of equal positions of each copy and walk; then the buckets."""
        self.sample, self.repeats = 0, 1

        def found(sample: int, repeats: int) -> float:
            """The mean chance that a copy shares two buckets."""
            p = np.minimum(equal**sample, 1 - 1e-9)
            none = np.prod((1 - p) ** repeats, axis=1)
            return 1 - (none * (1 + (repeats * p / (1 - p)).sum(axis=1))).mean()

        for sample in SAMPLES if len(equal) else ():
            if found(sample, REPEATS) >= recall:
                self.sample = sample
                self.repeats = next(r for r in range(1, REPEATS + 1) if found(sample, r) >= recall)
                break
        self.positions = rng.integers(0, self.length, (WALKS, self.repeats, self.sample))
        own = [self.keys(self.embedded(self.texts[a : a + 4096])) for a in range(0, len(self.texts), 4096)]
        key = np.concatenate(own, axis=1).reshape(-1)
        item = np.tile(np.arange(len(self.texts)), WALKS * self.repeats)
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(key * _MIX) >> np.uint64(64 - _BITS)] = True

    def keys(self, whole: np.ndarray) -> np.ndarray:
        """(walk and repeat, text): the buckets that embedded texts fall into."""
        n = whole.shape[2]
        out = np.empty((WALKS * self.repeats, n), dtype=np.uint64)
        for w in range(WALKS):
            h = np.broadcast_to(np.arange(w * self.repeats + 1, (w + 1) * self.repeats + 1, dtype=np.uint64)[:, None], (self.repeats, n))
            for s in range(self.sample):
                h = h * np.uint64(257) + whole[self.positions[w, :, s], w]
                h = h ^ (h << np.uint64(40))
            out[w * self.repeats : (w + 1) * self.repeats] = h
        return out

    def candidates(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an embedded window and an item that share two buckets: unrelated ones often share one."""
        key, n = self.keys(whole), whole.shape[2]
        maybe = np.flatnonzero(self.filter[(key * _MIX) >> np.uint64(64 - _BITS)])
        window, key = maybe % n, key.ravel()[maybe]
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        pair, times = np.unique(np.repeat(window, n) * len(self.texts) + self.item[at], return_counts=True)
        pair = pair[times > 1]
        return pair // len(self.texts), pair % len(self.texts)


class Runs:
    """The runs of one length of some items."""

    def __init__(self, q: int, own: list[tuple[int, np.ndarray, np.ndarray]]):
        self.q = q
        gram = np.concatenate([np.empty(0, np.uint64), *(h for _, h, _ in own)])
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.item = np.repeat([k for k, _, _ in own], [len(h) for _, h, _ in own]).astype(np.int64)[order]
        self.at = np.concatenate([np.empty(0, np.int64), *(at for _, _, at in own)])[order]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[gram >> np.uint64(64 - _BITS)] = True

    def hits(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items that have a run of the line, where in them it begins, and where in the line."""
        h = grams(line, self.q)
        maybe = np.flatnonzero(self.filter[h >> np.uint64(64 - _BITS)])
        h = h[maybe]
        lo = np.searchsorted(self.gram, h, "left")
        there = np.flatnonzero(self.gram[np.minimum(lo, len(self.gram) - 1)] == h) if len(self.gram) else lo[:0]
        maybe, lo = maybe[there], lo[there]
        n = np.searchsorted(self.gram, h[there], "right") - lo
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        return self.item[which], self.at[which], np.repeat(maybe, n)


class Index:
    """One block of items: their runs of bytes, and buckets for each class of like length."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, recall: float, seed: int = 20):
        by_text: dict[bytes, list[int]] = {}
        for i, text in items:
            by_text.setdefault(text, []).append(i)
        texts = sorted((t for t in by_text if t), key=lambda t: (len(t), t))
        self.texts, self.ids, self.similarity = texts, [by_text[t] for t in texts], similarity
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.shorts = int(np.searchsorted(self.size, SHORT))
        self.short = self._words()
        rng = np.random.default_rng(seed)
        # An edit changes four runs of four bytes at most: fewer left than this, and an item is too far.
        self.quads = [quads(t) for t in texts]
        self.kept = self.size - 3 - 4 * self._edits(np.arange(len(texts)))
        self.least = np.ones(len(texts), dtype=np.int64)
        self.likes: list[tuple[int, Like]] = []
        self.like = np.zeros(len(texts), dtype=np.int64)
        walks = self.walks = Walks(int(1.5 * self.size[-1]) + 1 if len(texts) > self.shorts else 0, rng)
        runs: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        a = self.shorts
        while a < len(texts):
            b = int(np.searchsorted(self.size, self.size[a] * LIKE, "right"))
            self.like[a:b] = len(self.likes)
            self.likes.append((a, Like(texts[a:b], walks)))
            q, own = self._try(a, b, 1 - (1 - recall) / 3, rng)
            runs.setdefault(q, []).extend((k, h, at) for k, (h, at) in enumerate(own, a))
            a = b
        self.tables = [Runs(q, own) for q, own in runs.items()]

    def _edits(self, item):
        """The most edits that an item may be away."""
        return ((1 - self.similarity) * self.size[item] + 1e-9).astype(np.int64)

    def _words(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Short items by the number of bytes that they are looked up by: hashes and items."""
        out: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts[: self.shorts]):
            out.setdefault(min(8, len(t)), []).append((int.from_bytes(t[:8].ljust(8, b"\0"), "little"), k))
        return {n: (np.array([h for h, _ in sorted(own)], np.uint64), np.array([k for _, k in sorted(own)])) for n, own in out.items()}

    def _try(self, a: int, b: int, recall: float, rng: np.random.Generator) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        """Which runs, how many of them make a window, and how many repeats find its item, on edited copies of items a to b.

        Returns the length of the runs and each item's runs that count, with their places.
        """
        own = self.likes[-1][1]
        trial = rng.integers(a, b, min(TRIALS, max(4, 200_000 // own.width)))
        copies = [edited(self.texts[k], int(self._edits(k)), rng) for k in trial.tolist()]
        flat = lambda t: np.frombuffer(t, np.uint8)
        for q, common in RUNS:
            held = [grams(flat(t), q) for t in self.texts[a:b]]
            if not common and b - a >= FEW_ITEMS:
                gram, items = np.unique(np.concatenate([np.unique(h) for h in held]), return_counts=True)
                most_have = gram[2 * items > b - a]
                keep = [~np.isin(h, most_have) for h in held]
            else:
                keep = [np.ones(len(h), dtype=bool) for h in held]
            runs = [(h[k], np.flatnonzero(k)) for h, k in zip(held, keep, strict=True)]
            # Each copy stands by itself: what is about it in a document can only add runs.
            most, start = np.zeros(len(trial), dtype=np.int64), np.zeros(len(trial), dtype=np.int64)
            for n, (k, copy) in enumerate(zip(trial.tolist(), copies, strict=True)):
                h, at = runs[k - a]
                order = np.argsort(h, kind="stable")
                h, at, there = h[order], at[order], grams(flat(copy), q)
                lo, hi = np.searchsorted(h, there, "left"), np.searchsorted(h, there, "right")
                count = hi - lo
                which = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else lo
                if not len(which):
                    continue
                diagonal, at = np.repeat(np.arange(len(there)), count) - at[which], at[which]
                d = np.sort(diagonal)
                size = np.searchsorted(d, d + DRIFT, "right") - np.arange(len(d))
                most[n] = size.max()
                near = np.flatnonzero((diagonal >= d[size.argmax()]) & (diagonal <= d[size.argmax()] + DRIFT))
                start[n] = diagonal[near[np.argmin(at[near])]]
            least = int(np.quantile(most, 1 - recall, method="lower"))
            if least:
                break
        # What the shortest runs may still miss is for the repeats to make up, as far as they can.
        self.least[a:b] = max(1, least)
        missed = float((most < self.least[a]).mean())
        windows, of = [], []
        for n in np.flatnonzero(most >= self.least[a]).tolist():
            first = max(0, int(start[n]))
            windows.append(copies[n][first : int(start[n]) + len(self.texts[trial[n]])])
            of.append(int(trial[n]) - a)
        equal = np.empty((0, WALKS))
        if windows:
            mine, theirs = own.embedded([own.texts[k] for k in of]), own.embedded(windows)
            equal = (mine == theirs).mean(axis=0).T
        own.choose(equal, min(1.0, recall + max(0.0, missed - (1 - recall))), rng)
        return q, runs

    def _hits(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Items that have a run of the line, where in them it begins, where in the line it begins and ends."""
        found = [(*table.hits(line), table.q) for table in self.tables]
        join = lambda k: np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)])
        pos = join(2)
        return join(0), join(1), pos, pos + np.repeat([f[3] for f in found], [len(f[0]) for f in found]).astype(np.int64)

    def _windows(self, line: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(item, start, text) of the windows that have enough runs of an item; starts may lie outside the text.

        Of windows for like items that begin and end close to one another there is one.
        """
        item, at, pos, end = self._hits(line)
        text = np.searchsorted(begins, pos, "right") - 1
        inside = end <= begins[text + 1]
        item, at, pos, text = item[inside], at[inside], pos[inside], text[inside]
        if not len(item):
            return np.empty((0, 3), dtype=np.int64)
        # Texts of one slice lie on one line, and a diagonal of one is far from most of the next's.
        key = (item << 40) + (pos - at) + (1 << 38)
        order = np.argsort(key)
        key, item, at, pos, text = key[order], item[order], at[order], pos[order], text[order]
        ahead = np.arange(len(key)) + self.least[item] - 1
        enough = np.flatnonzero((ahead < len(key)) & (key[np.minimum(ahead, len(key) - 1)] - key <= DRIFT))
        if not len(enough):
            return np.empty((0, 3), dtype=np.int64)
        held = np.zeros(len(key) + 1, dtype=np.int64)
        np.add.at(held, enough, 1)
        np.add.at(held, ahead[enough] + 1, -1)
        mine = np.flatnonzero(np.cumsum(held[:-1]) > 0)
        item, at, pos, text = item[mine], at[mine], pos[mine], text[mine]
        place = np.stack([self.like[item], text, (pos - at) // STEP, self.size[item] // STEP])
        order = np.lexsort((at, *place[::-1]))
        place = place[:, order]
        first = np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)]
        pick = order[first]
        return np.column_stack([item[pick], (pos - at)[pick], text[pick]])

    def _short_hits(self, line: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, end) of short items that stand in a text from word to word; one place of each."""
        padded = np.concatenate([line, np.zeros(32, np.uint8)])
        g = np.ndarray((len(line) + 24,), np.dtype("<u8"), padded.data, 0, (1,))
        at_begin = np.zeros(len(line) + 1, dtype=bool)
        at_begin[begins] = True
        start = np.flatnonzero((line != 32) & (at_begin[:-1] | np.concatenate([[True], line[:-1] == 32])))
        text = np.searchsorted(begins, start, "right") - 1
        for n, (key, items) in self.short.items():
            head = g[start] & np.uint64((1 << 8 * n) - 1 if n < 8 else (1 << 64) - 1)
            lo, hi = np.searchsorted(key, head, "left"), np.searchsorted(key, head, "right")
            count = hi - lo
            own = np.flatnonzero(count)
            if not len(own):
                continue
            count, lo = count[own], lo[own]
            item = items[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            p, t = np.repeat(start[own], count), np.repeat(text[own], count)
            size = self.size[item]
            end = p + size
            good = (end <= begins[t + 1]) & ((end == begins[t + 1]) | (padded[end] == 32))
            if n == 8:  # two more looks cover what is beyond the first eight bytes
                for skip in (size - 8, (size - 8) // 2):
                    want = np.array([int.from_bytes(self.texts[i][s : s + 8], "little") for i, s in zip(item.tolist(), skip.tolist(), strict=True)], np.uint64)
                    good &= g[p + skip] == want
            pair = np.column_stack([t, item, end - begins[t]])[good]
            _, first = np.unique(pair[:, 0] * len(self.texts) + pair[:, 1], return_index=True)
            yield from map(tuple, pair[first].tolist())

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end) for every text and item found in it, the best place of each."""
        line, begins = lines(column)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if self.short:
            for t, i, end in self._short_hits(line, begins):
                best[t, i] = 0, end
        if self.likes:
            wide = int(self.size[-1])
            step = max(PIECE, 4 * wide)
            for a in range(0, max(1, len(line)), step):
                part = line[a : a + step + 2 * wide]
                self._verify(line, begins, self._windows(part, np.clip(begins - a, 0, len(part))) + [0, a, 0], best)
        for (t, i), (distance, end) in best.items():
            yield t, i, distance, end

    def _verify(self, line: np.ndarray, begins: np.ndarray, windows: np.ndarray, best: dict) -> None:
        """Embed windows, meet items in buckets, and keep the best place of each item that is near enough."""
        windows = windows[np.argsort(-windows[:, 0], kind="stable")]  # long items come first
        length = np.array([like.length for _, like in self.likes], dtype=np.int64)[self.like[windows[:, 0]]]
        met = [np.empty((0, 4), dtype=np.int64)]  # text, item, and where it may be
        a = 0
        while a < len(windows):
            b = min(len(windows), a + max(1, WINDOW_CELLS // int(length[a])))
            part, like_of = windows[a:b], self.like[windows[a:b, 0]]
            floor, ceiling = begins[part[:, 2]], begins[part[:, 2] + 1]
            start = np.maximum(part[:, 1], floor)
            stop = np.minimum(part[:, 1] + self.size[part[:, 0]], ceiling)
            whole = self.walks.embed([line[x:y].tobytes() for x, y in zip(start.tolist(), stop.tolist(), strict=True)], length[a:b])
            for number in np.unique(like_of).tolist():
                offset, like = self.likes[number]
                own = np.flatnonzero(like_of == number)
                window, k = like.candidates(whole[: like.length, :, own])
                window, item = own[window], offset + k
                reach = self._edits(item) + STEP
                low = np.maximum(floor[window], start[window] - reach)
                high = np.minimum(ceiling[window], start[window] + self.size[item] + reach)
                met.append(np.column_stack([part[window, 2], item, low, high]))
            a = b
        pair = np.concatenate(met)
        if not len(pair):
            return
        pair = pair[np.lexsort((pair[:, 2], pair[:, 1], pair[:, 0]))]
        # Places of one text and item that touch are one stretch: each begins where none before reaches.
        group = np.cumsum(np.r_[True, (pair[1:, :2] != pair[:-1, :2]).any(axis=1)])
        far = np.maximum.accumulate(pair[:, 3] + (group << 40)) - (group << 40)
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (pair[1:, 2] > far[:-1])])
        there, marked = np.zeros(1 << 16, dtype=bool), None
        for k, last in zip(first.tolist(), np.r_[first[1:], len(pair)].tolist(), strict=True):
            t, i, low, high = int(pair[k, 0]), int(pair[k, 1]), int(pair[k, 2]), int(far[last - 1])
            if best.get((t, i), (1, 0))[0] == 0:
                continue
            if marked is None or marked[0] != (low, high):
                if marked is not None:
                    there[marked[1]] = False
                marked = (low, high), quads(line[low:high].tobytes())
                there[marked[1]] = True
            if np.count_nonzero(there[self.quads[i]]) < self.kept[i]:
                continue
            most = int(self._edits(i))
            distance, end = best_match(self.texts[i], line[low:high].tobytes())
            if distance <= most and distance < best.get((t, i), (most + 1, 0))[0]:
                best[t, i] = distance, low + end - int(begins[t])


SCHEMA = "doc_id long, item_id long, distance long, similarity double, end long"


def _normalised(batches):
    for batch in batches:
        line, begins = lines(batch.column("text"))
        texts = [line[a:b].tobytes().rstrip(b" ") for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(texts, pa.binary())], ["item_id", "item"])


def blocks(benchmark: DataFrame) -> Iterator[pd.DataFrame]:
    """The items in normal form, in blocks of about BLOCK_BYTES; an item beyond that may stand alone."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_normalised, "item_id long, item binary")
    items = stored(items.filter(F.octet_length("item") > 0), "items")
    n = -(-(items.agg(F.sum(F.octet_length("item"))).first()[0] or 0) // BLOCK_BYTES)
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item", "item_id"), F.lit(n)) == k).toPandas()
        if len(own):
            yield own.sort_values(["item_id", "item"], key=lambda c: c if c.name == "item_id" else c.map(bytes))


class _Built:
    """The index that a worker made last: its next task of the same block takes it."""

    held: tuple[str, Index | None] = ("", None)


def _indexes(benchmark: DataFrame, similarity: float, recall: float):
    """For each block of items, what gives a worker its index."""
    for own in blocks(benchmark):
        items = [(None if pd.isna(i) else int(i), bytes(t)) for i, t in zip(own["item_id"], own["item"], strict=True)]
        held = benchmark.sparkSession.sparkContext.broadcast(items)  # about BLOCK_BYTES, or one item
        mark = uuid.uuid4().hex

        def index(held=held, mark=mark) -> Index:
            if _Built.held[0] != mark:
                _Built.held = (mark, Index(held.value, similarity, recall))
            return _Built.held[1]

        yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One row per document row and benchmark item found in it.

    ``distance``: the edit distance of the item to the part of the document nearest to it, at
    most ``1 - similarity`` of the item's bytes; ``end``: where that part ends in the document's
    normal form. ``recall`` is what is aimed at for passages of the least similarity; more alike
    ones are found more surely. Items of under ``SHORT`` bytes of normal form are found as they
    are only, from word to word. Items of no letters or digits, null and empty ones say nothing;
    null and empty documents hold nothing. Items of equal text are each reported, and so are
    repeated documents. The benchmark is read block by block, so its size isn't bounded by
    memory; each block is one more pass over the documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index_of in _indexes(benchmark, similarity, recall):

        def run(batches, index_of=index_of):
            index = index_of()
            for batch in batches:
                for part in slices(batch):
                    found = [(t, i, d, 1 - d / len(index.texts[k]), end) for t, k, d, end in index.search(part.column("text")) for i in index.ids[k]]
                    text, item, distance, similar, end = zip(*found, strict=True) if found else [()] * 5
                    columns = [pa.array(x, t) for x, t in ((item, pa.int64()), (distance, pa.int64()), (similar, pa.float64()), (end, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text, pa.int64())), *columns], ["doc_id", "item_id", "distance", "similarity", "end"])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their doc_ids."""
    for index_of in _indexes(benchmark, similarity, recall):

        def run(batches, index_of=index_of):
            index = index_of()
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[t for t, _, _, _ in index.search(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
