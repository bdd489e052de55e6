"""Subword lattice likelihood of texts.

A word's probability is the sum over all its segmentations into the pieces of an existing
vocabulary: a forward recursion in log space over the lattice of pieces, bytes included, so that
every word has a path. The first piece of a word is one of those that the vocabulary marks as a
word's start; together, start and inner pieces have probability one, which makes the
probabilities of all words sum to one. The vocabulary's own scores give the pieces' weights: in
the public file they are merge ranks, and by Zipf's law a weight falls as one over its rank. On
request, passes of expectation over the words seen in training move the weights from there, the
scores standing as ``PRIOR`` words' worth of pieces beside what training expects; each word counts
once, as each hands the same discount to the lattice.

A word seen in training is also one whole unit of the lattice: with discount D it has
(c - D) / N on top of the segmentations' share, D * types / N.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import crc_mod, slices, stored
from voxelframe.llm.piece import PieceModel

#: Words so frequent that their scores go to every task; all others meet theirs in a join.
HOT_WORDS = 150_000
#: Distinct words that a task counts before it hands them on.
FLUSH_WORDS = 300_000
#: Cells of one lattice chunk: words times bytes.
CELLS = 400_000
#: Words longer than this are gone through one by one, byte by byte, in memory of a few numbers a byte.
LONG_WORD = 1024
#: Pieces that the vocabulary's scores stand for besides those that training expects.
PRIOR = 2000.0
LOG10 = np.log(10.0)


class Lattice:
    """A trie of start and inner pieces over bytes, and the pieces' log probabilities."""

    START, INNER = 0, 1

    def __init__(self, model: PieceModel):
        pieces = [(p, i) for p, i in model.vocab.items()]
        starts = [(p[1:].encode(), i) for p, i in pieces if p.startswith("▁") and "▁" not in p[1:]]
        inner = [(p.encode(), i) for p, i in pieces if "▁" not in p] + [(bytes([b]), i) for b, i in model.byte_id.items()]
        step: dict[int, int] = {}
        ends: dict[int, list[int]] = {}
        nodes = 2
        for root, own in ((self.START, starts), (self.INNER, inner)):
            for text, i in own:
                node = root
                for b in text:
                    key = node * 257 + b
                    if key not in step:
                        step[key], nodes = nodes, nodes + 1
                    node = step[key]
                if text:
                    ends.setdefault(node, []).append(i)
        self.bare = model.vocab.get("▁", -1)  # a start that takes no byte
        # A one-byte piece and its byte fallback are two edges between the same places.
        self.piece = np.full((2, nodes), -1, dtype=np.int64)
        for node, own in ends.items():
            self.piece[: len(own), node] = own[:2]
        used = sorted({i for own in ends.values() for i in own} | ({self.bare} if self.bare >= 0 else set()))
        self.used = np.array(used, dtype=np.int64)
        bits = int(np.ceil(np.log2(len(step) * 4)))
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.next = np.zeros((1 << bits) + 64, dtype=np.int64)
        for key, node in step.items():
            s = int(self._slot(np.array([key]))[0])
            while self.keys[s] >= 0:
                s += 1
            self.keys[s], self.next[s] = key, node
        self.step, self.ends = step, ends
        # Bytes have no score of their own and come after all that have one.
        last = len(model.rank)
        weight = np.zeros(len(model.pieces))
        weight[self.used] = [1 / (model.rank.get(i, last) + 2.7) for i in used]
        self.by_score = weight / weight.sum()
        self.set_weights(weight)

    def set_weights(self, weight: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            self.log_p = np.log(weight / weight[self.used].sum())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        keys = node * 257 + byte
        slot = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
            slot[left] += 1
        return out

    def chunks(self, words: list[bytes]):
        """Runs of word numbers of like length."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(size, kind="stable")
        a = 0
        while a < len(order):
            b = a + 1
            long = size[order[a]] > LONG_WORD
            while b < len(order) and (b - a + 1) * (size[order[b]] + 1) <= CELLS and size[order[b]] <= size[order[a]] * 1.3 + 4 and (size[order[b]] > LONG_WORD) == long:
                b += 1
            yield order[a:b]
            a = b

    def forward(self, words: list[bytes], edges: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of each prefix's probability, the words' lengths, and their own log probabilities."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        width = int(size.max()) if len(size) else 0
        data = np.full((len(words), width), 256, dtype=np.int64)
        inside = np.arange(width) < size[:, None]
        data[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        alpha = np.full((width + 1, len(words)), -np.inf)
        if self.bare >= 0:
            alpha[0] = self.log_p[self.bare]

        def reach(root: int, i: int, before: np.ndarray | None) -> None:
            at = np.flatnonzero(size > i)
            node = np.full(len(at), root, dtype=np.int64)
            j = i
            while len(at):
                node = self.follow(node, data[at, j])
                at, node = at[node >= 0], node[node >= 0]
                j += 1
                for layer in self.piece:
                    piece = layer[node]
                    here = np.flatnonzero(piece >= 0)
                    if len(here):
                        rows, own = at[here], piece[here]
                        gain = self.log_p[own] if before is None else before[rows] + self.log_p[own]
                        alpha[j, rows] = np.logaddexp(alpha[j, rows], gain)
                        if edges is not None:
                            edges.append((i if before is not None else -1, j, rows, own))
                keep = size[at] > j
                at, node = at[keep], node[keep]

        reach(self.START, 0, None)
        for i in range(width):
            reach(self.INNER, i, alpha[i])
        return alpha, size, alpha[size, np.arange(len(words))]

    def long_word(self, word: bytes, total: np.ndarray | None = None, times: float = 1.0) -> float:
        """A word's log probability in plain steps; with ``total``, its expected pieces are added there."""
        size, step, ends, log_p = len(word), self.step.get, self.ends.get, self.log_p

        def edges(root: int, i: int):
            node = root
            for j in range(i, size):
                node = step(node * 257 + word[j])
                if node is None:
                    return
                for p in ends(node, ()):
                    yield j + 1, p, float(log_p[p])

        def add(a: float, b: float) -> float:
            return b if a == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))

        alpha = array("d", [-math.inf]) * (size + 1)
        if self.bare >= 0:
            alpha[0] = float(log_p[self.bare])
        for j, _, lp in edges(self.START, 0):
            alpha[j] = add(alpha[j], lp)
        for i in range(size):
            if alpha[i] > -math.inf:
                for j, _, lp in edges(self.INNER, i):
                    alpha[j] = add(alpha[j], alpha[i] + lp)
        whole = alpha[size]
        if total is not None and whole > -math.inf:
            beta = array("d", [-math.inf]) * (size + 1)
            beta[size] = 0.0
            for i in range(size - 1, -1, -1):
                for j, p, lp in edges(self.INNER, i):
                    if beta[j] > -math.inf:
                        beta[i] = add(beta[i], beta[j] + lp)
                        total[p] += math.exp(min(0.0, alpha[i] + beta[j] + lp - whole)) * times
            for j, p, lp in edges(self.START, 0):
                total[p] += math.exp(min(0.0, beta[j] + lp - whole)) * times
            if self.bare >= 0:
                total[self.bare] += math.exp(min(0.0, float(log_p[self.bare]) + beta[0] - whole)) * times
        return whole

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for own in self.chunks(words):
            if len(words[own[0]]) > LONG_WORD:
                out[own] = [self.long_word(words[k]) for k in own.tolist()]
            else:
                out[own] = self.forward([words[k] for k in own.tolist()])[2]
        return out

    def expected(self, words: list[bytes], count: np.ndarray) -> np.ndarray:
        """Expected pieces in the words, each word ``count`` times."""
        total = np.zeros(len(self.log_p))
        for own in self.chunks(words):
            if len(words[own[0]]) > LONG_WORD:
                for k in own.tolist():
                    self.long_word(words[k], total, float(count[k]))
                continue
            edges: list = []
            alpha, size, whole = self.forward([words[k] for k in own.tolist()], edges)
            times = count[own]
            beta = np.full_like(alpha, -np.inf)
            beta[size, np.arange(len(own))] = 0
            # An edge is used once all that follows its end is summed: by start, from the right.
            for i, j, rows, piece in sorted(edges, key=lambda e: -e[0]):
                after = beta[j, rows] + self.log_p[piece]
                if i >= 0:
                    share = alpha[i, rows] + after
                    beta[i, rows] = np.logaddexp(beta[i, rows], after)
                else:
                    share = after
                total += np.bincount(piece, np.exp(share - whole[rows]) * times[rows], len(total))
            if self.bare >= 0:
                total[self.bare] += (np.exp(self.log_p[self.bare] + beta[0] - whole) * times).sum()
        return total


class _Lattices:
    held: tuple[int, Lattice] | None = None

    @classmethod
    def of(cls, blob: bytes) -> Lattice:
        key = hash(blob)
        if cls.held is None or cls.held[0] != key:
            cls.held = (key, Lattice(PieceModel(blob)))
        return cls.held[1]


def split(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by space and U+0009 to U+000D."""
    return text.lower().split() if text else []


def _count(batches):
    """(word, c): words of training texts counted, words of held-out texts with none."""
    counts: Counter = Counter()
    other: set[bytes] = set()

    def flush():
        words = [*counts, *other.difference(counts)]
        c = list(counts.values())
        c += [0] * (len(words) - len(c))
        counts.clear()
        other.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64())], ["word", "c"])

    for batch in batches:
        for part in slices(batch):
            for text, held in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("held_out").to_pylist(), strict=True):
                if held:
                    other.update(split(text))
                else:
                    counts.update(split(text))
            if len(counts) + len(other) > FLUSH_WORDS:
                yield flush()
    if counts or other:
        yield flush()


def score(docs: DataFrame, model: bytes, refits: int = 0, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows whose crc32(doc_id) modulo 10 isn't 0 (a null doc_id learns too). Tokens are
    words and one end; null and empty texts have the end alone. ``score`` is the log10
    probability of the text: of its words, as above, and of its end, (c - D) / N like a word's.
    Every row is a text of its own, whatever its doc_id: repeated rows count, and are scored, as
    often as they come. With ``refits`` weights are those of so many passes of expectation, not the
    vocabulary's scores alone. ``hot_words`` changes only the way that scores reach texts, not
    what they are.
    """
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(model)  # some hundred KB
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "text")
    counted = docs.select("text", "held_out").mapInArrow(_count, "word binary, c long")
    words = stored(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = docs.filter(~F.col("held_out")).count()
    n, types = seen[0] + ends, seen[1] + (ends > 0)
    discount = min(0.9, max(0.1, seen[2] / max(1, seen[2] + 2 * seen[3])))
    share = discount * types / n if n else 1.0
    lattice = Lattice(PieceModel(model))
    weight = np.exp(lattice.log_p)
    for _ in range(refits if n else 0):
        given = spark.sparkContext.broadcast(weight)  # one number a piece

        def expect(batches, given=given):
            own = _Lattices.of(blob.value)
            own.set_weights(given.value)
            total = np.zeros(len(given.value))
            for batch in batches:
                for a in range(0, batch.num_rows, 50_000):
                    part = batch.slice(a, 50_000)
                    total += own.expected(part.column("word").to_pylist(), np.ones(part.num_rows))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

        found = words.filter("c > 0").select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        weight = lattice.by_score * PRIOR
        weight[found["piece"].to_numpy()] += found["n"].to_numpy()
        lattice.set_weights(weight)
    given = spark.sparkContext.broadcast(weight)
    # Without training the end is one more unit beside the pieces.
    end_p = (ends - discount) / n if ends else 1 / (len(lattice.used) + 1)

    def judge(batches):
        own = _Lattices.of(blob.value)
        own.set_weights(given.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 50_000):
                part = batch.slice(a, 50_000)
                sub = own.log_probability(part.column("word").to_pylist())
                c = part.column("c").to_numpy()
                with np.errstate(divide="ignore"):
                    whole = np.log(np.where(c > 0, c - discount, 0) / max(1, n))
                log_p = np.logaddexp(whole, sub + np.log(share if ends else 1 - end_p)) / LOG10
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("c"), pa.array(log_p)], ["word", "c", "log_p"])

    base = F.log10((F.col("c") + 0.1) / F.lit(float(n + 0.1 * (types + 1))))
    judged = stored(words.mapInArrow(judge, "word binary, c long, log_p double").withColumn("base", base), "judged")
    hot = judged.orderBy(F.desc("c"), "word").limit(hot_words).toArrow()  # hot_words bounds it
    hot = spark.sparkContext.broadcast(dict(zip(hot["word"].to_pylist(), zip((c > 0 for c in hot["c"].to_pylist()), hot["base"].to_pylist(), hot["log_p"].to_pylist(), strict=True), strict=True)))
    end = (1, int(ends > 0), float(np.log10((ends + 0.1) / (n + 0.1 * (types + 1)))), float(np.log10(end_p)))

    def spread(batches):
        """A row for each text with the sums of its end and hot words, and rows for its other words."""
        get = hot.value.get
        for batch in batches:
            for part in slices(batch):
                numbers = part.column("row").to_pylist()
                rows, words, times, head = [], [], [], []
                for number, text in zip(numbers, part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    own = Counter(split(text))
                    n, k, b, s = end
                    n += own.total()
                    for w, c in own.items():
                        hit = get(w)
                        if hit is None:
                            rows.append(number)
                            words.append(w)
                            times.append(c)
                        else:
                            k += c * hit[0]
                            b += c * hit[1]
                            s += c * hit[2]
                    head.append((n, k, b, s))
                tokens, known, base, log_p = zip(*head, strict=True)
                none, m = len(words), len(head)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers + rows, pa.int64()),
                        pa.concat_arrays([part.column("doc_id"), pa.nulls(none, pa.int64())]),
                        # No word holds a space, so a text's own row meets none.
                        pa.array([b" %d" % x for x in numbers] + words, pa.binary()),
                        pa.array([1] * m + times, pa.int32()),
                        *(pa.array([*x, *[None] * none], t) for x, t in ((tokens, pa.int64()), (known, pa.int64()), (base, pa.float64()), (log_p, pa.float64()))),
                    ],
                    ["row", "doc_id", "word", "times", "n_tokens", "n_known", "base", "log_p"],
                )

    # Texts are told apart by a number, which stands once it is written with what they hold.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = stored(numbered.mapInArrow(spread, "row long, doc_id long, word binary, times int, n_tokens long, n_known long, base double, log_p double"), "texts")
    # A text's own row has a key that is no word, so it passes the join by itself, like any other key.
    met = rows.join(judged.select("word", "c", F.col("base").alias("word_base"), F.col("log_p").alias("word_log_p")), "word", "left")
    one = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("word_base") * F.col("times"))).alias("base"),
        F.sum(F.coalesce("log_p", F.col("word_log_p") * F.col("times"))).alias("log_p"),
    )
    return one.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("log_p").alias("score"),
    )
