"""Toxicity by class-conditional Kneser-Ney models.

Words are scored character by character, within the word, by two models of one order: one of
toxic and one of ordinary texts. Their highest order has counts of its own class; below it both
back off to the same continuation counts, taken from the two classes together, so an expression
that neither class knows well is judged alike by both and adds nothing.

Toxic texts are ordinary ones but for a few words, so a word of a toxic text comes from the toxic
model with a small chance and from the ordinary one else. A text is judged by the difference of
its two log-likelihoods under this mixture and the ordinary model, normalised by its number of
words: nothing else enters the score. The chance, and the two coefficients that turn the
difference into a probability, are fitted on texts that the models haven't seen.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import crc_mod, slices, stored

ORDER = 5
DISCOUNT = 0.75
#: At most so many labelled rows are learned from: those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Distinct grams that are learned from, at most: what the driver and every task hold. Where the rows have more,
#: fewer rows are learned from, again those with the smallest hash of doc_id.
MOST_GRAMS = 2_000_000
#: Tenths of the learning rows for the language models; the rest fits the coefficients.
MODEL_TENTHS = 7
#: Chances that are tried for a word of a toxic text to come from the toxic model.
CHANCES = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001, 0.0003)
CACHE_ENTRIES = 200_000
_WORDS = re.compile(r"[^\W\d_]+")
_PAD = "\x02" * (ORDER - 1)
_END = "\x03"


def kneser_ney(counts: pd.DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log ratios p_toxic / p_ordinary from gram counts (``gram``, ``toxic``, ``ordinary``).

    The first mapping has the ratio of each gram seen, the second that of a context before any
    character not seen after it. There, both models are the shared backoff times a weight, and
    the shared part cancels.
    """
    if counts.empty:
        return {}, {}
    grams = counts.set_index("gram")
    lower = pd.Series(1.0, index=grams.index)  # every gram is one continuation of its suffix
    shared = None
    # From single characters up: continuation counts of length k are the types that end in it.
    by_length = {}
    types = lower
    for k in range(ORDER - 1, 0, -1):
        types = types.groupby(types.index.str[1:]).size() if k < ORDER - 1 else types.groupby(types.index.str[1:]).sum()
        by_length[k] = types.astype(float)
    for k in range(1, ORDER):
        c = by_length[k]
        context = c.index.str[:-1]
        total = c.groupby(context).transform("sum")
        kinds = c.groupby(context).transform("size")
        below = 1.0 / max(1, len(by_length[1])) if shared is None else shared.reindex(c.index.str[1:]).to_numpy()
        shared = ((c - DISCOUNT).clip(lower=0) + DISCOUNT * kinds * below) / total
    back = shared.reindex(grams.index.str[1:]).to_numpy()
    context = grams.index.str[:-1]
    log_p, log_w = [], []
    for name in ("toxic", "ordinary"):
        n = grams[name].astype(float)
        by = n.groupby(context)
        total = by.transform("sum").to_numpy()
        kinds = (n > 0).groupby(context).transform("sum").to_numpy()
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.where(total > 0, np.maximum(n.to_numpy() - DISCOUNT, 0) / np.maximum(total, 1), 0.0)
        log_p.append(np.log(own + weight * back))
        log_w.append(np.log(weight))
    seen = dict(zip(grams.index, (log_p[0] - log_p[1]).tolist(), strict=True))
    rest = dict(zip(context, (log_w[0] - log_w[1]).tolist(), strict=True))
    return seen, rest


def words(text: str) -> list[str]:
    """The runs of letters of a text, in small letters: what both learning and scoring see of it."""
    return _WORDS.findall(text.lower())


class ToxicityModel:
    """Log ratios of grams, the chance of a toxic word, and the coefficients of the normalised difference."""

    def __init__(self, seen: dict[str, float], rest: dict[str, float], chance: float = CHANCES[0], weights: tuple[float, float] = (0.0, 0.0)):
        self.seen, self.rest, self.chance, self.weights = seen, rest, chance, weights
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.seen, self.rest, self.chance, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def ratio(self, word: str) -> float:
        """log p_toxic - log p_ordinary of a word and its end."""
        text, seen, rest, total = _PAD + word + _END, self.seen.get, self.rest.get, 0.0
        for k in range(len(word) + 1):
            gram = text[k : k + ORDER]
            r = seen(gram)
            total += rest(gram[:-1], 0.0) if r is None else r
        return total

    def word(self, word: str) -> float:
        """The difference of a word's log-likelihoods under the mixture and the ordinary model."""
        return mixture(self.ratio(word), self.chance)

    def difference(self, text: str) -> float:
        """The difference of the text's log-likelihoods, normalised by its number of words; 0 without words."""
        count, known = Counter(words(text)), self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in count:
            if w not in known:
                known[w] = self.word(w)
        return math.fsum(map(operator.mul, map(known.__getitem__, count), count.values())) / max(1, count.total())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.difference(t or "") for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] * x + self.weights[1], -50, 50)))


def mixture(ratio: float, chance: float) -> float:
    """log(1 - chance + chance * exp(ratio))"""
    own, other = math.log(chance) + ratio, math.log1p(-chance)
    return max(own, other) + math.log1p(math.exp(-abs(own - other)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the constant isn't shrunk."""
    if not len(y):
        return (0.0, -1.0)
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    scale[-1] = 1
    x = x / scale
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - shrink * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple((w / scale).tolist())


def _count_grams(batches):
    counts: dict[str, list[int]] = {}
    held: dict[str, list[int]] = {}

    def spread():
        for w, (toxic, ordinary) in held.items():
            text = _PAD + w + _END
            for k in range(len(w) + 1):
                c = counts.setdefault(text[k : k + ORDER], [0, 0])
                c[0] += toxic
                c[1] += ordinary
        held.clear()

    def flush():
        grams = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([counts[g][0] for g in grams], pa.int64()), pa.array([counts[g][1] for g in grams], pa.int64())], ["gram", "toxic", "ordinary"])
        counts.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in words(text or ""):
                held.setdefault(w, [0, 0])[0 if toxic else 1] += 1
            if len(held) > CACHE_ENTRIES:
                spread()
            if len(counts) > CACHE_ENTRIES:
                yield flush()
    spread()
    if counts:
        yield flush()


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, most_grams: int = MOST_GRAMS) -> ToxicityModel:
    """Learn from labelled texts whose crc32(doc_id) modulo 5 isn't 0, at most ``train_rows`` of them.

    Their distinct grams are ``most_grams`` at most; where they would be more, the sample is made
    smaller until they aren't, so that the model's memory is bounded whatever the texts' length.
    Labels null, or of documents that aren't there, teach nothing; of several labels of one
    document the largest counts. Without labels of both kinds every text scores alike.
    """
    chosen = (
        labels.filter((crc_mod("doc_id", 5) != 0) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10))
    # train_rows bounds what is broadcast; texts stay where they are. A row that is there twice teaches once.
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 33)  # 31 bits
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").distinct().select("text", (F.col("toxic") == 1).alias("toxic"), part.alias("part"), place.alias("place"))
    texts, share = stored(texts, "learning"), 1.0
    while True:
        counted = texts.filter(F.col("part") < MODEL_TENTHS).select("text", "toxic").mapInArrow(_count_grams, "gram string, toxic long, ordinary long")
        grams = stored(counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
        found = grams.count()
        if found <= most_grams:
            break
        share *= 0.8 * most_grams / found
        texts = texts.filter(F.col("place") < int(share * (1 << 31)))
    model = ToxicityModel(*kneser_ney(grams.toPandas()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        model, known = shared.value, {}
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                count = Counter(words(text or ""))
                if len(known) > CACHE_ENTRIES:
                    known.clear()
                for w in count:
                    if w not in known:
                        known[w] = model.ratio(w)
                r, n = np.array([known[w] for w in count]), np.array(list(count.values()), dtype=float)
                found.append([(n * np.logaddexp(math.log1p(-c), math.log(c) + r)).sum() / max(1, n.sum()) for c in CHANCES])
            columns = np.array(found).reshape(-1, len(CHANCES)).T
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), batch.column("toxic")], [*names, "toxic"])

    names = [f"x{k}" for k in range(len(CHANCES))]
    seen = texts.filter(F.col("part") >= MODEL_TENTHS).select("text", "toxic").mapInArrow(judge, ", ".join(f"{n} double" for n in names) + ", toxic boolean").toPandas()
    y, best = seen["toxic"].to_numpy().astype(float), math.inf
    for name, chance in zip(names, CHANCES, strict=True):
        x = np.column_stack([seen[name].to_numpy(), np.ones(len(y))])
        weights = logistic(x, y)
        loss = float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ np.array(weights))).sum())
        if loss < best:
            best, model.chance, model.weights = loss, chance, weights
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to the ``keep`` columns of every row.

    The whole text is read; null and empty texts get the score of no evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the learning rows
    carried = [F.col(c) for c in keep]
    rows = docs.select(*carried) if "text" in keep else docs.select(*carried, "text")
    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                p = model.scores(part.column("text").to_pylist())
                columns = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + columns, [f.name for f in fields] + ["score", "predicted"])

    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that the model doesn't reject, with all their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                p = model.scores(part.column("text").to_pylist())
                yield part.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents, learned as ``fit`` says."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
