"""Ranked lexical search over a two-level quantised index.

The index is a table of shards, each of some thousand documents and bounded in bytes. A shard
lists its terms; for each it holds the documents that have it and, in the first level, a byte for
how much it counts there: the impact without the term's weight, divided by a fixed step and
rounded upwards. The second level holds the exact occurrences, and the documents' lengths.

Sums of bytes times weights are upper bounds of scores, and, as a byte can't be more than a step
too high, give lower bounds too. A first pass over the first level alone finds each item's k-th
lower bound over all shards; a second one rescores, in whole numbers, every document whose upper
bound reaches it. Neither shuffles postings: a task takes a shard after the other and keeps the
k best of each item. As a shard is megabytes, row groups and Arrow batches hold a few each, so
that a task's memory doesn't grow with its shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import slices, small_batches, stored

#: Letters and digits in lower case, all else of ASCII a space; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: An impact without its weight is under this; 255 steps cover it.
SCALE = 1_000_000
STEP = -(-SCALE // 255)
#: Bytes of text and documents of one shard, at most, but for a longer text alone.
SHARD_BYTES = 4 << 20
SHARD_DOCS = 1 << 14
#: Shards that are written, read and sent to Python at once, and documents that are sent.
SHARDS_AT_ONCE = 2
DOCS_AT_ONCE = 1 << 10
#: Bytes of items that are searched in one pass over the index, about.
BLOCK_BYTES = 2 << 20

INDEX = "docs array<long>, sizes array<long>, terms array<binary>, starts array<int>, slots binary, impacts binary, times binary"


def split(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def _texts(batches) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for part in slices(batch):
            yield part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()


def _length(batches):
    n = total = 0
    for _, texts in _texts(batches):
        for text in texts:
            own = len(split(text))
            n += own > 0
            total += own
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents that hold a term, and all their terms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    r = rows.mapInArrow(_length, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return int(r[0]), int(r[1])


def spread(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """12 times what each document's length adds to the occurrences."""
    return np.array([12 * (75 + (25 * s * n) // total) for s in sizes.tolist()], dtype=np.int64)


def impact(times: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + longer)


def pack(docs: list, counts: list[Counter], n: int, total: int) -> pa.RecordBatch:
    """One shard's row."""
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(t, len(number)) for c in counts for t in c), dtype=np.int64)
    times = np.fromiter((x for c in counts for x in c.values()), dtype=np.int64)
    slot = np.repeat(np.arange(len(docs)), [len(c) for c in counts])
    order = np.argsort(term, kind="stable")
    term, times, slot = term[order], times[order], slot[order]
    size = np.array([c.total() for c in counts], dtype=np.int64)
    level = -(-impact(times, spread(size, n, total)[slot]) // STEP)
    starts = np.searchsorted(term, np.arange(len(number) + 1))
    one = lambda x, t: pa.array([x], t)
    return pa.RecordBatch.from_arrays(
        [
            one(docs, pa.list_(pa.int64())),
            one(size, pa.list_(pa.int64())),
            one(list(number), pa.list_(pa.binary())),
            one(starts.astype(np.int32), pa.list_(pa.int32())),
            *(one(x.tobytes(), pa.binary()) for x in (slot.astype("<u2"), level.astype(np.uint8), times.astype("<u4"))),
        ],
        ["docs", "sizes", "terms", "starts", "slots", "impacts", "times"],
    )


def index(docs: DataFrame, n: int, total: int) -> DataFrame:
    """The shards of all documents that hold a term, written."""

    def run(batches):
        ids, counts, held = [], [], 0
        for some, texts in _texts(batches):
            for doc, text in zip(some, texts, strict=True):
                own = Counter(split(text))
                if not own:
                    continue
                if counts and (held + len(text) > SHARD_BYTES or len(counts) == SHARD_DOCS):
                    yield pack(ids, counts, n, total)
                    ids, counts, held = [], [], 0
                ids.append(doc)
                counts.append(own)
                held += len(text)
        if counts:
            yield pack(ids, counts, n, total)

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "index", group_rows=SHARDS_AT_ONCE)


class Block:
    """Items and the terms that they ask for."""

    def __init__(self, items: list[bytes]):
        own = [Counter(split(t)) for t in items]
        self.items = [k for k, c in enumerate(own) if c]
        self.terms = list(dict.fromkeys(t for c in own for t in c))
        number = {t: k for k, t in enumerate(self.terms)}
        self.asked = [(np.array([number[t] for t in own[k]]), np.array(list(own[k].values()), dtype=np.int64)) for k in self.items]

    def weigh(self, held: dict[int, int], n: int) -> None:
        """Weights from the documents that hold each term."""
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(self.terms))], dtype=np.int64)


class Shard:
    """A shard's postings of a block's terms."""

    def __init__(self, row: dict, block: Block, exact: bool = False):
        self.starts = np.asarray(row["starts"].values)
        at = np.asarray(pc.fill_null(pc.index_in(row["terms"].values, value_set=pa.array(block.terms, pa.binary())), -1))
        mine = np.flatnonzero(at >= 0)
        self.place = np.full(len(block.terms), -1, dtype=np.int64)
        self.place[at[mine]] = mine
        self.slots = np.frombuffer(row["slots"].as_py(), "<u2")
        self.impacts = np.frombuffer(row["impacts"].as_py(), np.uint8)
        self.n = int(self.slots.max()) + 1 if len(self.slots) else 0
        if exact:
            self.docs, self.sizes = row["docs"].values, np.asarray(row["sizes"].values)
            self.times = np.frombuffer(row["times"].as_py(), "<u4")

    def postings(self, asked: np.ndarray, times: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where an item's postings are, and how much each one's impact counts."""
        here = self.place[asked]
        there = here >= 0
        here, counts = here[there], (times * weight[asked])[there]
        lo, n = self.starts[here].astype(np.int64), np.diff(self.starts)[here]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        return at, np.repeat(counts, n)

    def bounds(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of all the shard's documents; sums stay far below where doubles lose whole numbers."""
        slot = self.slots[at]
        steps = np.bincount(slot, counts * self.impacts[at].astype(np.float64), self.n).astype(np.int64)
        lost = np.bincount(slot, counts * (self.impacts[at] > 0).astype(np.float64), self.n).astype(np.int64)
        return STEP * steps, STEP * steps - (STEP - 1) * lost


def _shards(batches, block: Block, exact: bool = False) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard({name: batch.column(name)[i] for name in batch.schema.names}, block, exact)


def _ranked(score: np.ndarray, doc: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """The k first by falling score and rising doc_id, null ids last."""
    return np.lexsort((doc, none, -score))[:k]


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all that isn't ASCII, A-Z lower-cased. Every
    row of ``items`` is an item, with ids that are null or repeated too; without terms, or where
    no document scores above 0, it has no rows. Every row of ``docs`` is a document; those
    without terms count nowhere. Equal scores go by doc_id, null ones last. Items are taken in
    blocks, each two passes over the index. Extra columns are ignored.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    with small_batches(spark, DOCS_AT_ONCE):
        n, total = sizes(docs)
    asked = stored(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    if not total or not blocks:
        return spark.createDataFrame([], schema)
    with small_batches(spark, DOCS_AT_ONCE):
        shards = index(docs, n, total)
    best = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toPandas().sort_values("row")  # about BLOCK_BYTES, or one item
        block = Block([t.encode() if t else b"" for t in own["text"]])
        if not block.items:
            continue
        with small_batches(spark, SHARDS_AT_ONCE):
            part = stored(_search(shards, block, own["row"].to_numpy()[block.items], n, total, k), "found")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # Items and k rows for each of them: as large as the result.
    return first.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _search(shards: DataFrame, block: Block, rows: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(row, doc_id, score): of each item and task, the k best of the documents that may be among the k best of all."""
    spark = shards.sparkSession
    sent = spark.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

    def hold(batches):
        held: Counter = Counter()
        for shard in _shards(batches, sent.value):
            mine = np.flatnonzero(shard.place >= 0)
            held.update(dict(zip(mine.tolist(), np.diff(shard.starts)[shard.place[mine]].tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    first = shards.select("terms", "starts", "slots", "impacts")
    counted = first.mapInArrow(hold, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the block's terms
    block.weigh({r["term"]: r["n"] for r in counted}, n)
    weighed = spark.sparkContext.broadcast(block)

    def lower(batches):
        own = weighed.value
        best = [np.empty(0, np.int64)] * len(own.items)
        for shard in _shards(batches, own):
            for i, (terms, times) in enumerate(own.asked):
                _, low = shard.bounds(*shard.postings(terms, times, own.weight))
                low = low[low > (best[i].min() if len(best[i]) == k else 0)]
                best[i] = np.sort(np.concatenate([best[i], low]))[-k:]
        for i, x in enumerate(best):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(x)], ["item", "low"])

    highest = Window.partitionBy("item").orderBy(F.desc("low"))
    lows = first.mapInArrow(lower, "item long, low long").withColumn("at", F.row_number().over(highest)).filter(F.col("at") == k).select("item", "low").collect()  # one for each item
    reach = np.zeros(len(block.items), dtype=np.int64)
    for r in lows:
        reach[r["item"]] = r["low"]
    limits = spark.sparkContext.broadcast(reach)

    def rescore(batches):
        own, least = weighed.value, limits.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(own.items)
        for shard in _shards(batches, own, True):
            longer = spread(shard.sizes, n, total)
            ids, none = np.asarray(pc.fill_null(shard.docs, 0)), np.asarray(pc.is_null(shard.docs))
            for i, (terms, times) in enumerate(own.asked):
                at, counts = shard.postings(terms, times, own.weight)
                high, _ = shard.bounds(at, counts)
                may = (high >= least[i]) & (high > 0)
                if not may.any():
                    continue
                mine = may[shard.slots[at]]
                at, counts = at[mine], counts[mine]
                slot = shard.slots[at]
                score = np.zeros(shard.n, dtype=np.int64)
                np.add.at(score, slot, counts * impact(shard.times[at].astype(np.int64), longer[slot]))
                found = np.flatnonzero(score)
                every = [np.concatenate(x) for x in zip(best[i], (score[found], ids[found], none[found]), strict=True)]
                keep = _ranked(*every, k)
                best[i] = tuple(x[keep] for x in every)
        for i, (score, doc, gone) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), rows[i])), pa.array(doc, pa.int64(), mask=gone), pa.array(score)], ["row", "doc_id", "score"])

    return shards.mapInArrow(rescore, "row long, doc_id long, score long")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), l AS (SELECT doc_id, d, len(terms) AS n, terms FROM w WHERE len(terms) > 0
), a AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS total FROM l
), p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM l) GROUP BY 1, 2
), f AS (SELECT term, CAST(floor(1000 * ln((2 * a.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, a GROUP BY term, a.n
), q AS (
  SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2, 3
), s AS (
  SELECT q.i, q.item_id, l.doc_id, CAST(sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * l.n * a.n) // a.total)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (d), a GROUP BY q.i, q.item_id, l.doc_id, l.d
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
