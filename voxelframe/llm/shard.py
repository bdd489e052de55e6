"""Size-balanced shards by sampled splitters, in DataFrame functions only.

The sort key of a record is a hash of its text, so equal texts lie side by side. Keys are
sampled with a probability proportional to the record's size, the sample's quantiles are the
splitters of many small ranges, and ranges that came out too large are subdivided by a second
hash of the text, so that equal texts stay together. A text whose copies are much of a shard is
placed by itself, the largest first, each into the emptiest shard; one that exceeds a shard is
dealt by record. Then the ranges are laid end to end, and each shard takes as long a stretch of
them as brings all shards to one level.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import stored

#: Bytes that a record counts for besides its text.
OVERHEAD = 8
#: Ranges for each shard. Their number depends on the shards alone, so that what is collected or
#: sent to every task (splitters, ranges, large texts) has the same size for any input.
RANGES_PER_SHARD = 64
#: Sampled keys for each range, on average.
SAMPLES_PER_RANGE = 24
#: A text whose copies are more than this part of a shard is placed by itself.
LARGE_PARTS = 16


def _rank(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most ``key``: a binary search whose steps are a constant array."""
    if not splitters:
        return F.lit(0)
    bounds = F.lit(splitters)
    steps, step = [], 1
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: at + F.when(F.coalesce(F.try_element_at(bounds, at + s) <= key, F.lit(False)), s).otherwise(F.lit(0)),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted key sample; ``rows`` has ``key``, ``row`` and ``size``.

    A record is drawn as often as its size over the sampling step says, the fraction decided by
    a hash of the record, so that a retried task draws the same sample.
    """
    if total <= 0 or ranges < 2:
        return []
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    chance = F.pmod(F.xxhash64("row", "size", "key", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") / F.lit(step) + chance).cast("int")
    drawn = rows.withColumn("__times", times).filter("__times > 0").select("key", "__times")
    at = F.lit([k / ranges for k in range(1, ranges)])
    drawn = drawn.select(F.explode(F.array_repeat("key", F.col("__times"))).alias("key"))
    found = drawn.agg(F.percentile_approx("key", at, F.lit(4 * ranges)).alias("b"))
    bounds = found.first()["b"]
    return sorted(set(bounds or []))


def packed(large: list[tuple[int, int]], rest: int, shards: int) -> tuple[dict[int, int], list[float]]:
    """Shards of large units, given as (unit, size), and how much of the rest each shard takes so that all come to one level."""
    held, place = [0.0] * shards, {}
    for unit, size in sorted(large, key=lambda x: (-x[1], x[0])):
        at = min(range(shards), key=lambda s: (held[s], s))
        held[at] += size
        place[unit] = at
    level, filled = 0.0, sorted(held)
    for n in range(1, shards + 1):  # the n emptiest shards are filled up
        level = (rest + sum(filled[:n])) / n
        if n == shards or level <= filled[n]:
            break
    return place, [max(0.0, level - h) for h in held]


def assign(docs: DataFrame, shards: int = 24, text: str = "text") -> DataFrame:
    """Shard and slot of every record: sizes near equal, equal texts together unless they exceed a shard.

    Columns: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).
    A null text has the size of an empty one and its checksum, and goes with it. Repeated rows
    are records of their own. Slots are gapless from 0 in each shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("key"),
        F.xxhash64(body, F.lit(5)).alias("key2"),
    )
    # Rows are told apart by a number, which stands once they are written.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    share, whole = max(1.0, total / ranges), max(1.0, total / shards)
    # No more than LARGE_PARTS * shards texts can be so large.
    texts = rows.groupBy("key", "key2").agg(F.sum("size").alias("b"), F.count("*").alias("n")).filter(F.col("b") * LARGE_PARTS > whole)
    texts = [r for r in texts.orderBy(F.desc("b"), "key", "key2").collect() if r["n"] > 1 or r["b"] <= whole]
    bounds = splitters(rows, total, ranges)
    schema = "key long, key2 long, large int, parts long"
    large = rows.sparkSession.createDataFrame([(r["key"], r["key2"], k, max(1, min(r["n"], int(r["b"] / share)))) for k, r in enumerate(texts)], schema)
    rows = rows.join(F.broadcast(large), ["key", "key2"], "left")
    # A large text is a unit, or several where one would be more than a range: they are numbered apart.
    rows = rows.withColumn("r", F.coalesce(F.col("large") + ranges, _rank(F.col("key"), bounds)))
    sizes = rows.filter("large is null").groupBy("r").agg(F.sum("size").alias("b")).filter(F.col("b") > 2 * share)
    crowded = rows.sparkSession.createDataFrame([(r["r"], int(r["b"] / share) + 1) for r in sizes.collect()], "r int, crowd long")  # at most half of the ranges
    rows = rows.join(F.broadcast(crowded), "r", "left")
    part = F.when(F.col("large").isNotNull(), F.pmod(F.xxhash64("row", F.lit(7)), F.col("parts"))).when(F.col("crowd").isNotNull(), F.pmod("key2", F.col("crowd"))).otherwise(0)
    unit = ["r", "part"]
    rows = stored(rows.select("row", "doc_id", "size", "text_crc32", "key", "r", part.cast("int").alias("part")), "ranges")
    # A few rows for each range and large text, whatever the input's size: they fit the driver and every task.
    units = [(r["r"], r["part"], r["b"], r["n"]) for r in rows.groupBy(*unit).agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy(*unit).collect()]
    kept = {k + ranges for k, r in enumerate(texts) if r["b"] <= whole}
    weight: dict[int, int] = {}
    for r, _, b, _ in units:
        if r in kept:
            weight[r] = weight.get(r, 0) + b
    place, room = packed(list(weight.items()), total - sum(weight.values()), shards)
    ends = list(accumulate(room))
    at, before, placed = 0, [0] * shards, []
    for r, part, b, n in units:
        if r in place:
            shard = place[r]
        else:
            shard = min(shards - 1, bisect_right(ends, at + b / 2))
            at += b
        placed.append((r, part, shard, before[shard]))
        before[shard] += n
    placed = rows.sparkSession.createDataFrame(placed, "r int, part int, shard int, before long")
    order = Window.partitionBy(*unit).orderBy("key", "row")
    return (
        rows.withColumn("n", F.row_number().over(order))
        .join(F.broadcast(placed), unit)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("n") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
