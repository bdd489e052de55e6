"""N-gram Jaccard join: documents whose shingle sets are at most ``1 - threshold`` apart.

Jaccard distance is a metric, and the join is exact. Sets of real texts lie almost all at
distance 1 from one another, where windows round ordinary pivots would copy every document to
every region; so regions are made in two steps.

1.  The first pivots are single shingles. A set's nearest such pivots are its own shingles, in
    one global order: those of a single class first, then rare before frequent. Two sets within
    the radius share one of the first ``n - ceil(threshold * n) + 1`` shingles of each, so a
    document stands in the regions of these and no others: the window that holds all its
    partners. Most documents find only shingles of their own there and leave the join.
2.  Documents that meet at a shingle go to the region of that shingle's first document, their
    pivot there. A region is joined by true distances: a pivot takes the ball of all within the
    radius r, which is one component; by the triangle inequality a document at distance d from
    the pivot can only link with those at d - r to d + r, so each of the others is measured
    against that window, until all that aren't measured are of one component. A
    region too large for a task goes through the same steps with its documents dealt to many:
    each round links a ball and keeps, beside what is outside, only the ball members that the
    triangle inequality lets link with the shell. Documents with too many shingles of their
    own in the region leave it, and what stays too large is dealt to blocks, of which each two
    meet in a task: no task takes a region whole.

Equal sets are one class throughout. The order needs document frequencies only for a fixed
part of the hash space (``sampled``), chosen so that it holds enough shingles of nearly every
document; the few others add shingles from outside it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import slices, small_batches, stored
from voxelframe.llm.graph import components
from voxelframe.llm.wordarrays import SPACED, mixed, shingles, words

#: A region of more shingles than this is measured against its centre by many tasks, which takes copies
#: of one text out of it; what is more than LARGE_REGION then is made smaller still before a task joins it.
DEALT_REGION = 100_000
LARGE_REGION = 3_000_000
LARGE_DOCS = 16_384
#: Cells of a region's matrix of shingles, and cells or postings that are worked on at once.
MATRIX = 1 << 24
BLOCK_CELLS = 1 << 20
#: Documents that are sent to Python at once.
DOCS_AT_ONCE = 1 << 10
#: Rounds in which documents without a possible partner leave a region.
LONE_ROUNDS = 8
#: Rounds of that, and parts that the holders of a frequent shingle are dealt to.
ROUNDS = 6
PARTS = 64
#: Shingles of over so many of a thousand of about this many sampled documents are frequent: at most so many
#: are listed. They come last in the order and are dealt to many tasks; the list changes no result.
SAMPLE_DOCS = 4000
OFTEN = 3
FREQUENT = 16_384


class Sets:
    """Distinct shingle sets of a slice of texts: sorted 63-bit hashes and where each text's begin."""

    def __init__(self, column: pa.Array, n: int):
        w = words(column, SPACED)
        h, text = shingles(w, w.hashes(), n)
        h >>= np.uint64(1)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.hash, self.text = h[keep], text[keep]
        self.size = np.bincount(self.text, minlength=len(column))
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.mark = np.zeros(len(column), dtype=np.uint64)
        full = np.flatnonzero(self.size)
        if len(full):
            self.mark[full] = mixed(np.add.reduceat(mixed(self.hash), self.begin[full]))


def _prefix(size, percent: int):
    """Shingles of a set of this size of which partners share one: size - ceil(percent% of size) + 1."""
    return size - (size * percent + 99) // 100 + 1


def _fingerprints(n: int, cut: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = Sets(part.column("text"), n)
                inside = np.bincount(s.text[s.hash < cut], minlength=len(s.size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s.size, pa.int64()), pa.array(s.mark.view(np.int64), pa.int64()), pa.array(inside, pa.int64())],
                    ["doc_id", "n_shingles", "mark", "inside"],
                )

    return run


def _order_rows(n: int, cut: int, percent: int):
    """(h, mark, n): each class's shingles below the cut, and from above it those that a short prefix needs."""

    def run(batches):
        seen: set[tuple[int, int]] = set()  # classes of this task
        for batch in batches:
            for part in slices(batch):
                s = Sets(part.column("text"), n)
                new = np.zeros(len(s.size), dtype=bool)
                for k, key in enumerate(zip(s.mark.tolist(), s.size.tolist(), strict=True)):
                    if key[1] and key not in seen:
                        seen.add(key)
                        new[k] = True
                # Hashes are sorted within a text, so a prefix of each run is what is wanted.
                inside = np.bincount(s.text[s.hash < cut], minlength=len(s.size))
                wanted = np.maximum(inside, _prefix(s.size, percent)) * new
                place = np.arange(len(s.hash)) - s.begin[s.text]
                keep = place < wanted[s.text]
                of = s.text[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.hash[keep].astype(np.int64)), pa.array(s.mark[of].view(np.int64), pa.int64()), pa.array(s.size[of].astype(np.int32))], ["h", "mark", "n"]
                )

    return run


def _region_sets(n: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = Sets(part.column("text"), n)
                right = np.flatnonzero((s.mark.view(np.int64) == part.column("mark").to_numpy()) & (s.size == part.column("n").to_numpy()))
                data = s.hash.tobytes()
                held = [data[8 * s.begin[k] : 8 * s.begin[k + 1]] for k in right.tolist()]
                rows = part.take(pa.array(right))
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("regions"), pa.array(held, pa.binary())], ["node", "regions", "shingles"])

    return run


def _without_lone(code: np.ndarray, owner: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Numbers of the sets that may have a partner: of the others more shingles than a partner may lack are no other set's."""
    spare = size - (size * percent + 99) // 100
    alive = np.ones(len(size), dtype=bool)
    for _ in range(LONE_ROUNDS):
        here = alive[owner]
        held = np.bincount(code[here])
        own = np.bincount(owner[here][held[code[here]] == 1], minlength=len(size))
        gone = alive & (own > spare)
        if not gone.any():
            break
        alive[gone] = False
    return np.flatnonzero(alive)


class Region:
    """Sets by their shingles: those that many of them hold as columns of a matrix, the others as postings."""

    def __init__(self, code: np.ndarray, size: np.ndarray):
        n = len(size)
        self.size = size
        held = np.bincount(code)
        wide = min(MATRIX // n, len(held))
        columns = np.argsort(-held, kind="stable")[:wide]
        columns = columns[held[columns] > max(1, n // 16)]
        place = np.full(len(held), -1)
        place[columns] = np.arange(len(columns))
        owner = np.repeat(np.arange(n), size)
        mine = place[code] >= 0
        # Counts below 2^24 are exact in single precision.
        self.matrix = np.zeros((n, len(columns)), dtype=np.float32 if size.max() < 1 << 24 else np.float64)
        self.matrix[owner[mine], place[code[mine]]] = 1
        self.code, owner = code[~mine], owner[~mine]
        self.begin = np.searchsorted(owner, np.arange(n + 1))
        self.posting = owner[np.argsort(self.code, kind="stable")]
        self.ends = np.r_[0, np.cumsum(np.bincount(self.code, minlength=len(held)))]
        # Postings that a set's own shingles have.
        self.cost = np.bincount(owner, np.diff(self.ends)[self.code], minlength=n).astype(np.int64)

    def shared(self, some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Shingles that each of ``some`` sets shares with each from ``lo`` to ``hi``."""
        out = self.matrix[some] @ self.matrix[lo:hi].T
        n = self.begin[some + 1] - self.begin[some]
        own = self.code[_runs(self.begin[some], n)]
        row = np.repeat(np.arange(len(some)), n)
        n = self.ends[own + 1] - self.ends[own]
        other, row = self.posting[_runs(self.ends[own], n)] - lo, np.repeat(row, n)
        inside = (other >= 0) & (other < hi - lo)
        at = row[inside] * (hi - lo) + other[inside]
        if len(at):
            out += np.bincount(at, minlength=out.size).reshape(out.shape)
        return out

    def near(self, some: np.ndarray, lo: int, hi: int, percent: int) -> np.ndarray:
        """Which of them link: 100 * common >= percent * union."""
        both = percent * (self.size[some][:, None] + self.size[None, lo:hi])
        return self.shared(some, lo, hi) >= -(-both // (100 + percent))


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``n`` of them, one run after the other."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else first


def join_region(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (document, root) of a region's components, by a pivot, its ball and windows.

    Documents without a possible partner leave. The pivot is the document whose shingles most
    others hold, so its ball is large in a group of near copies, and one component. Each document
    that isn't of the largest component is measured, once, against all whose distance from the
    pivot the triangle inequality allows, members of the ball too; this ends when those that are
    still to be measured are of one component, as a link between them tells nothing new. A
    document is measured once at most, so work is at most the square of the documents.
    """
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    kept = _without_lone(code, owner, size, percent)
    if len(kept) < 2:
        return []
    stay = np.zeros(len(sets), dtype=bool)
    stay[kept] = True
    code, size = code[stay[owner]], size[kept]
    begin = np.r_[0, np.cumsum(size)]
    held = np.bincount(code)
    pivot = int(np.argmax(np.add.reduceat(held[code], begin[:-1]) / size))
    own = np.zeros(len(held), dtype=bool)
    own[code[begin[pivot] : begin[pivot + 1]]] = True
    shared = np.add.reduceat(own[code].astype(np.int64), begin[:-1])
    distance = 1 - shared / (size[pivot] + size - shared)
    # From here on by distance from the pivot, which comes first.
    order = np.argsort(distance, kind="stable")
    order = np.r_[pivot, order[order != pivot]]
    kept, distance = kept[order], distance[order]
    region = Region(code[_runs(begin[order], size[order])], size[order])
    radius = 1 - percent / 100 + 1e-9
    label = np.arange(len(kept))
    waits = np.ones(len(kept), dtype=bool)
    block = np.array([0])
    while len(block):
        lo, hi = np.searchsorted(distance, distance[block[0]] - radius), np.searchsorted(distance, distance[block[-1]] + radius, "right")
        for near in region.near(block, lo, hi, percent):
            met = label[lo:hi][near]
            least = met.min()
            if (met != least).any():
                label[np.isin(label, met)] = least
        waits[block] = False
        left = np.flatnonzero(waits)
        block = left[label[left] != np.bincount(label[left]).argmax()] if len(left) else left
        # As many as keep the products and the postings read at once small.
        block = block[: max(1, BLOCK_CELLS // len(kept))]
        block = block[: max(1, int(np.searchsorted(np.cumsum(region.cost[block]), BLOCK_CELLS)))]
    root = np.full(len(kept), len(sets))
    np.minimum.at(root, label, kept)
    return [(int(ids[k]), int(ids[r])) for k, r in zip(kept.tolist(), root[label].tolist(), strict=True) if k != r]


def _shared(shingles, other):
    """Shingles that two sets have in common, both as bytes of sorted hashes."""

    @F.pandas_udf("long")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.empty(len(a), dtype=np.int64)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            out[k] = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return pd.Series(out)

    return count(shingles, other)


def _hashes(shingles):
    """The hashes of a set that is given as bytes."""

    @F.pandas_udf("array<long>")
    def taken(a: pd.Series) -> pd.Series:
        return a.map(lambda b: np.frombuffer(b, np.int64))

    return taken(shingles)


def without_lone(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """``rows`` without the documents that can't link with any other of their group.

    A partner has ``percent`` of a set's shingles at least, so a document of which more are no
    other's has none. Dropped documents may leave others alone; one pass is made.
    """
    held = rows.select(*keys, "node", (F.octet_length("shingles") / 8).cast("long").alias("n"), F.explode(_hashes("shingles")).alias("h"))
    own = held.groupBy(*keys, "h").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("n").alias("n")).filter("c = 1")
    lone = own.groupBy(*keys, "node").agg(F.count("*").alias("c"), F.min("n").alias("n")).filter(f"c > n - (n * {percent} + 99) div 100").select(*keys, "node")
    return rows.join(lone.hint("shuffle_hash"), [*keys, "node"], "left_anti")


def _weight():
    """How many times what one task joins a group of (node, shingles) is, by its shingles or its documents."""
    return F.greatest(F.sum(F.octet_length("shingles") / 8) / LARGE_REGION, F.count("*") / LARGE_DOCS)


def in_blocks(rows: DataFrame) -> DataFrame:
    """(pivot, band, part, node, shingles): groups above the limit are dealt to blocks, and each two blocks make a part.

    Any two documents of a group meet in a part, so the parts' links together are the group's.
    Two blocks hold four fifths of the limit on average.
    """
    size = rows.groupBy("pivot", "band").agg(_weight().alias("size"))
    blocks = size.select("pivot", "band", F.when(F.col("size") > 1, F.ceil(F.col("size") * 2.5)).otherwise(1).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int")
    met = rows.join(blocks, ["pivot", "band"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.filter("own <> other or blocks = 1")
    part = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    return met.select("pivot", "band", part.alias("part"), "node", "shingles")


def shrink_regions(rows: DataFrame, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """Links of large regions' balls, and what is left of the regions (pivot, band, part, node, shingles).

    ``rows`` has pivot, node and shingles; a region's pivot is one of its documents and the first
    centre. In a round every region's document is measured against its centre; those within the
    radius are linked to it.
    Ball members that no document of the shell can link with leave. One round is enough for most
    regions; from those that stay large, documents without partners leave, and rounds go on.
    Regions still large after the last round are cut into bands of set size, each holding the
    sizes of the next one too: beyond that, sizes alone part two sets. Bands that are still large
    are dealt to parts in which each two of their documents meet.
    """
    radius = 1 - percent / 100
    links: list[DataFrame] = []
    ready: list[DataFrame] = []
    shape = ["pivot", "band", "part", "node", "shingles"]
    whole = F.lit(0).cast("long").alias("part")
    now = rows.select("pivot", F.col("pivot").alias("center"), "node", "shingles")
    n, m = F.octet_length("shingles") / 8, F.octet_length("center_shingles") / 8
    for k in range(ROUNDS):
        # What has a row for each region is written first, so that Spark sends it to all tasks where
        # its size allows, and else joins by region, parting hot ones.
        centers = stored(now.filter("node = center").select("pivot", F.col("shingles").alias("center_shingles")).dropDuplicates(["pivot"]), "centers")
        met = now.join(centers, "pivot")
        met = met.withColumn("shared", _shared(F.col("shingles"), F.col("center_shingles"))).withColumn("union", (n + m - F.col("shared")).cast("long"))
        near, far = F.col("shared") * 100 >= F.col("union") * percent, 1 - F.col("shared") / F.col("union")
        met = stored(met.select("pivot", "center", "node", "shingles", near.alias("near"), far.alias("far")), "measured")
        links.append(met.filter("near and node <> center").select(F.col("node").alias("u"), F.col("center").alias("v")))
        rest = met.filter("not near").groupBy("pivot").agg(F.min("node").alias("next"), F.min(F.when(F.col("far") <= 2 * radius + 1e-9, F.col("far"))).alias("shell"))
        kept = met.join(stored(rest, "rest"), "pivot").filter(~F.col("near") | (F.col("far") >= F.col("shell") - radius - 1e-9))
        kept = stored(kept.select("pivot", F.col("next").alias("center"), "node", "shingles"), "kept")
        large = stored(kept.groupBy("pivot").agg(_weight().alias("size")).filter("size > 1").select("pivot"), "large")
        ready.append(kept.join(large, "pivot", "left_anti").select("pivot", F.lit(-1).alias("band"), whole, "node", "shingles"))
        now = kept.join(large, "pivot", "left_semi")
        if not large.head(1):
            break
        if not k:
            now = without_lone(now, ["pivot"], percent).drop("center")
            now = stored(now, "linked")
            now = now.join(stored(now.groupBy("pivot").agg(F.min("node").alias("center")), "first"), "pivot")
    else:
        band = F.floor(F.log(F.octet_length("shingles") / 8) / float(np.log(100 / percent)) + 1e-9).cast("int")
        now = now.select("pivot", F.explode(F.array(band, band + 1)).alias("band"), "node", "shingles")
        ready.append(in_blocks(stored(without_lone(now, ["pivot", "band"], percent), "bands")))
    out = ready[0].select(*shape)
    for df in ready[1:]:
        out = out.unionByName(df.select(*shape))
    return links, out


def frequent_shingles(docs: DataFrame, rows, total: int) -> list[int]:
    """Hashes that a sample of the documents holds often, most frequent first."""
    part = min(1.0, SAMPLE_DOCS / max(1, total))
    seen = docs.sample(part, seed=7).mapInArrow(rows, "h long, mark long, n int").groupBy("h").count()
    often = seen.filter(F.col("count") > max(12, part * total * OFTEN / 1000)).orderBy(F.desc("count"), "h").limit(FREQUENT)
    return [r["h"] for r in often.collect()]


def near_groups(docs: DataFrame, n: int = 3, percent: int = 90, sampled: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    A document's set are its distinct ``n``-word shingles (A-Z lower-cased, words parted by space
    and U+0009 to U+000D); with fewer words, the whole sequence. Null, empty and blank texts
    have no set and link with nothing. Two documents link when 100 * common >= percent * union;
    ``component_id`` is the smallest doc_id reached by links. Repeated rows are kept, and rows of
    one doc_id and several texts each have their own text's component; rows with a null doc_id
    have that of their own text's class. Shingles are 64-bit hashes; classes are told apart by
    such a hash and the set's size.
    """
    with small_batches(docs.sparkSession, DOCS_AT_ONCE):  # all that Python does is written in here
        return _near_groups(docs, n, percent, sampled)


def _near_groups(docs: DataFrame, n: int, percent: int, sampled: float | None) -> DataFrame:
    cut = int(min(1.0, sampled if sampled is not None else 1.75 * (1 - percent / 100)) * 2**63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = stored(docs.mapInArrow(_fingerprints(n, cut), "doc_id long, n_shingles long, mark long, inside long"), "marks")
    key = ["mark", "n"]
    classes = marks.filter("n_shingles > 0").groupBy("mark", F.col("n_shingles").cast("int").alias("n")).agg(F.min("doc_id").alias("least"), F.first("inside").alias("inside"))
    # A class is a node of its own: one doc_id may stand for several classes.
    classes = classes.withColumn("node", F.xxhash64(*key))

    # The order: shingles of one class, then by how many tasks' classes hold one, then the frequent.
    rows = docs.mapInArrow(_order_rows(n, cut, percent), "h long, mark long, n int")
    frequent = frequent_shingles(docs, _order_rows(n, cut, percent), marks.count())
    often = F.col("h").isin(frequent) if frequent else F.lit(False)
    rows = rows.withColumn("part", F.when(often, F.pmod("mark", F.lit(PARTS))).otherwise(0).cast("int"))
    of = Window.partitionBy("h", "part")
    met = rows.select("*", F.count("*").over(of).alias("df"), F.min("mark").over(of).alias("lo"), F.max("mark").over(of).alias("hi"))
    met = met.filter((F.col("lo") != F.col("hi")) | often).withColumn("df", F.when(often, F.lit(1 << 60)).otherwise(F.col("df")))
    met = met.groupBy(*key).agg(F.collect_set(F.when(F.col("h") < cut, F.struct("df", "h"))).alias("low"), F.collect_set(F.when(F.col("h") >= cut, F.col("h"))).alias("high"))
    met = met.join(classes.filter("least is not null"), key)
    slots = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    free = (slots - (F.col("inside") - F.size("low"))).cast("int")
    first = F.slice(F.array_sort("low"), 1, F.greatest(free, F.lit(0)))
    met = met.select(*key, "node", "least", F.explode(F.concat(F.transform(first, lambda x: x["h"]), "high")).alias("h"))

    # Regions: documents that meet at a shingle, under one of them.
    met = stored(met, "prefixes")
    pivots = met.groupBy("h").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last").select("h", "pivot")
    met = stored(met.join(pivots, "h").select(*key, "node", "least", "pivot").distinct(), "regions")
    placed = met.groupBy(*key, "node", "least").agg(F.collect_set("pivot").alias("regions"))
    # The documents in regions grow with the corpus: they are never broadcast, at any size.
    wanted = placed.withColumnRenamed("least", "doc_id").hint("shuffle_hash")
    sets = docs.join(wanted, "doc_id").select("node", "mark", "n", "regions", "text")
    sets = sets.mapInArrow(_region_sets(n), "node long, regions array<long>, shingles binary")
    sets = sets.select(F.explode("regions").alias("pivot"), F.lit(-1).alias("band"), F.lit(0).cast("long").alias("part"), "node", "shingles")
    links = []
    large = stored(met.groupBy("pivot").agg(F.sum("n").alias("size")).filter(F.col("size") > min(DEALT_REGION, LARGE_REGION)).select("pivot"), "large")
    if large.head(1):
        sets = stored(sets, "sets")
        links, rest = shrink_regions(sets.join(large, "pivot", "left_semi"), percent)
        sets = sets.join(large, "pivot", "left_anti").unionByName(rest)

    def region(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        found = join_region(pdf["node"].to_numpy(), [np.frombuffer(b, dtype=np.uint64) for b in pdf["shingles"]], percent)
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    links.append(sets.groupBy("pivot", "band", "part").applyInPandas(region, "u long, v long"))
    found = components(reduce(DataFrame.unionByName, links))
    # The smallest doc_id of each component of classes; a class without links is one by itself.
    linked = stored(classes.select(*key, "node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = linked.join(least, "component").select("mark", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return marks.select("doc_id", "n_shingles", "mark").join(nodes, ["mark", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
