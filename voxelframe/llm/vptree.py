"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

Vantage-point trees need a metric. Queries are brought to the norm of the longest vector, and
one more component brings every vector to that norm too (none for the query): then Euclidean
distance orders vectors as the inner product does. A coarse tree over a bounded sample parts
the space into cells, cells that hold too much are dealt to shards, and each shard is a tree of
its own. A query is first asked of its home cell; the k-th score it found there goes with it to
those other cells that the triangle inequality doesn't rule out. ``relax`` scales the margin of
that test, between cells as inside the trees: a side at margin g from the query is skipped if
relax * g > distance of the k-th best. At 1 nothing nearer can be lost and the search is exact;
above 1 it skips more and may lose some.

A matrix product only finds whom to look at, with its rounding errors allowed for; those are
scored in double precision one component after the other, and ranked by score, then id. Vectors
are held as a power of two and components below one, so that no square of them overflows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import stored

#: Vectors of a shard at most about this many, and bytes.
SHARD_ROWS = 32_768
SHARD_BYTES = 16 << 20
#: Vectors of a cell on average, while there are no more cells than CELLS (a power of two). Fewer than a shard's
#: need no cells: a tree of their own tells more apart.
CELL_ROWS = SHARD_ROWS
CELLS = 256
#: Vectors that the coarse trees are grown from, about; all vectors are then placed by them.
SAMPLE_ROWS = 16_384
#: Vectors have inner products with those of their own length only. So many lengths, the
#: commonest, get a coarse tree; vectors of others are dealt to shards by length and hash.
LENGTHS = 64
#: Queries that meet a shard in one task, about.
CHUNK_ROWS = 8192
#: Vectors of a leaf at most. Where little can be ruled out, time goes with the number of leaves that are looked at.
LEAF = 1024
#: Pairs of a query and a vector that are looked at in one step.
PAIRS = 1 << 19
#: Part of the longest norm by which a computed distance may be off.
SLACK = 1e-7
_NONE = np.iinfo(np.int64).max
_MOST = np.finfo(np.float64).max

#: A node: radius, numbers of its two children (-1: a leaf), and its run of rows. Rows come in tree
#: order, so that a run is a slice; the first row of an inner node's run is its vantage point.
NODE = np.dtype([("radius", "f8"), ("near", "i8"), ("far", "i8"), ("first", "i8"), ("last", "i8")])


class Scale(NamedTuple):
    """The largest exponent of the vectors of a length, and their longest norm over two to it."""

    exponent: int
    longest: float


def build(points: np.ndarray, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The rows in tree order, and the nodes from the root on."""
    order = np.arange(len(points))
    nodes = [(0.0, -1, -1, 0, len(points))]
    rng = np.random.default_rng(seed)
    work = [0]
    while work:
        node = work.pop()
        _, _, _, a, b = nodes[node]
        if b - a <= LEAF:
            continue
        pick = a + int(rng.integers(b - a))
        order[[a, pick]] = order[[pick, a]]
        rows = order[a + 1 : b]
        d = np.sqrt(((points[rows] - points[order[a]]) ** 2).sum(axis=1))
        half = len(rows) // 2
        split = np.argpartition(d, half)
        radius = float(d[split[half]])
        order[a + 1 : b] = rows[split]
        near, middle = len(nodes), a + 1 + half
        nodes[node] = (radius, near, near + 1, a, b)
        nodes += [(0.0, -1, -1, a + 1, middle), (0.0, -1, -1, middle, b)]
        work += [near, near + 1]
    return order, np.array(nodes, dtype=NODE)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def scores(a: np.ndarray, a_exponent: np.ndarray, b: np.ndarray, b_exponent: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for k in range(0, len(a), 16_384):
        part = slice(k, k + 16_384)
        out[part] = inner(a[part], b[part])
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(out, a_exponent + b_exponent)


class Points(NamedTuple):
    """Vectors as components below one and exponents, with what the metric needs of them."""

    data: np.ndarray
    exponent: np.ndarray
    unit: np.ndarray  # two to the exponent, over the largest
    norm: np.ndarray
    lift: np.ndarray  # the component that brings a vector to the longest norm

    @classmethod
    def of(cls, data: np.ndarray, exponent: np.ndarray, scale: Scale) -> Points:
        with np.errstate(under="ignore"):
            unit = np.ldexp(1.0, exponent - scale.exponent)
            norm = np.sqrt((data**2).sum(axis=1)) * unit
        return cls(data, exponent, unit, norm, np.sqrt(np.maximum(scale.longest**2 - norm**2, 0)))

    def lifted(self) -> np.ndarray:
        return np.column_stack([self.data * self.unit[:, None], self.lift])


class Asked:
    """Queries, and the best k found for each so far: scores, ids and numbers of rows, best first.

    ``floor``: the score of a query's k-th best elsewhere. It fills the places; at the same score
    it comes after any vector found.
    """

    def __init__(self, data: np.ndarray, exponent: np.ndarray, scale: Scale, k: int, floor: np.ndarray):
        self.data, self.exponent, self.scale = data, exponent, scale
        self.norm = np.sqrt((data**2).sum(axis=1))
        self.point = data * (scale.longest / self.norm)[:, None]
        self.slack = 4 * (data.shape[1] + 2) * np.finfo(np.float64).eps * self.norm
        self.score = np.repeat(floor[:, None], k, axis=1)
        self.id = np.full((len(data), k), _NONE)
        self.row = np.full((len(data), k), -1, dtype=np.int64)

    def threshold(self, rows: np.ndarray) -> np.ndarray:
        """The k-th scores in the units of a query's components and the longest vector's exponent."""
        shift = -(self.exponent[rows] + self.scale.exponent)
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            least = np.ldexp(np.minimum(self.score[rows, -1], _MOST), shift) - np.ldexp(1.0, np.maximum(shift - 1073, -1074))
        return np.where(np.isnan(least), -np.inf, least)

    def radius(self, rows: np.ndarray) -> np.ndarray:
        """Distances of the k-th best, never too small by more than the slack."""
        longest = self.scale.longest
        with np.errstate(over="ignore"):
            return np.sqrt(np.maximum(2 * longest**2 - 2 * longest / self.norm[rows] * self.threshold(rows), 0)) + SLACK * longest

    def distance(self, rows: np.ndarray, points: Points, at: int) -> np.ndarray:
        return np.sqrt(((self.point[rows] - points.data[at] * points.unit[at]) ** 2).sum(axis=1) + points.lift[at] ** 2)

    def offer(self, rows: np.ndarray, points: Points, ids: np.ndarray, numbers: np.ndarray, a: int, b: int) -> None:
        step = max(1, PAIRS // (b - a))
        for first in range(0, len(rows), step):
            self._offer(rows[first : first + step], points, ids, numbers, a, b)

    def _offer(self, rows: np.ndarray, points: Points, ids: np.ndarray, numbers: np.ndarray, a: int, b: int) -> None:
        near = (self.data[rows] @ points.data[a:b].T) * points.unit[a:b]
        slack, k = self.slack[rows] * points.norm[a:b].max() + 1e-300, self.score.shape[1]
        least = self.threshold(rows) - slack
        keep = near >= least[:, None]
        # Of many candidates, those surely behind k others of the same run are left out before any is scored.
        many = np.flatnonzero(np.count_nonzero(keep, axis=1) > 2 * k)
        if len(many):
            kth = np.partition(near[many], b - a - k, axis=1)[:, b - a - k]
            keep[many] &= near[many] >= (kth - 2 * slack[many])[:, None]
        r, c = np.nonzero(keep)
        if not len(r):
            return
        at, c = rows[r], a + c
        score = scores(self.data[at], self.exponent[at], points.data[c], points.exponent[c])
        last, last_id = self.score[at, -1], self.id[at, -1]
        better = (score > last) | ((score == last) & (ids[c] < last_id))
        r, c, score = r[better], c[better], score[better]
        if not len(r):
            return
        # The rows that gain something, each with as many places more as any of them needs.
        some, r = np.unique(r, return_inverse=True)
        n = np.bincount(r)
        place = np.arange(len(r)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        own = rows[some]
        all_scores = np.full((len(some), k + int(n.max())), -np.inf)
        all_ids = np.full(all_scores.shape, _NONE)
        all_rows = np.full(all_scores.shape, -1, dtype=np.int64)
        for full, held, new in ((all_scores, self.score, score), (all_ids, self.id, ids[c]), (all_rows, self.row, numbers[c])):
            full[:, :k] = held[own]
            full[r, k + place] = new
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        for full, held in ((all_scores, self.score), (all_ids, self.id), (all_rows, self.row)):
            held[own] = np.take_along_axis(full, best, axis=1)


def search(nodes: np.ndarray, points: Points, ids: np.ndarray, numbers: np.ndarray, asked: Asked, relax: float) -> None:
    """Walk a tree with all queries at once; points, ids and row numbers are in tree order."""
    flat = nodes.tolist()
    work: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(len(asked.data)), np.zeros(len(asked.data)))]
    while work:
        node, rows, margin = work.pop()
        rows = rows[relax * margin <= asked.radius(rows)]
        if not len(rows):
            continue
        radius, near, far, a, b = flat[node]
        if near < 0:
            asked.offer(rows, points, ids, numbers, a, b)
            continue
        asked.offer(rows, points, ids, numbers, a, a + 1)
        d = asked.distance(rows, points, a)
        inside, gap = d < radius, np.abs(d - radius)
        zero = np.zeros(len(rows))
        # The stack is last in, first out: each query's nearer side comes before its farther one.
        for side, other, mask in ((near, far, inside), (far, near, ~inside)):
            if mask.any():
                work.append((other, rows[mask], gap[mask]))
                work.append((side, rows[mask], zero[mask]))


class Cells(NamedTuple):
    """A coarse vantage-point tree of full levels: node n has the children 2n + 1 (near) and 2n + 2."""

    points: np.ndarray
    radius: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, cells: int, seed: int = 5) -> Cells:
        rng = np.random.default_rng(seed)
        points, radius = np.zeros((cells - 1, sample.shape[1])), np.zeros(cells - 1)
        held = {0: np.arange(len(sample))}
        for node in range(cells - 1):
            rows = held.pop(node)
            if len(rows):
                points[node] = sample[rows[int(rng.integers(len(rows)))]]
            d = np.sqrt(((sample[rows] - points[node]) ** 2).sum(axis=1))
            radius[node] = np.median(d) if len(rows) else 0.0
            held[2 * node + 1], held[2 * node + 2] = rows[d < radius[node]], rows[d >= radius[node]]
        return cls(points, radius)

    def place(self, points: np.ndarray) -> np.ndarray:
        node, inner_nodes = np.zeros(len(points), dtype=np.int64), len(self.radius)
        while inner_nodes and node[0] < inner_nodes:
            d = np.sqrt(((points - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + np.where(d < self.radius[node], 1, 2)
        return node - inner_nodes

    def margins(self, points: np.ndarray) -> np.ndarray:
        """Least distance of each point to what each cell may hold, by the triangle inequality."""
        square = (points**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1) - 2 * points @ self.points.T
        beyond = np.sqrt(np.maximum(square, 0)) - self.radius
        margin = np.zeros((len(points), 1))
        for level in range(len(self.radius).bit_length()):
            own = beyond[:, 2**level - 1 : 2 ** (level + 1) - 1]
            margin = np.stack([np.maximum(margin, own), np.maximum(margin, -own)], axis=2).reshape(len(points), -1)
        return margin


def _parts(batches):
    """Rows as (vec_id, d, e, size, data): length, exponent, log2 of the norm, and components over two to the exponent."""
    for batch in batches:
        column = batch.column("v")
        d = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        begin = np.r_[0, np.cumsum(d)]
        full = np.flatnonzero(d)
        most = np.zeros(len(d))
        with np.errstate(invalid="ignore"):
            most[full] = np.maximum.reduceat(np.abs(values), begin[full]) if len(full) else 0
        good = np.flatnonzero(np.isfinite(most) & (most > 0) & np.asarray(pc.is_valid(batch.column("vec_id"))))
        exponent = np.frexp(np.where(np.isfinite(most), most, 1))[1].astype(np.int64)
        with np.errstate(under="ignore"):
            values = np.ldexp(values, np.repeat(-exponent, d))
            square = np.zeros(len(d))
            square[full] = np.add.reduceat(values**2, begin[full]) if len(full) else 0
        raw = values.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(pa.array(good)),
                pa.array(d[good], pa.int32()),
                pa.array(exponent[good], pa.int32()),
                pa.array(exponent[good] + np.log2(square[good]) / 2, pa.float64()),
                pa.array([raw[8 * begin[k] : 8 * begin[k + 1]] for k in good.tolist()], pa.binary()),
            ],
            ["vec_id", "d", "e", "size", "data"],
        )


def _matrix(column: pd.Series | list, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, relax: float = 1.6, shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Nearest by inner product, ties to the smaller id. A query's candidates are all rows but its
    own. Rows of one id and one vector count once; those of one id and different vectors are
    rows of their own, with ranks of their own, and find each other. Vectors that are null, empty, all zero, or with null or non-finite
    components take no part, nor do rows with a null id. Vectors of different lengths have no
    inner product and never meet. Of equal vectors only the k + 1 smallest ids can be among the k
    nearest of any query, so only they are indexed. With fewer candidates than k, all are
    returned. A score beyond the range of double precision is infinite or zero, and ties then.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = rows.mapInArrow(_parts, "vec_id long, d int, e int, size double, data binary")
    # Rows of one id are told apart by a hash of their vector.
    good = stored(good.withColumn("row", F.xxhash64("vec_id", "e", "data")), "vectors")
    asks = F.col("vec_id") % every == 0
    whole = good.agg(F.count("*").alias("n"), F.max("e").alias("e"), F.max("size").alias("size"), F.count_if(asks).alias("q")).first()
    if not whole["n"]:
        return spark.createDataFrame([], schema)
    listed = good.groupBy("d").agg(F.count("*").alias("n"), F.max("e").alias("e"), F.max("size").alias("size")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    scale_of = {r["d"]: Scale(r["e"], float(2.0 ** (r["size"] - r["e"]))) for r in listed}
    other_scale = Scale(whole["e"], float(2.0 ** (whole["size"] - whole["e"])))

    equal = Window.partitionBy("d", "e", "data").orderBy("vec_id", "row")
    once = stored(good.distinct().withColumn("copy", F.row_number().over(equal)).filter(F.col("copy") <= k + 1).drop("copy", "size"), "distinct")

    # Coarse trees, from about SAMPLE_ROWS vectors drawn by a hash of their row.
    cells_of = {r["d"]: min(CELLS, 1 << max(0, -(-r["n"] // cell_rows) - 1).bit_length()) for r in listed}
    grown: dict[int, Cells] = {}
    if any(c > 1 for c in cells_of.values()):
        bits = 1 << 30
        drawn = once.filter(F.col("d").isin([d for d, c in cells_of.items() if c > 1]) & (F.pmod(F.xxhash64("row", F.lit(9)), F.lit(bits)) < min(bits, SAMPLE_ROWS * bits // whole["n"] + 1)))
        sample = drawn.select("d", "e", "data").toPandas()
        for d, own in sample.groupby("d"):
            points = Points.of(_matrix(own["data"], d), own["e"].to_numpy().astype(np.int64), scale_of[d])
            grown[d] = Cells.grow(points.lifted(), cells_of[d])
    grown_b = spark.sparkContext.broadcast(grown)  # at most CELLS vectors for each of at most LENGTHS lengths

    def by_length(batch):
        """Runs of rows of one length: their numbers, the length, its components and exponents."""
        d = batch.column("d").to_numpy()
        for own in np.unique(d).tolist():
            at = np.flatnonzero(d == own)
            part = batch.take(pa.array(at))
            yield at, own, _matrix(part.column("data").to_pylist(), own), part.column("e").to_numpy().astype(np.int64)

    def place(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for at, d, data, e in by_length(batch):
                if d in grown_b.value:
                    cell[at] = grown_b.value[d].place(Points.of(data, e, scale_of[d]).lifted())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    # At most LENGTHS * CELLS rows; no other length has more vectors than a listed one.
    if grown:
        placed = stored(once.mapInArrow(place, "vec_id long, d int, e int, data binary, row long, cell int"), "placed")
        count = placed.filter(F.col("d").isin(list(scale_of))).groupBy("d", "cell").count().collect()
    else:
        placed = once.withColumn("cell", F.lit(0))
        count = [{"d": r["d"], "cell": 0, "count": r["n"]} for r in listed]
    limit = lambda d: max(1, min(shard_rows, SHARD_BYTES // (8 * d)))
    shards_of = {(r["d"], r["cell"]): -(-r["count"] // limit(r["d"])) for r in count}
    shards = spark.createDataFrame([(d, c, n) for (d, c), n in shards_of.items()], "d int, cell int, shards int")
    least = listed[-1]["n"] if len(listed) == LENGTHS else 0
    other_shards = F.ceil(F.lit(float(least)) * 8 * F.col("d") / SHARD_BYTES + F.lit(least / shard_rows)).cast("int")
    with_shards = lambda df: df.join(F.broadcast(shards), ["d", "cell"], "left").withColumn("shards", F.greatest(F.lit(1), F.coalesce("shards", other_shards)))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {c: [int(pdf[c].iloc[0])] for c in ("d", "cell", "shard")}
        d = key["d"][0]
        pdf = pdf.sort_values(["vec_id", "row"])
        data, e = _matrix(pdf["data"], d), pdf["e"].to_numpy().astype(np.int64)
        order, nodes = build(Points.of(data, e, scale_of.get(d, other_scale)).lifted())
        held = (pdf["vec_id"].to_numpy()[order], pdf["row"].to_numpy()[order], e[order], data[order], nodes)
        return pd.DataFrame(key | {name: [x.tobytes()] for name, x in zip(("ids", "rows", "e", "data", "nodes"), held, strict=True)})

    shard = F.pmod(F.xxhash64("row", F.lit(3)), F.col("shards")).cast("int").alias("shard")
    trees = with_shards(placed).select("d", "cell", shard, "vec_id", "row", "e", "data").groupBy("d", "cell", "shard")
    trees = stored(trees.applyInPandas(plant, "d int, cell int, shard int, ids binary, rows binary, e binary, data binary, nodes binary"), "trees")

    # Equal queries are asked once, or once for each salt, so that their answers go to many tasks.
    salt = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(max(16, whole["q"] >> 16))).cast("int")
    queries = good.filter(asks).distinct().select("d", "e", "data", salt.alias("salt"), F.col("vec_id").alias("query_id"), F.col("row").alias("query"))

    def settle(batches):
        for batch in batches:
            home = np.zeros(batch.num_rows, dtype=np.int32)
            for at, d, data, e in by_length(batch):
                if d in grown_b.value:
                    point = np.column_stack([Asked(data, e, scale_of[d], 1, np.zeros(len(e))).point, np.zeros(len(e))])
                    home[at] = grown_b.value[d].place(point)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "cell"])

    probes = queries.select("d", "e", "data", "salt").distinct()
    probes = probes.mapInArrow(settle, "d int, e int, data binary, salt int, cell int") if grown else probes.withColumn("cell", F.lit(0))
    probes = stored(probes.withColumn("probe", F.monotonically_increasing_id()), "probes")
    # Queries of neighbouring cells go together, as they have other cells to visit in common.
    chunks, held, chunk = [], {}, 0
    for r in sorted(probes.filter(F.col("d").isin(list(scale_of))).groupBy("d", "cell").count().collect(), key=lambda r: (r["d"], r["cell"])):
        n = -(-r["count"] // CHUNK_ROWS)
        if n > 1 or held.get(r["d"], CHUNK_ROWS) + r["count"] > CHUNK_ROWS:
            chunk, held = chunk + 1, {r["d"]: 0}
        held[r["d"]] += r["count"]
        chunks.append((r["d"], r["cell"], chunk, n))
        chunk += n - 1
    chunks = spark.createDataFrame(chunks, "d int, cell int, chunk int, chunks int")
    part = F.pmod(F.xxhash64("probe", F.lit(6)), F.coalesce("chunks", F.lit(max(1, -(-whole["q"] // (LENGTHS * CHUNK_ROWS)))))).cast("int")
    probes = stored(probes.join(F.broadcast(chunks), ["d", "cell"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)) + part).drop("chunks"), "chunks")

    def walk(tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(tree):
            return pd.DataFrame({"probe": [], "vec_id": [], "row": [], "score": []})
        t = tree.iloc[0]
        d = int(t["d"])
        scale = scale_of.get(d, other_scale)
        ids, numbers, e = (np.frombuffer(t[c], np.int64) for c in ("ids", "rows", "e"))
        points = Points.of(_matrix([t["data"]], d), e, scale)
        own = Asked(_matrix(asked["data"], d), asked["e"].to_numpy().astype(np.int64), scale, k + 1, asked["floor"].to_numpy())
        search(np.frombuffer(t["nodes"], NODE), points, ids, numbers, own, relax)
        q, c = np.nonzero(own.id != _NONE)
        return pd.DataFrame({"probe": asked["probe"].to_numpy()[q], "vec_id": own.id[q, c], "row": own.row[q, c], "score": own.score[q, c]})

    place_key = ["d", "cell", "shard"]

    def visit(visits: DataFrame) -> DataFrame:
        """What the probes find in all shards of the cells they visit; a tree goes only where it is asked."""
        visits = with_shards(visits).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        needed = trees.join(visits.select(*place_key, F.col("chunk").alias("asked")).distinct().hint("shuffle_hash"), place_key)
        return needed.groupBy(*place_key, "asked").cogroup(visits.groupBy(*place_key, "chunk")).applyInPandas(walk, "probe long, vec_id long, row long, score double")

    lowest = F.lit(float("-inf"))
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id", "row")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    found = ranked(visit(probes.select("d", "cell", "chunk", "probe", "e", "data", lowest.alias("floor"))))
    if grown:
        found = stored(found, "home")

        def route(batches):
            for batch in batches:
                rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
                home, floor = batch.column("cell").to_numpy(), batch.column("floor").to_numpy()
                for at, d, data, e in by_length(batch):
                    if d not in grown_b.value:
                        continue
                    own = Asked(data, e, scale_of[d], 1, floor[at])
                    margin = grown_b.value[d].margins(np.column_stack([own.point, np.zeros(len(at))]))
                    wanted = relax * (margin - SLACK * scale_of[d].longest) <= own.radius(np.arange(len(at)))[:, None]
                    wanted[np.arange(len(at)), home[at]] = False
                    q, c = np.nonzero(wanted)
                    rows.append(at[q])
                    cells.append(c.astype(np.int32))
                out = batch.take(pa.array(np.concatenate(rows)))
                names = ["d", "chunk", "probe", "e", "data", "floor"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), *(out.column(c) for c in names)], ["cell", *names])

        floors = found.filter(F.col("rank") == k + 1).select("probe", F.col("score").alias("floor"))
        going = probes.join(floors, "probe", "left").select("d", "cell", "chunk", "probe", "e", "data", F.coalesce("floor", lowest).alias("floor"))
        away = visit(stored(going.mapInArrow(route, "cell int, d int, chunk int, probe long, e int, data binary, floor double"), "visits"))
        found = ranked(found.drop("rank").unionByName(away))
    answers = queries.join(probes.select("d", "e", "data", "salt", "probe"), ["d", "e", "data", "salt"]).select("query", "query_id", "probe")
    answers = answers.join(found.drop("rank"), "probe").filter("query_id <> vec_id or query <> row")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "row")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
