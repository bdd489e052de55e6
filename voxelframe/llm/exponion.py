"""Centroid clustering by exponion search.

Lloyd's rounds over whole-number vectors. A vector carries its centroid, an upper bound of the
distance to it and a lower bound of the distance to any other; how far the centroids moved
widens the two. Where they still part, nothing is computed. Else the distance to the own
centroid is taken, and if that isn't enough, only the centroids of a ball around it are looked
at: those within twice that distance and the distance to the centroid's nearest other one, which
hold the vector's two nearest. Each centroid's list of the others, sorted by distance, gives the
ball as a prefix; prefixes are rounded up to powers of two, so that vectors of one centroid and
prefix are measured together. The radius is inclusive and bounds are widened by what doubles may
lose, so that all ties are seen, and distances themselves are whole numbers.

Every round is one pass: it reads the vectors with their bounds, and writes them with new ones
beside the sums of each task's clusters. No vector is shuffled, and only sums of at most
centroids times components come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import forget, fresh_dir, stored

#: Components of larger size could give distances that no long holds.
LARGEST = 1 << 27
#: Products of components up to this size add up exactly in doubles.
PLAIN_LARGEST = 1 << 20
#: Vectors measured at once.
ROWS = 1 << 14
#: What bounds are widened by, relatively: far more than a root and a few sums can lose.
SLACK = 1e-9

SCHEMA = "part string, vec_id long, v array<int>, cluster int, upper double, lower double, distance long, n long, sums array<long>"
PARTS = ("vectors", "sums")


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each row of ``c``, exact as long integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= PLAIN_LARGEST:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for k, row in enumerate(c):
        gap = x - row
        out[:, k] = (gap * gap).sum(1)
    return out


class Centroids:
    """Centroids, each one's list of the others by distance, and how far all moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        k = len(now)
        apart = np.sqrt(squares(now, now).astype(np.float64))
        self.order = np.argsort(apart, axis=1, kind="stable")  # a centroid may stand where others do
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        others = apart + np.diag(np.full(k, np.inf))
        self.nearest = others.min(axis=1)
        moved = np.zeros(k) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.moved = moved
        # The farthest that any other centroid moved.
        most = np.sort(moved)
        self.others_moved = np.where(moved == most[-1], most[-2] if k > 1 else 0.0, most[-1])


def two_nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of the centroids ``among`` to each row (ties: the smaller number), its squared distance, and the second one's."""
    among = np.sort(among)
    d = squares(x, centroids[among])
    at = d.argmin(axis=1)
    row = np.arange(len(x))
    best = d[row, at]
    if len(among) == 1:
        return among[at], best, np.full(len(x), -1)
    d[row, at] = np.iinfo(np.int64).max
    return among[at], best, d.min(axis=1)


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New clusters and bounds of the rows; ``cluster`` is -1 where a row has none yet."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    everything = np.arange(len(c.now))

    def settle(rows: np.ndarray, among: np.ndarray) -> None:
        for a in range(0, len(rows), ROWS):
            own = rows[a : a + ROWS]
            at, best, second = two_nearest(x[own], c.now, among)
            cluster[own] = at
            upper[own] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
            lower[own] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(np.float64)) * (1 - SLACK))

    new = np.flatnonzero(cluster < 0)
    old = np.flatnonzero(cluster >= 0)
    upper[old] += c.moved[cluster[old]]
    lower[old] -= c.others_moved[cluster[old]]
    # Strictly nearer than half way to the nearest other centroid, or than the lower bound, leaves no tie.
    parting = np.maximum(lower, np.where(cluster >= 0, c.nearest[cluster] / 2 * (1 - SLACK), 0))
    open_ = old[upper[old] >= parting[old]]
    exact = np.empty(len(open_), dtype=np.int64)
    for a in range(0, len(open_), ROWS):
        own = open_[a : a + ROWS]
        gap = x[own] - c.now[cluster[own]]
        exact[a : a + ROWS] = (gap * gap).sum(1)
    upper[open_] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    open_ = open_[upper[open_] >= parting[open_]]
    for k in np.unique(cluster[open_]).tolist():
        rows = open_[cluster[open_] == k]
        radius = (2 * upper[rows] + c.nearest[k]) * (1 + SLACK)
        held = np.searchsorted(c.apart[k], radius, side="right")
        held = np.minimum(1 << np.ceil(np.log2(np.maximum(held, 2))).astype(np.int64), len(everything))
        for m in np.unique(held).tolist():
            settle(rows[held == m], c.order[k, :m])
    settle(new, everything)
    return cluster, upper, lower


def _whole(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, v): the vectors of ``size`` finite components, as whole numbers."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") == size) & F.forall("embedding", lambda e: F.coalesce(F.abs(e.cast("double")) * 256 <= float(LARGEST), F.lit(False)))
    # Null, NaN and infinite components are none of those up to the largest: NaN is greater than all.
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(fine).select("vec_id", x.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:vec_id``; those of null ids come last, those of equal ids by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], dtype=np.int64)


def _pass(state: DataFrame, centroids: Centroids, final: bool, path: str) -> DataFrame:
    """One assignment of all vectors, written with the sums of each task's clusters."""
    spark = state.sparkSession
    held = spark.sparkContext.broadcast(centroids)  # k times k, and k vectors
    k, d = centroids.now.shape

    def run(batches):
        c = held.value
        sums, count = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v")
            x = np.asarray(v.flatten()).reshape(n, d).astype(np.int64)
            given = lambda name: np.asarray(batch.column(name))
            cluster, upper, lower = assign(x, c, given("cluster"), given("upper"), given("lower"))
            gap = x - c.now[cluster] if final else None
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([PARTS[0]] * n), batch.column("vec_id"), v, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)]
                + [pa.array((gap * gap).sum(1)) if final else none, none, pa.nulls(n, pa.list_(pa.int64()))],
                names,
            )
            order = np.argsort(cluster, kind="stable")
            own, first = np.unique(cluster[order], return_index=True)
            sums[own] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        if len(used) and not final:
            m = len(used)
            empty = [pa.nulls(m, t) for t in (pa.int64(), pa.list_(pa.int32()))]
            gone = [pa.nulls(m, t) for t in (pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([PARTS[1]] * m), *empty, pa.array(used.astype(np.int32)), *gone, pa.array(count[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                names,
            )

    names = ["part", "vec_id", "v", "cluster", "upper", "lower", "distance", "n", "sums"]
    return stored(state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, SCHEMA), "round", "part", path=path)


def moved(written: DataFrame, now: np.ndarray) -> np.ndarray:
    """The centroids' next places: exact floors of the means; a cluster without vectors stays."""
    sums = written.filter(F.col("part") == PARTS[1]).select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = now.copy()
    for r in sums.groupBy("cluster", "at").agg(whole("n").alias("n"), whole("x").alias("x")).collect():  # centroids times components
        out[r["cluster"], r["at"]] = int(r["x"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Takes part: vectors of exactly ``size`` components, none null, NaN or infinite; their
    components become floor(256 * x). Components beyond ``LARGEST`` in size have distances that
    don't fit a long, so their vectors take no part either. Rows of one vec_id, or none, are
    vectors of their own. Fewer vectors than ``k`` are a centroid each, and none give no rows.
    Equal centroids keep their numbers; ties go to the smaller. An inertia that doesn't fit a
    long is null. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    last = fresh_dir(spark, "vectors")
    start = stored(_whole(vectors, size), "vectors", path=last)
    now, before = first_centroids(start, k, seed), None
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = start.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    for n in range(rounds):
        path = fresh_dir(spark, f"round{n}")
        written = _pass(state, Centroids(now, before), False, path)
        now, before = moved(written, now), now
        state = written.filter(F.col("part") == PARTS[0])
        forget(spark, last)  # what has been read is written anew
        last = path
    found = _pass(state, Centroids(now, before), True, fresh_dir(spark, "clusters")).filter(F.col("part") == PARTS[0])
    forget(spark, last)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    of = {r["cluster"]: int(r["own"]) for r in sums.collect()}  # k rows
    long = lambda n: n if n < 1 << 63 else None
    rows = [(c, long(n), long(sum(of.values())), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, n in of.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> str:
    """The same in SQL: all distances in every round."""
    gap = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    nearest = f"SELECT v.vec_id, v.r, min(struct_pack(d := {gap}, c := c.c)) AS best FROM v, c{{}} c GROUP BY 1, 2"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(n)})")
        steps.append(
            f"m{n} AS MATERIALIZED (SELECT c, list(CAST(floor_of AS BIGINT) ORDER BY i) AS x FROM (SELECT best.c AS c, i, CASE WHEN sum(e) % count(*) < 0 THEN sum(e) // count(*) - 1 ELSE sum(e) // count(*) END AS floor_of "
            f"FROM (SELECT a.best, generate_subscripts(v.x, 1) AS i, unnest(v.x) AS e FROM a{n} a JOIN v USING (r)) GROUP BY 1, 2) GROUP BY c)"
        )
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (c))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: isfinite(e) AND abs(256 * CAST(e AS DOUBLE)) <= {LARGEST})) = {size}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x LIMIT {k}
), {", ".join(steps)}, f AS MATERIALIZED ({nearest.format(rounds)})
SELECT f.vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.c = best.c"""
