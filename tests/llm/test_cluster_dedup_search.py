"""Exponion clusters, streaming deduplication and ranked lexical search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelframe.llm import exponion, lexical, streamdedup
from voxelframe.llm.common import lower_az


# ---- clusters


def lloyd(rows, k, rounds, seed):
    """Every distance in every round, in whole numbers of Python."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    now = [v for _, v in sorted(kept, key=mark)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(now)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == n]
            if mine:
                now[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [near(v) for _, v in kept]
    total = Counter()
    for d, c in found:
        total[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i if i is not None else -1, c, d, total[c], total.total(), sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True)))


def clusters(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, v int") if rows else spark.createDataFrame([], "vec_id long, embedding array<double>, cluster string, v int")
    return sorted(tuple(x if x is not None else -1 for x in r) for r in exponion.cluster(df, **how).collect())


def test_clusters_are_those_of_all_distances(spark):
    rng = np.random.default_rng(3)
    # Whole grid points, so that many distances tie, copies, and groups far apart.
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4) + 40 * (i % 4)]) for i in range(400)] + [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(400, 520)]
    got = clusters(spark, [(i, v, "c", 1) for i, v in rows], k=12, rounds=4, size=4, seed=2)
    assert got == lloyd(rows, 12, 4, 2)


def test_vectors_that_take_no_part_and_odd_ids(spark):
    good = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [0.1, 7.0]), (None, [-3.0, 0.0]), (7, [0.0, 0.0])]
    bad = [(2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (8, [1e300, 0.0]), (9, []), (10, [1.0, 2.0, 3.0])]
    rows = [(i, v, "x", 0) for i, v in good + bad]
    for k in (2, 40):
        assert clusters(spark, rows, k=k, rounds=5, size=2, seed=2) == lloyd(good, k, 5, 2)
    assert clusters(spark, [], k=3, rounds=2, size=2) == []
    assert clusters(spark, [(i, v, "x", 0) for i, v in bad], k=3, rounds=2, size=2) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.booleans())
def test_bounds_never_change_an_assignment(seed, k, large):
    rng = np.random.default_rng(seed)
    spread = exponion.LARGEST if large else 6
    x = rng.integers(-spread, spread + 1, (60, 3))
    now, before = x[:k].copy(), None
    cluster, upper, lower = np.full(60, -1), np.zeros(60), np.zeros(60)
    for _ in range(6):
        c = exponion.Centroids(now, before)
        cluster, upper, lower = exponion.assign(x, c, cluster, upper, lower)
        d = ((x[:, None] - now[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        assert (upper * (1 + 1e-12) >= np.sqrt(d.min(1))).all()
        before, now = now, now.copy()
        for n in range(k):
            if (cluster == n).any():
                now[n] = x[cluster == n].sum(0) // (cluster == n).sum()


def test_most_distances_are_skipped(monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 30, (3000, 8)) + 2000 * rng.integers(0, 10, (3000, 1))).astype(np.int64)
    now, before = x[:40].copy(), None
    cluster, upper, lower = np.full(3000, -1), np.zeros(3000), np.zeros(3000)
    looked = []
    real = exponion.squares
    monkeypatch.setattr(exponion, "squares", lambda a, b: looked.append(len(a) * len(b)) or real(a, b))
    for _ in range(6):
        cluster, upper, lower = exponion.assign(x, exponion.Centroids(now, before), cluster, upper, lower)
        before, now = now, np.array([x[cluster == n].sum(0) // max(1, (cluster == n).sum()) if (cluster == n).any() else now[n] for n in range(40)])
    assert sum(looked) < 0.5 * 6 * 3000 * 40


# ---- streaming deduplication

DOCS = "doc_id long, text string, digest string, at int, _metadata string"


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lower_az(text or ""), []).append(doc)
    best = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    return Counter((d, best[lower_az(t or "")], len(groups[lower_az(t or "")]), hashlib.sha256(lower_az(t or "").encode()).hexdigest()) for d, t in rows)


def check_dedup(found, rows):
    out = found.collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == expected(rows)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in out}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


ROWS = [(1, "A b"), (2, "a B"), (2, "a B"), (3, None), (4, ""), (None, "ä"), (None, "ä"), (5, "Ä"), (6, "x" * 300_000), (7, "X" * 300_000), (8, "solo"), (None, "a b")] + [(k, "hot") for k in range(20, 320)]


def write(spark, rows, path, mode="append", n=3):
    spark.createDataFrame([(d, t, "x", 1, "m") for d, t in rows], DOCS).repartition(n).write.mode(mode).parquet(path)


@pytest.mark.parametrize("bits", [256, 4])
def test_dedup_with_nulls_copies_and_colliding_digests(spark, tmp_path, bits):
    path = str(tmp_path / "documents.parquet")
    write(spark, ROWS, path)
    check_dedup(streamdedup.deduplicate(spark, path, digest_bits=bits), ROWS)


def test_dedup_of_one_file_and_of_none(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    one = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [d for d, _ in ROWS], "text": [t for _, t in ROWS]}), one)
    check_dedup(streamdedup.deduplicate(spark, one), ROWS)
    none = str(tmp_path / "none.parquet")
    spark.createDataFrame([], DOCS).write.parquet(none)
    assert streamdedup.deduplicate(spark, none).collect() == []


def test_state_lives_on_between_runs_and_batches(spark, tmp_path):
    path, home = str(tmp_path / "documents.parquet"), str(tmp_path / "home")
    settings = {k: spark.conf.get(k, None) for k in streamdedup.STATE}
    write(spark, ROWS[:6], path, n=2)
    check_dedup(streamdedup.deduplicate(spark, path, home, batch_bytes=1), ROWS[:6])
    write(spark, ROWS[6:], path, n=3)
    check_dedup(streamdedup.deduplicate(spark, path, home, batch_bytes=1), ROWS)
    # Nothing new: nothing changes, and no arrival is counted twice.
    check_dedup(streamdedup.deduplicate(spark, path, home, batch_bytes=1), ROWS)
    batches = {r["batch"] for r in spark.read.parquet(f"{home}/groups").select("batch").distinct().collect()}
    assert len(batches) > 3
    assert settings == {k: spark.conf.get(k, None) for k in streamdedup.STATE}


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    path, home = str(tmp_path / "documents.parquet"), str(tmp_path / "home")
    write(spark, ROWS, path)
    real, calls = streamdedup._run, []

    def dies(writer, checkpoint):
        calls.append(checkpoint)
        if len(calls) == 2:
            raise OSError("lost")
        real(writer, checkpoint)

    monkeypatch.setattr(streamdedup, "_run", dies)
    with pytest.raises(OSError):
        streamdedup.ingest(spark, path, home)
    check_dedup(streamdedup.deduplicate(spark, path, home), ROWS)


# ---- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    split = lambda t: TERM.findall(lower_az(t or ""))
    held = [(d, Counter(c), len(c)) for d, c in ((d, split(t)) for d, t in docs) if c]
    n, total = len(held), sum(s for _, _, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(split(text))
        scores = []
        for d, c, s in held:
            m = 75 + (25 * s * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d if d is not None else 0))
        out += [(item, r, None if none else d, -score) for r, (score, none, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(spark, docs, items, k):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, terms string").repartition(3) if docs else spark.createDataFrame([], "doc_id long, text string, row int, terms string")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, row int") if items else spark.createDataFrame([], "item_id long, text string, row int")
    return Counter(tuple(r) for r in lexical.search(d, i, k).collect())


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["ÄÖ", "語", "A1"]
    text = lambda most: " ".join(words[int(min(len(words) - 1, rng.zipf(1.4)))] + rng.choice(["", ".", ", x", "\x7f"]) for _ in range(int(rng.integers(0, most))))
    docs = [(k, text(80)) for k in range(n)]
    return docs, [(k, text(30)) for k in range(12)]


def test_search_is_that_of_all_scores(spark, monkeypatch):
    docs, items = corpus(1, 400)
    docs += [(1000 + k, docs[5][1]) for k in range(90)] + [(7, "w1 w2"), (7, "w1 w2"), (None, docs[5][1]), (None, "w3"), (9, None), (10, ""), (11, ".,;"), (12, "w1 " * 60_000 + "w9")]
    items += [(3, "w1 w1 W1 w2"), (3, "w1 w1 W1 w2"), (None, "w5 w9"), (50, None), (51, ""), (52, "notthere"), (53, "w1")]
    want = ranked(docs, items, 5)
    assert found(spark, docs, items, 5) == want
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 100)
    assert found(spark, docs, items, 5) == want


def test_search_of_nothing(spark):
    assert found(spark, [], [(1, "a")], 3) == Counter()
    assert found(spark, [(1, "a")], [], 3) == Counter()
    assert found(spark, [(1, None), (2, "..")], [(1, "a")], 3) == Counter()
    assert found(spark, [(1, "a"), (2, "b")], [(1, None), (2, "--")], 3) == Counter()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_bytes_bound_scores_on_both_sides(seed):
    docs, items = corpus(seed, 30)
    counts = [c for c in (Counter(lexical.split(t.encode())) for _, t in docs) if c]
    n, total = len(counts), sum(c.total() for c in counts)
    batch = lexical.pack(list(range(n)), counts, n, total)
    block = lexical.Block([t.encode() for _, t in items])
    df = Counter(t for c in counts for t in c)
    block.weigh({k: df[t] for k, t in enumerate(block.terms)}, n)
    shard = lexical.Shard({name: batch.column(name)[0] for name in batch.schema.names}, block, True)
    longer = lexical.spread(shard.sizes, n, total)
    for terms, times in block.asked:
        high, low = shard.bounds(*shard.postings(terms, times, block.weight))
        for d, c in enumerate(counts):
            score = sum(int(q) * int(block.weight[t]) * ((10**9 * c[block.terms[t]]) // (1000 * c[block.terms[t]] + int(longer[d]))) for t, q in zip(terms, times, strict=True) if c[block.terms[t]])
            if d < shard.n:
                assert low[d] <= score <= high[d]
            else:
                assert score == 0


def test_few_looks_and_few_scores_where_nothing_is_ruled_out(monkeypatch):
    """Vectors without structure: time went with leaves of 128, and all of a query's first leaf was scored and sorted."""
    from voxelframe.llm import vptree

    rng = np.random.default_rng(7)
    data = rng.normal(size=(8000, 32))
    data[4000:4030] = data[0]  # more ties than are asked for
    ids, e, k = np.arange(len(data)), np.zeros(len(data), dtype=np.int64), 21
    scale = vptree.Scale(0, float(np.linalg.norm(data, axis=1).max()))
    order, nodes = vptree.build(vptree.Points.of(data, e, scale).lifted())
    asked = vptree.Asked(data[::40], e[::40], scale, k, np.full(200, -np.inf))
    looks, scored, offer, scores = [], [], vptree.Asked.offer, vptree.scores
    monkeypatch.setattr(vptree.Asked, "offer", lambda self, *given: (looks.append(given[-1] - given[-2]), offer(self, *given)))
    monkeypatch.setattr(vptree, "scores", lambda a, *given: (scored.append(len(a)), scores(a, *given))[1])
    vptree.search(nodes, vptree.Points.of(data[order], e, scale), order, order, asked, 1.0)
    exact = np.stack([vptree.inner(np.repeat(data[[q]], len(data), axis=0), data) for q in range(0, 8000, 40)])
    want = np.stack([np.lexsort((ids, -row))[:k] for row in exact])
    assert (asked.id == want).all()
    assert len(looks) < 60 and sum(scored) < 200 * 5 * k


def test_search_takes_few_shards_at_once(spark, monkeypatch):
    """Row groups and batches of a task with many shards: one group held them all, whatever their bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, groups = spark.conf.get(key), {}, []
    write = lexical.stored

    def stored(df, name, *parts, **options):
        seen[name] = int(spark.conf.get(key))
        out = write(df, name, *parts, **options)
        if name == "index":
            for file in out.inputFiles():
                held = pq.ParquetFile(file.removeprefix("file://")).metadata
                groups.extend(held.row_group(i).num_rows for i in range(held.num_row_groups))
        return out

    monkeypatch.setattr(lexical, "stored", stored)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 1)
    docs = spark.createDataFrame([(k, f"a b{k % 7} c{k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "b3 c5"), (2, "a")], "item_id long, text string")
    out = [tuple(r)[:3] for r in lexical.search(docs, items, 3).orderBy("item_id", "rank").collect()]
    assert out == [(1, 1, 5), (1, 2, 3), (1, 3, 10), (2, 1, 0), (2, 2, 1), (2, 3, 2)]
    assert sum(groups) == 40 and max(groups) <= lexical.SHARDS_AT_ONCE
    assert seen["index"] <= lexical.DOCS_AT_ONCE and seen["found"] <= lexical.SHARDS_AT_ONCE
    assert spark.conf.get(key) == before
