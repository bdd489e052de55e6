"""Joins, search, scoring, sharding and the pipeline against brute force."""

import collections
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from voxelframe.llm import decontam, graph, jaccard, lattice, piece, queries, shard, vptree  # noqa: E402

SF = "/root/testdata/sf0.001"
MODEL = queries.tokenizer_bytes()
AZ = {c: c + 32 for c in range(65, 91)}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_groups(rows, n, percent):
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def edited_corpus(seed, families=25, most=14):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "and"] + ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    common = rng.choices(vocabulary, k=30)
    rows = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 6, 12, 40, 120]))
        if rng.random() < 0.5:
            base = base + common
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
            base = own if rng.random() < 0.5 else base
    rng.shuffle(rows)
    return [(k * 3 + 1, t.upper() if k % 7 == 0 else t.replace(" ", " \n") if k % 5 == 0 else t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(
    "seed, n, percent, large, rounds, listed",
    [(1, 3, 90, 10**6, 6, False), (1, 3, 90, 10**6, 6, True), (2, 3, 90, 150, 6, False), (3, 5, 80, 10**6, 6, True), (4, 2, 60, 60, 2, False), (5, 3, 80, 20, 1, True)],
)
def test_near_groups(spark, monkeypatch, seed, n, percent, large, rounds, listed):
    if listed:  # any list of frequent shingles gives the same result
        every = jaccard._order_rows(n, 2**63, percent)
        monkeypatch.setattr(jaccard, "frequent_shingles", lambda docs, rows, total: [r["h"] for r in docs.mapInArrow(every, "h long, mark long, n int").select("h").distinct().filter("h % 3 = 0").collect()])
    monkeypatch.setattr(jaccard, "LARGE_REGION", large)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = [*edited_corpus(seed), (1000, None), (1003, ""), (1006, " \n")]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(documents(spark, rows), n, percent).collect()}
    assert out == brute_groups(rows, n, percent)


def test_near_groups_of_repeated_ids(spark):
    """One doc_id on several texts, and rows that are there twice."""
    a = [f"w{k}" for k in range(60)]
    b = [f"v{k}" for k in range(60)]
    c = [f"u{k}" for k in range(60)]
    text = lambda w, k=None: " ".join(w if k is None else [*w[:k], "x", *w[k + 1 :]])
    rows = [(1, text(a)), (1, text(b)), (2, text(a, 59)), (3, text(b, 59)), (3, text(b, 59)), (7, text(c)), (7, text(b, 0)), (9, text(c, 59)), (5, None), (5, "x y"), (4, "x y")]
    out = collections.Counter(tuple(r) for r in jaccard.near_groups(documents(spark, rows), 3, 90).collect())
    want = [(1, 58, 1), (1, 58, 1), (2, 58, 1), (3, 58, 1), (3, 58, 1), (7, 58, 7), (7, 58, 1), (9, 58, 7), (5, 0, 5), (5, 1, 4), (4, 1, 4)]
    assert out == collections.Counter(want)


def brute_links(links, nodes):
    root = {k: k for k in nodes}
    for u, v in links:
        a, b = root[u], root[v]
        root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("own, most", [(40, 0), (2, 20)])
def test_no_region_is_one_tasks_work(spark, monkeypatch, own, most):
    """A template of 60 shingles shared by 200 documents, two of which are near copies; few or many own shingles."""
    rng = np.random.default_rng(own)
    sets = [np.unique(np.r_[np.arange(60), rng.integers(10**6, 10**9, own)]).astype(np.uint64) for _ in range(200)]
    sets[150] = np.sort(np.r_[sets[7][:-1], np.uint64(10**10)])
    monkeypatch.setattr(jaccard, "LARGE_REGION", 1500)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    rows = spark.createDataFrame([(0, k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "pivot long, node long, shingles binary")
    links, rest = jaccard.shrink_regions(rows, 96)
    found = [tuple(r) for part in links for r in part.collect()]
    groups = collections.defaultdict(list)
    for r in rest.collect():
        groups[r["pivot"], r["band"], r["part"]].append((r["node"], np.frombuffer(r["shingles"], np.uint64)))
    assert all(sum(len(s) for _, s in g) <= 2250 for g in groups.values())  # the blocks' chance of being uneven
    for g in groups.values():
        found += jaccard.join_region(np.array([k for k, _ in g]), [s for _, s in g], 96)
    want = brute_groups_of_sets(sets, 96)
    assert [brute_links(found, range(200))[k] for k in range(200)] == want and want[150] == 7
    assert len(groups) >= most


def test_frequent_shingles(spark):
    rows = [(k, f"one two three {k} {k + 1} {k + 2}") for k in range(300)]
    docs = documents(spark, rows)
    found = jaccard.frequent_shingles(docs, jaccard._order_rows(3, 2**63, 90), 300)
    assert len(found) == 1


def test_pipeline_stages_take_clashing_columns(spark):
    import corpus_pipeline

    names = "score predicted toxic n_tokens h mark n node pivot component_id distance end item_id decoded part".split()
    rows = [(k, t, "en", "s", 1, *range(len(names))) for k, t in enumerate(["a b c d e f", "a b c d e f", None, "", "x " * 3000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in names))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "sentencepiece":
            assert docs.columns == before.columns
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == ({0, 1, 2, 3, 4} if name == "toxicity" else {0, 2, 3, 4})
        assert stage(spark, before.limit(0), SF).count() == 0


def test_near_copies_are_dropped_by_row(spark):
    import corpus_pipeline

    a, b, c, d = ("".join(f"{x}{k} " for k in range(20)) for x in "abcd")
    rows = [(5, a), (5, a), (None, a), (3, b), (7, b + "more"), (7, c), (None, d), (None, d), (9, None), (9, None), (None, "")]
    out = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SF)
    assert out.columns == ["doc_id", "text"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(5, a), (3, b), (7, c), (None, d), (9, None), (9, None), (None, "")], key=repr)


def test_near_groups_of_repeated_and_no_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "A B C D"), (None, "a b c d"), (9, "q")]
    out = sorted(jaccard.near_groups(documents(spark, rows)).collect(), key=lambda r: (r["doc_id"] or -1))
    assert [(r["doc_id"], r["component_id"]) for r in out] == [(None, 2), (2, 2), (5, 2), (5, 2), (9, 9)]
    assert jaccard.near_groups(documents(spark, []), 3, 90).count() == 0


def test_join_region_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(25):
            s = set(base.tolist())
            for x in rng.choice(400, rng.integers(0, 12)).tolist():
                s ^= {x}
            sets.append(np.array(sorted(s), dtype=np.uint64))
        percent = int(rng.integers(70, 95))
        links = jaccard.join_region(np.arange(25), sets, percent)
        want = brute_groups_of_sets(sets, percent)
        root = dict(links)
        assert [root.get(k, k) for k in range(25)] == want


def variants(count, seed, shingles, least=0.0, most=0.4):
    """Sets that differ from one base in these parts; some link with it, some with one another, some with none."""
    rng = np.random.default_rng(seed)
    sets = []
    for k in range(count):
        own = rng.integers(10**6, 10**12, int(shingles * rng.uniform(least, most)))
        sets.append(np.unique(np.r_[rng.choice(shingles, shingles - len(own), replace=False), own]).astype(np.uint64))
        if k % 50 == 49:
            sets[-1] = np.r_[sets[-2][:-2], np.uint64(10**13 + k)]
    return sets


def test_join_region_measures_a_document_once():
    """The work on a group of near copies doesn't grow with its cube: these took 50 seconds."""
    sets = variants(2000, 3, 300, 0.05, 0.12)
    began = time.perf_counter()
    links = jaccard.join_region(np.arange(2000), sets, 80)
    assert time.perf_counter() - began < 10
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(2000), size)
    wide = np.flatnonzero(np.bincount(code) > 1)
    place = np.full(code.max() + 1, -1)
    place[wide] = np.arange(len(wide))
    held = np.zeros((2000, len(wide)))
    held[owner[place[code] >= 0], place[code[place[code] >= 0]]] = 1
    both = held @ held.T
    near = 100 * both >= 80 * (size[:, None] + size - both)
    root = np.arange(2000)
    for _ in range(100):
        least = np.where(near, root, 2000).min(axis=1)
        if (least >= root).all():
            break
        root = np.minimum(root, least)
    out = dict(links)
    assert [out.get(k, k) for k in range(2000)] == root.tolist()
    assert 200 < len(links) < 1800


@pytest.mark.parametrize("matrix, cells", [(1, 1), (4000, 700), (1 << 24, 40)])
def test_join_region_in_small_steps(monkeypatch, matrix, cells):
    """Few or no shingles as columns, and a few documents at a time."""
    monkeypatch.setattr(jaccard, "MATRIX", matrix)
    monkeypatch.setattr(jaccard, "BLOCK_CELLS", cells)
    for percent in (70, 80, 90):
        sets = variants(120, percent, 60) + variants(60, percent + 1, 40)
        root = dict(jaccard.join_region(np.arange(180), sets, percent))
        assert [root.get(k, k) for k in range(180)] == brute_groups_of_sets(sets, percent)


def test_regions_are_dealt_by_documents_too(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE_DOCS", 20)
    sets = [np.r_[np.arange(8), 100 + k // 2].astype(np.uint64) for k in range(90)]
    rows = spark.createDataFrame([(0, -1, k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "pivot long, band int, node long, shingles binary")
    groups = collections.defaultdict(list)
    for r in jaccard.in_blocks(rows).collect():
        groups[r["part"]].append(r["node"])
    assert len(groups) > 1 and max(map(len, groups.values())) <= 40
    assert {(a, b) for g in groups.values() for a in g for b in g} == {(a, b) for a in range(90) for b in range(90)}


def brute_groups_of_sets(sets, percent):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(200 + k, 201 + k) for k in range(40)]
    root = list(range(300))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {k: root[k] for pair in links for k in pair if pair[0] != pair[1] or root.count(root[k]) > 1}


def levenshtein_inside(item, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_best_match_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        item = bytes(rng.choices(b"abc", k=rng.randint(1, 20)))
        text = bytes(rng.choices(b"abc", k=rng.randint(0, 40)))
        assert decontam.best_match(item, text)[0] == levenshtein_inside(item, text)


def corpus_with_leaks(edits):
    rng = random.Random(edits)
    vocabulary = ["of", "the", "and", "is"] + ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(12, 40)))) for k in range(40)]
    rows, leaks = [], set()
    for k in range(160):
        words = rng.choices(vocabulary, k=rng.randint(0, 300))
        if k % 2:
            i = rng.randrange(40)
            text = bytearray(items[i][1].encode())
            for _ in range(int(edits * len(text))):
                text[rng.randrange(len(text))] = rng.choice(b"abcdefghij ")
            at = rng.randint(0, len(words))
            words[at:at] = ["\n" + text.decode().upper() + " !"]
            leaks.add((k, i))
        rows.append((k, " ".join(words)))
    return rows, items, leaks


@pytest.mark.parametrize("edits, least", [(0.0, 1.0), (0.05, 0.97), (0.1, 0.93)])
def test_decontamination_recall(spark, edits, least):
    rows, items, leaks = corpus_with_leaks(edits)
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "of the")], "item_id long, text string")
    found = decontam.contaminated(documents(spark, [*rows, (500, None), (501, "")]), benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(leaks & pairs) >= least * len(leaks)
    texts, item_texts = dict(rows), dict(items)
    for r in found:  # what is reported is true, and its distance exact or larger by no more than the margin leaves out
        item, text = decontam.normal(item_texts[r["item_id"]]), decontam.normal(texts[r["doc_id"]])
        assert levenshtein_inside(item, text) <= r["distance"] <= 0.2 * len(item)
    assert all(k % 2 for k, i in pairs if i != 92)
    # A short item is found wherever it stands from word to word.
    assert {k for k, i in pairs if i == 92} == {k for k, t in rows if " of the " in f" {decontam.normal(t).decode()} "}
    leaked = rows[min(leaks)[0]]
    kept = [r["doc_id"] for r in decontam.clean(documents(spark, [*rows, (500, None), (None, "x"), (None, leaked[1]), leaked]), benchmark).collect()]
    assert sorted(kept, key=str) == sorted([*(k for k, _ in rows if (k not in {d for d, _ in pairs})), 500, None], key=str)


@pytest.mark.parametrize("edits", [0.1, 0.15, 0.2])
def test_decontamination_recall_at_the_least_similarity(edits):
    """Bytes replaced, dropped and put in, in passages within invented prose of the items' own words."""
    rng, numbers = random.Random(7), np.random.default_rng(7)
    vocabulary = ["of", "the", "and", "is"] + ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60))).encode()) for k in range(60)]
    index = decontam.Index(items, 0.8, 0.95)
    texts, want = [], []
    for k in range(400):
        item = items[k % 60][1]
        copy = decontam.edited(item, int(edits * len(item)), numbers).decode()
        texts.append(f"{' '.join(rng.choices(vocabulary, k=rng.randint(0, 200)))} {copy} {' '.join(rng.choices(vocabulary, k=200))}")
        want.append(k % 60)
    found = {(t, index.ids[i][0]): d for t, i, d, _ in index.search(pa.array(texts))}
    hits = sum((t, i) in found for t, i in enumerate(want))
    assert hits >= 0.9 * len(want)
    assert len(found) == hits
    for (t, i), d in list(found.items())[:20]:
        assert levenshtein_inside(items[i][1], decontam.normal(texts[t])) <= d <= 0.2 * len(items[i][1])


def like_items(kind, n, rng, vocabulary):
    """Items of one kind in normal form: of some tens of bytes, or of one template."""
    if kind == "template":
        name = lambda k: "".join(rng.choices("abcdefghij", k=k))
        texts = [f"question {name(rng.randint(4, 14))} what is the capital city of the province of {name(9)} in the country named {name(7)} and why" for _ in range(n)]
    else:
        low, high = kind
        texts = []
        while len(texts) < n:
            text = " ".join(rng.choices(vocabulary, k=12))[: rng.randint(low, high)].strip()
            if low <= len(text):
                texts.append(text)
    return [(k, t.encode()) for k, t in enumerate(texts)]


@pytest.mark.parametrize("kind, n", [((20, 27), 120), ((21, 36), 120), ((36, 65), 120), ("template", 40)])
def test_recall_of_short_and_templated_items(kind, n):
    """A fifth of the bytes edited: the copy is at least so near, by the exact distance, and found by nine in ten."""
    rng, numbers = random.Random(str(kind)), np.random.default_rng(5)
    vocabulary = ["of", "the", "and", "is"] + ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    items = like_items(kind, n, rng, vocabulary)
    index = decontam.Index(items, 0.8, 0.95)
    texts, want = [], []
    while len(want) < 300:
        i = rng.randrange(n)
        item = items[i][1]
        copy = decontam.edited(item, len(item) // 5, numbers)
        text = decontam.normal(f"{' '.join(rng.choices(vocabulary, k=rng.randint(0, 40)))} {copy.decode()} {' '.join(rng.choices(vocabulary, k=30))}")
        if decontam.best_match(item, text)[0] <= 0.2 * len(item):
            texts.append(text.decode())
            want.append(i)
    found = {(t, i): d for t, k, d, _ in index.search(pa.array(texts)) for i in index.ids[k]}
    assert sum((t, i) in found for t, i in enumerate(want)) >= 0.9 * len(want)
    for (t, i), d in rng.sample(sorted(found.items()), 20):
        assert levenshtein_inside(items[i][1], decontam.normal(texts[t])) <= d <= 0.2 * len(items[i][1])


def test_runs_of_four_bytes_are_left_by_the_least_similarity():
    numbers = np.random.default_rng(1)
    for n in range(decontam.SHORT, 200, 3):
        item = bytes(numbers.integers(97, 123, n, dtype=np.uint8))
        every = np.arange(n // 5) * n // (n // 5) + 2  # the places that leave the shortest runs
        copy = bytearray(item)
        for k in every.tolist():
            copy[min(k, n - 1)] = 48
        assert np.isin(decontam.grams(np.frombuffer(bytes(copy), np.uint8), 4), decontam.grams(np.frombuffer(item, np.uint8), 4)).any()


def test_many_items_of_one_template_are_verified_once_each(monkeypatch):
    """Texts that hold an item of 200 of one template: a pair of text and item is compared once for each stretch."""
    import time

    rng = random.Random(8)
    items = like_items("template", 200, rng, [])
    index = decontam.Index(items, 0.8, 0.95)
    texts = [f"some words before {items[k * 9][1].decode()} and some after" for k in range(20)]
    calls, real = [], decontam.best_match
    monkeypatch.setattr(decontam, "best_match", lambda item, text: calls.append((item, text)) or real(item, text))
    began = time.perf_counter()
    found = {(t, index.ids[i][0]): d for t, i, d, _ in index.search(pa.array(texts))}
    assert time.perf_counter() - began < 15
    assert all(found[t, t * 9] == 0 for t in range(20)) and len(calls) == len(set(calls)) <= 20 * 200
    every = {(t, k) for t, text in enumerate(texts) for k, item in items if real(item, decontam.normal(text))[0] <= 0.2 * len(item)}
    assert set(found) <= every and len(found) >= 0.9 * len(every)


def test_short_items_are_found_as_words():
    items = [(k, t.encode()) for k, t in enumerate(["no", "a b", "twelve bytes", "nineteen bytes long", "12345678", "x"])]
    index = decontam.Index(items, 0.8, 0.95)
    texts = ["No! a-b", "none a bb", "Twelve, bytes", "twelve bytess", "is nineteen  bytes long", "nineteen bytez long", "12345678 123456789", None, "", "x", "xx 2 x", "a", "b"]
    found = sorted((t, index.ids[i][0], d, e) for t, i, d, e in index.search(pa.array(texts)))
    assert found == [(0, 0, 0, 2), (0, 1, 0, 6), (2, 2, 0, 12), (4, 3, 0, 22), (6, 4, 0, 8), (9, 5, 0, 1), (10, 5, 0, 6)]


def test_a_text_of_many_pieces(monkeypatch):
    rng = random.Random(3)
    item = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20))
    index = decontam.Index([(1, item.encode())], 0.8, 0.95)
    filler = " ".join("".join(rng.choices("stuvwxyz", k=6)) for _ in range(400))
    monkeypatch.setattr(decontam, "PIECE", 100)
    for cut in range(0, 1400, 90):
        text = filler[:cut] + " " + item + " " + filler[cut:]
        assert [(0, 0, 0)] == [x[:3] for x in index.search(pa.array([text]))]


@pytest.mark.parametrize("script", ["chinese", "thai", "ascii"])
@pytest.mark.parametrize("edits, least", [(0.0, 1.0), (0.1, 0.9)])
def test_decontamination_without_word_breaks(spark, script, edits, least):
    rng = random.Random(script)
    first, many = {"chinese": (0x4E00, 3000), "thai": (0x0E01, 46), "ascii": (97, 26)}[script]
    said = lambda n: "".join(chr(first + rng.randrange(many)) for _ in range(n))
    items = [(k, said(40) + ("\u3002" + said(30) + "\u3002" if script == "chinese" else said(30))) for k in range(20)]
    rows, leaks = [], set()
    for k in range(60):
        text = said(rng.randint(50, 400))
        if k % 2:
            i = rng.randrange(20)
            part = list(items[i][1])
            for _ in range(int(edits * len(part))):
                part[rng.randrange(len(part))] = said(1)
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(part) + text[at:]
            leaks.add((k, i))
        rows.append((k, text))
    found = decontam.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs <= leaks and len(pairs) >= least * len(leaks)
    if not edits:
        assert all(r["distance"] == 0 for r in found)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(documents(spark, [(1, "a b c")]), none).count() == 0
    assert decontam.contaminated(documents(spark, []), spark.createDataFrame([(1, "some words that are long enough")], "item_id long, text string")).count() == 0


def test_a_very_long_item(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000))
    docs = documents(spark, [(1, "x " + long.replace(" ", "  ") + " y"), (2, long[:9000]), (3, "short")])
    benchmark = spark.createDataFrame([(7, long), (8, "some other words that are long enough")], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontam.contaminated(docs, benchmark).collect()] == [(1, 7, 0)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rows, items, _ = corpus_with_leaks(0.0)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: set(map(tuple, decontam.contaminated(documents(spark, rows), benchmark).select("doc_id", "item_id", "distance").collect()))
    whole = found()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 900)
    small = list(decontam.blocks(benchmark))
    assert len(small) > 5 and sum(map(len, small)) == len(items)
    assert found() == whole


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def brute_nearest(rows, k):
    good = [(i, v) for i, v in dict(rows).items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("relax, least", [(1.0, 1.0), (1.6, 0.9)])
def test_nearest(spark, relax, least):
    rng = np.random.default_rng(5)
    rows = [(k, np.round(rng.normal(size=6) * rng.choice([1, 3]), 2).tolist()) for k in range(900)]
    rows += [(k, rows[40][1]) for k in range(900, 960)]  # more equal vectors than are asked for
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] + [1.0] * 5), (1060, [None] + [1.0] * 5), (1080, [float("inf")] * 6)]
    out = collections.defaultdict(list)
    for r in vptree.nearest(vectors(spark, [(i, v, 0) for i, v in [*rows, *odd, rows[0]]]), 20, relax=relax, shard_rows=300).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    want = brute_nearest(rows, 20)
    assert set(out) == set(want)
    hits = sum(len(set(out[q]) & set(want[q])) for q in want)
    assert hits >= least * sum(map(len, want.values()))
    if relax == 1.0:
        assert out == want


def test_nearest_of_few_vectors(spark):
    assert vptree.nearest(vectors(spark, [])).count() == 0
    out = vptree.nearest(vectors(spark, [(0, [1.0, 0.0], 1), (1, [0.5, 1.0], 1), (20, [1.0, 0.0], 1)])).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]


def nearest_lists(spark, rows, **options):
    out = collections.defaultdict(list)
    for r in vptree.nearest(vectors(spark, [(i, v, 0) for i, v in rows]), **options).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["vec_id"])
    return out


def test_nearest_keeps_all_ties(spark):
    """Exact at factor 1 however many candidates have one score, equal vectors or not."""
    rng = np.random.default_rng(8)
    flat = [[1.0, *rng.integers(-3, 4, 3).astype(float).tolist()] for _ in range(400)]
    rows = [(20, [1.0, 0.0, 0.0, 0.0]), *((k + 1 + (k >= 19), v) for k, v in enumerate(flat)), (10**6, [0.0, 1.0, 0.0, 0.0])]
    random.Random(1).shuffle(rows)
    out = nearest_lists(spark, rows, relax=1.0, cell_rows=64, shard_rows=100)
    assert out == brute_nearest(rows, 20)
    assert out[20] == [k for k in range(1, 22) if k != 20]


@pytest.mark.parametrize("sizes", [(1e200, 1e200), (1e-200, 1e-200), (1.0, 1e200), (1e-160, 1e150), (1e-310, 1.0)])
def test_nearest_of_huge_and_tiny_vectors(spark, sizes):
    rng = np.random.default_rng(9)
    queries, others = sizes
    rows = [(k, (rng.normal(size=5) * (queries if k % 20 == 0 else others)).tolist()) for k in range(300)]

    def exact(v, w):
        from fractions import Fraction

        return sum(Fraction(a) * Fraction(b) for a, b in zip(v, w, strict=True))

    out = nearest_lists(spark, rows, relax=1.0, cell_rows=64)
    assert len(out) == 15
    for q in range(0, 300, 20):
        scored = sorted((-exact(rows[q][1], v), i) for i, v in rows if i != q)
        try:
            want = [i for _, i in sorted((-float(-s), i) for s, i in scored)[:20]]
        except OverflowError:  # beyond the range all are infinite, and ties
            limit = 2**1024
            want = [i for _, i in sorted((-math.inf if s <= -limit else math.inf if s >= limit else float(s), i) for s, i in scored)[:20]]
        assert out[q] == want


def test_one_huge_vector_leaves_the_others_as_they_are(spark):
    rng = np.random.default_rng(10)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1, 200)]
    out = nearest_lists(spark, [*rows, (500, [1e300, 0.0, 0.0, 0.0])], relax=1.0, cell_rows=64)
    plain = nearest_lists(spark, rows, relax=1.0)
    for q, own in plain.items():
        assert [i for i in out[q] if i != 500][:19] == own[:19]


def test_nearest_of_other_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [2.0, 0.0]), (20, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 2.0, 2.0]), (40, [7.0])]
    out = vptree.nearest(vectors(spark, [(i, v, 0) for i, v in rows]), 20, relax=1.0).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out)
    assert got == [(0, 1, 1, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 0.5), (0, 2, 0, 0.5), (20, 1, 3, 6.0), (20, 2, 4, 6.0)]


def test_a_hot_query_vector_is_asked_once_for_each_salt(spark):
    rng = np.random.default_rng(11)
    rows = [(20 * k, [1.0, 2.0, 3.0]) for k in range(400)] + [(20 * k + 1, rng.normal(size=3).tolist()) for k in range(200)]
    assert nearest_lists(spark, rows, relax=1.0, cell_rows=64) == brute_nearest(rows, 20)


def test_lattice_sums_all_segmentations():
    own = lattice.Lattice(piece.PieceModel(MODEL))
    pieces = piece.PieceModel(MODEL).pieces

    def brute(word):
        starts, inner = collections.defaultdict(float), collections.defaultdict(float)
        for i in own.used.tolist():
            p = pieces[i]
            if re.fullmatch(r"<0x[0-9A-F]{2}>", p):
                inner[bytes([int(p[3:5], 16)])] += math.exp(own.log_p[i])
            elif p.startswith("▁"):
                starts[p[1:].encode()] += math.exp(own.log_p[i])
            else:
                inner[p.encode()] += math.exp(own.log_p[i])
        total = [0.0] * (len(word) + 1)
        for j in range(len(word) + 1):
            total[j] = starts.get(word[:j], 0.0) + sum(total[i] * inner.get(word[i:j], 0.0) for i in range(j))
        return math.log(total[-1])

    words = ["the", "onthing", "é", "xqzzjk", "日本語", "a" * 70, "\x00\x01"]
    got = own.log_probability([w.encode() for w in words])
    assert np.allclose(got, [brute(w.encode()) for w in words], rtol=1e-9)


def test_long_words_are_the_same_one_by_one(monkeypatch):
    own = lattice.Lattice(piece.PieceModel(MODEL))
    words = [w.encode() for w in ("the", "onthing", "é", "xqzzjk", "日本語", "a" * 70, "\x00\x01", "inthonerationless" * 9)]
    count = np.arange(1.0, len(words) + 1)
    log_p, expected = own.log_probability(words), own.expected(words, count)
    monkeypatch.setattr(lattice, "LONG_WORD", 4)
    assert np.allclose(own.log_probability(words), log_p, rtol=1e-9)
    assert np.allclose(own.expected(words, count), expected, rtol=1e-7, atol=1e-9)


def test_a_word_of_a_megabyte_is_scored_in_bounded_memory():
    import tracemalloc

    own = lattice.Lattice(piece.PieceModel(MODEL))
    word = bytes(np.random.default_rng(1).integers(97, 123, 1 << 20, dtype=np.uint8))
    total = np.zeros(len(own.log_p))
    tracemalloc.start()
    whole = own.long_word(word[: 1 << 14], total)
    grown = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert math.isfinite(whole) and grown < 64 << 14
    sizes = np.zeros(len(total))
    for p, i in [(p, i) for p, i in piece.PieceModel(MODEL).vocab.items() if i in set(own.used.tolist())]:
        sizes[i] = len(p.replace("▁", "").encode())
    sizes[list(piece.PieceModel(MODEL).byte_of)] = 1
    assert abs((total * sizes).sum() - (1 << 14)) < 1e-3  # the expected pieces cover the word
    assert math.isfinite(own.log_probability([word])[0])


def test_lattice_score_is_that_of_its_formula(spark):
    """The mixture, discount, end and one refit, by enumerating all segmentations of short words."""
    texts = ["The cat the dog", "a cat on a mat", "", None, "dog dog catx", "zq the end on", "on on", "mat"]
    ids = list(range(len(texts)))
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k in ids]
    ids += [k for k in range(8, 300) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    texts, held = [*texts, "the unknown catdog", "xyz mat"], [*held, True, True]
    model = piece.PieceModel(MODEL)
    own = lattice.Lattice(model)
    starts, inner = collections.defaultdict(list), collections.defaultdict(list)
    for i in own.used.tolist():
        p = model.pieces[i]
        if i in model.byte_of:
            inner[bytes([model.byte_of[i]])].append(i)
        elif p.startswith("▁"):
            starts[p[1:].encode()].append(i)
        else:
            inner[p.encode()].append(i)

    def segmentations(word, first=True):
        if not word and not first:
            yield ()
        pool = starts if first else inner
        for j in range(0 if first else 1, len(word) + 1):
            for i in pool.get(word[:j], ()):
                for rest in segmentations(word[j:], False):
                    yield (i, *rest)

    def summed(word, p, expected=None):
        parts = [(s, math.prod(p[i] for i in s)) for s in segmentations(word)]
        whole = math.fsum(x for _, x in parts)
        if expected is not None:
            for s, x in parts:
                for i in s:
                    expected[i] += x / whole
        return whole

    split = lambda t: (t or "").translate(AZ).encode().split()
    count = collections.Counter(w for t, h in zip(texts, held, strict=True) if not h for w in split(t))
    ends = sum(not h for h in held)
    n, types = sum(count.values()) + ends, len(count) + 1
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    expected = np.zeros(len(model.pieces))
    for w in count:
        summed(w, own.by_score, expected)
    weight = own.by_score * lattice.PRIOR + expected
    weight /= weight.sum()
    got = {r["doc_id"]: r for r in lattice.score(documents(spark, list(zip(ids, texts, strict=True))), MODEL, refits=1).collect()}
    for k, t, h in zip(ids, texts, held, strict=True):
        want = math.log10((ends - d) / n)
        for w in split(t):
            want += math.log10(max(count[w] - d, 0) / n + d * types / n * summed(w, weight))
        assert got[k]["held_out"] == h and abs(got[k]["score"] - want) < 1e-7


def test_lattice_expectations_are_derivatives():
    own = lattice.Lattice(piece.PieceModel(MODEL))
    words, count = [b"onthing", b"the", b"theone"], np.array([2.0, 3.0, 1.0])
    got = own.expected(words, count)
    for i in np.argsort(-got)[:6].tolist():
        base = own.log_p[i]
        own.log_p[i] = base + 1e-6
        up = (own.log_probability(words) * count).sum()
        own.log_p[i] = base - 1e-6
        down = (own.log_probability(words) * count).sum()
        own.log_p[i] = base
        assert abs((up - down) / 2e-6 - got[i]) < 1e-3


def test_lattice_scores(spark):
    rng = random.Random(1)
    words = ["The", "on", "ing", "zq", "é", "x" * 200]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(120)] + [None, "", " \n", "never seen wörds"]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = documents(spark, [*rows, rows[3]])
    tokens = [((t or "").encode().lower().split() + [b""], zlib.crc32(str(k).encode()) % 10 == 0) for k, t in [*rows, rows[3]]]
    c = collections.Counter(w for own, held in tokens if not held for w in own)
    n, v = sum(c.values()), len(c)
    whole = lattice.score(docs, MODEL).collect()
    assert len(whole) == len(rows) + 1
    for hot in (150_000, 2):
        for r in lattice.score(docs, MODEL, hot_words=hot).collect():
            own, held = tokens[r["doc_id"]]
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(own), sum(c[w] > 0 for w in own), n)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9)
            assert math.isclose(r["score"], next(x["score"] for x in whole if x["doc_id"] == r["doc_id"]), rel_tol=1e-9) and r["score"] < 0
    assert lattice.score(docs.limit(0), MODEL).count() == 0
    one = lattice.score(documents(spark, [(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 10 == 0), "ab")]), MODEL).first()
    assert one["train_tokens"] == 0 and one["base_score"] == 0 and one["score"] < 0


@pytest.mark.parametrize("hot", [150_000, 0])
def test_lattice_tells_texts_apart_whatever_their_ids(spark, hot):
    import xxhash

    seen, pair = {}, None
    while pair is None:  # two texts of one 32-bit hash
        text = f"t{len(seen)} w"
        mark = xxhash.xxh32_intdigest(text.encode())
        pair = (seen[mark], text + "") if mark in seen else None
        seen[mark] = text
    texts = ["a b", "a b c d e", "a b", None, "", "c " * 40, *pair, pair[1] + " more of it"]
    learn = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10]
    want = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in lattice.score(documents(spark, list(zip(learn, texts, strict=False))), MODEL, hot_words=hot).collect())
    for ids in ([None] * len(texts), [learn[0]] * len(texts), [None, None, learn[1]] * 3):
        got = lattice.score(documents(spark, list(zip(ids, texts, strict=True))).repartition(3), MODEL, hot_words=hot).collect()
        assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in got) == want
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(ids)


@pytest.mark.parametrize("refits", [0, 1])
def test_lattice_weights_are_the_scores_unless_refits_are_asked_for(spark, refits):
    rows = [(k, t) for k, t in zip([k for k in range(400) if zlib.crc32(str(k).encode()) % 10], ["on the onthing", "the mat"], strict=False)]
    own, n, types, d = lattice.Lattice(piece.PieceModel(MODEL)), 7, 5, 0.5
    count = {b"on": 1, b"the": 2, b"onthing": 1, b"mat": 1}
    d = min(0.9, max(0.1, 3 / (3 + 2 * 1)))
    if refits:
        own.set_weights(own.by_score * lattice.PRIOR + own.expected(list(count), np.ones(4)))
    words = dict(zip(count, np.exp(own.log_probability(list(count))), strict=True))
    got = {r["doc_id"]: r["score"] for r in lattice.score(documents(spark, rows), MODEL, refits=refits).collect()}
    for k, t in rows:
        want = math.log10((2 - d) / n) + sum(math.log10((count[w] - d) / n + d * types / n * words[w]) for w in t.encode().split())
        assert abs(got[k] - want) < 1e-7


@pytest.mark.parametrize("hot", [0, 2000])
def test_shards(spark, hot):
    rng = random.Random(hot)
    texts = ["".join(rng.choices("abcdé ", k=int(rng.expovariate(1 / 300)))) for _ in range(3000)]
    texts += ["copy " * 50] * hot + [None, "", "x" * 20_000]
    docs = documents(spark, [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])])
    rows = shard.assign(docs).collect()
    assert len(rows) == len(texts) + 1 and {r["law"] for r in rows} == {"bytes"}
    by = collections.defaultdict(list)
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body) and r["grown_shard"] is None
        by[r["shard"]].append(r)
    assert set(by) == set(range(24))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 24 + 20_008


@pytest.mark.parametrize("copies", [[300], [100, 90, 80], [40] * 30, [3000, 20]])
def test_equal_texts_share_a_shard(spark, copies):
    """All copies of a text are in one shard unless they exceed it, and sizes are near equal still."""
    rng = random.Random(len(copies))
    texts = [" ".join(rng.choices(["some", "words", "of", "many", "texts"], k=rng.randint(1, 40))) + f" {k}" for k in range(4000)]
    for k, n in enumerate(copies):
        texts += [f"a text that is there often {k} " * 5] * n
    texts += ["two"] * 2 + [None] * 3 + [""] * 3
    rng.shuffle(texts)
    rows = documents(spark, [(k if k % 5 else None, t) for k, t in enumerate(texts)]).withColumn("size", F.lit("other"))
    out = shard.assign(rows).collect()
    assert len(out) == len(texts)
    total = sum(r["size"] for r in out)
    held, where = collections.Counter(), collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in out:
        held[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    weight = collections.Counter()
    for t in texts:
        weight[zlib.crc32((t or "").encode()), len((t or "").encode()) + 8] += len((t or "").encode()) + 8
    for key, shards in where.items():
        assert len(shards) == 1 or weight[key] > total / 24
    assert set(held) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min(held.values()) <= 0.06 * total / 24


def test_shards_of_rows_that_are_all_the_same(spark):
    out = shard.assign(spark.createDataFrame([(None, "the same text")] * 2400, "doc_id long, text string")).collect()
    held = collections.Counter(r["shard"] for r in out)
    assert len(held) == 24 and max(held.values()) - min(held.values()) <= 50


def test_shards_of_no_rows_and_of_one(spark):
    assert shard.assign(documents(spark, [])).count() == 0
    assert shard.assign(documents(spark, [(1, "a")])).first()["slot"] == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_stages_keep_what_they_should(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= set(before)
        gone = set(before) - kept
        if name == "toxicity":
            clean = [k for k in before if labels.get(k) == 0]
            assert len([k for k in clean if k in gone]) <= 0.05 * len(clean)
        elif name == "jaccard_join":
            want = brute_groups(sorted(before.items()), 5, 80)
            assert gone == {k for k, (_, c) in want.items() if c != k}
        elif name == "decontamination":
            items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {k for k, t in before.items() if any(i in decontam.normal(t) for i in items)} <= gone
        else:
            assert not gone
        if name != "sentencepiece":
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
