"""Encoding, word pieces, chat formatting, licences, toxicity: against libraries, brute force or held-out rows."""

import collections
import functools
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from voxelframe.llm import chat, license, piece, queries, toxicity, wordpiece  # noqa: E402

MODEL = queries.tokenizer_bytes()
CODER = piece.PieceModel(MODEL)
TEXTS = st.text(st.sampled_from("abcehinorst  \n\t▁éß①日語.,<0>A\x00") | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pieces_are_the_librarys(library, text):
    ids = library.encode(text)
    assert CODER.encode(text) == ids
    assert CODER.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 1000, "the" * 700, " " * 300, "x" * 399 + " " + "y" * 401, "é" * 450, "", " ", "aeinrst" * 300, "ab" * 5000])
def test_long_runs_are_the_librarys(library, text):
    assert CODER.encode(text) == library.encode(text)
    assert CODER._merge_long("▁" + text.replace(" ", "▁")) == library.encode(text) or not text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("theaonirs▁=_"), max_size=200), st.integers(1, 9), st.sampled_from([1, 3, 256]))
def test_rounds_by_rank_are_the_librarys(library, text, times, window):
    """Every segment by rank, whatever its length, through few places at a time."""
    text = (text * times).strip(" ▁")
    kept, piece.WINDOW = piece.WINDOW, window
    try:
        assert not text or CODER._merge_long("▁" + text.replace("▁", "_")) == library.encode(text.replace("▁", "_"))
    finally:
        piece.WINDOW = kept


@pytest.mark.parametrize("letters, n", [("etaoinshrdlu", 300_000), ("the", 60_000), ("=", 100_000), ("漢字仮名", 20_000), ("thandon", 100_000)])
def test_very_long_segments_take_time_in_proportion(library, letters, n):
    import time

    rng = random.Random(letters)
    text = "".join(rng.choices(letters, k=n))
    began = time.perf_counter()
    ids = CODER.encode(text)
    assert time.perf_counter() - began < 30 and CODER.decode(ids) == text
    assert ids[: len(ids) // 2] == library.encode(text)[: len(ids) // 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_any_ids_decode_as_the_librarys(library, ids):
    if not any(CODER.kinds[i] in (2, 3) for i in ids):  # control and unknown ids aren't text
        assert CODER.decode(ids) == library.decode(ids)


def documents(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_encode_covers_odd_rows(spark, library):
    texts = [None, "", "  two  spaces\n", "same", "same", "x" * 5000]
    docs = documents(spark, texts, [0, 1, 2, 3, 3, None]).withColumnRenamed("lang", "n_tokens")
    out = piece.encode(docs, MODEL).collect()
    assert len(out) == 6
    for r in out:
        text = r["decoded"]
        assert list(r["token_ids"]) == library.encode(text) and r["n_tokens"] == len(r["token_ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["token_ids"])).encode()).hexdigest()
    assert sorted(r["decoded"] for r in out) == sorted(t or "" for t in texts)
    assert piece.encode(docs.limit(0), MODEL).count() == 0


def greedy(word, starts, inner):
    n, own = 0, starts
    while word:
        for k in range(len(word), 0, -1):
            if word[:k] in own:
                word, n, own = word[k:], n + 1, inner
                break
        else:
            return -1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=5), max_size=8), st.sets(st.text("ab", min_size=1, max_size=5), max_size=8), st.text("abc", max_size=12))
def test_automaton_is_greedy_longest_match(starts, inner, word):
    assert wordpiece.Automaton(starts, inner).count(word) == greedy(word, starts, inner)


def test_token_counts(spark):
    out = {r["doc_id"]: tuple(r)[1:] for r in wordpiece.token_counts(documents(spark, ["the the 犇龘 cat", None, " \n", "thethe" * 2000]), MODEL).collect()}
    starts = {p[1:] for p in CODER.vocab if p.startswith("▁") and "▁" not in p[1:]} - {""}
    inner = {p for p in CODER.vocab if "▁" not in p}
    want = [greedy(w, starts, inner) for w in ("the", "the", "犇龘", "cat")]
    assert out[0] == (4, sum(max(1, n) for n in want), want.count(-1))
    assert out[1] == out[2] == (0, 0, 0)
    assert out[3] == (1, greedy("thethe" * 2000, starts, inner), 0)


def test_token_counts_of_repeated_rows_other_columns_and_nothing(spark):
    rows = [(1, "the cat", 7, "x"), (1, "the cat", 7, "x"), (None, "the  cat\n", 8, "y"), (2, None, 9, None), (None, "", None, "z"), (3, "a" * 300_000, 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, __text string")
    out = wordpiece.token_counts(docs, MODEL)
    assert out.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    got = collections.Counter(tuple(r) for r in out.collect())
    own = tuple(wordpiece.token_counts(docs.limit(1), MODEL).first())[1:]
    assert got[(1, *own)] == 2 and got[(None, *own)] == 1 and got[(2, 0, 0, 0)] == 1 and got[(None, 0, 0, 0)] == 1 and got.total() == 6
    assert wordpiece.token_counts(docs.limit(0), MODEL).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>"]), st.text(st.sampled_from("ab\\<>/s[]INSTROLEX \n"), max_size=30) | st.sampled_from(list(chat.CONTROL))), max_size=6))
def test_formatted_turns_read_back(turns):
    pieces = list(chat.compile_template(chat.TEMPLATE)({"role": r, "text": t} for r, t in turns))
    back = list(chat.read_back(iter(pieces)))
    assert [(r, t) for r, t, _, _ in back] == turns
    assert "".join(m for _, _, m, _ in back) == "".join(t for r, t in turns if r == "assistant")
    assert sum(n for *_, n in back) == len("".join(p for p, _ in pieces))


def test_template_language():
    run = lambda source, turns=(): "".join(p for p, _ in chat.compile_template(source)(turns))
    turns = [{"role": "user", "text": " Hi "}, {"role": "bot", "text": "yo"}]
    assert run("{{ 'a' + 'b' | upper }}{% if 1 == 2 or not 'x' %}no{% else %}yes{% endif %}") == "aByes"
    assert run("{% for t in turns %}{{ loop.index }}{% if loop.first %}!{% endif %}{{ t.text | trim }}{% endfor %}", turns) == "1!Hi2yo"
    assert chat.fold(chat.parse("a{{ 'b' }}{% if 'x' == 'x' %}c{% endif %}")) == [("text", ("const", "abc"))]
    for wrong in ("{% for t in turns %}", "{{ a. }}", "{{ x | open }}", "{% import os %}", "{{ ( 'a' }}", "{{ a() }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(wrong)


def test_conversations(spark):
    rows = [(5, 1, "assistant", "b"), (5, 0, "user", "a"), (5, 1, "assistant", "b"), (6, None, None, None), (None, 0, "user", "x")]
    rows += [(7, k, "assistant", "w" * 500) for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.conversation_digests(turns).collect()}
    assert set(out) == {5, 6, 7, None}
    assert out[5]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (out[5]["n_turns"], out[5]["loss_chars"], out[5]["loss_sha256"]) == (3, 2, hashlib.sha256(b"bb").hexdigest())
    assert out[6]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert out[7]["loss_chars"] == 150_000
    text = {c: "".join(r["formatted"] for r in sorted((r for r in chat.formatted_turns(turns).collect() if r["conv_id"] == c), key=lambda r: r["piece"])) for c in (5, 7)}
    assert all(len(text[c]) == out[c]["formatted_chars"] for c in text)
    assert chat.conversation_digests(turns.limit(0)).count() == 0


def test_licences(spark):
    mit = "MIT License\nCopyright (c) 2020 Some One\n" + ". ".join(s.capitalize() for s, i in license.SENTENCES.items() if i in ("mit_grant", "mit_notice", "mit_warranty")) + "."
    texts = [mit, "Text. Licensed under the Apache License, Version 2.0.", "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\n", "no licence here", None, "", "licensed under the mit licenses"]
    out = {r["doc_id"]: r for r in license.scan(documents(spark, texts)).collect()}
    assert [out[k]["licenses"] for k in range(7)] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0,MIT", "", "", "", ""]
    assert out[0]["sentence_ids"] == "mit_title,copyright,mit_grant,mit_notice,mit_warranty"
    assert license.scan(documents(spark, texts).limit(0)).count() == 0


MIT_WRAPPED = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE.
"""
BSD_WRAPPED = """Copyright (c) 2019, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_WRAPPED = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL_WRAPPED = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful.
"""
MPL_WRAPPED = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// ", "crlf"])
def test_wrapped_licences(spark, sign):
    texts = [MIT_WRAPPED, BSD_WRAPPED, BSD_WRAPPED + BSD_ENDORSE, APACHE_WRAPPED, GPL_WRAPPED.format(";", ";", 2), GPL_WRAPPED.format(":", ",", 3), MPL_WRAPPED]
    texts.append(" ".join(APACHE_WRAPPED.split()))
    texts = [t.replace("\n", "\r\n") if sign == "crlf" else "".join(f"{sign}{x}".rstrip() + "\n" for x in t.split("\n")) for t in texts]
    out = {r["doc_id"]: r for r in license.scan(documents(spark, texts)).collect()}
    assert [out[k]["licenses"] for k in range(8)] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "MPL-2.0", "Apache-2.0"]
    assert out[0]["sentence_ids"] == "mit_title,copyright,mit_grant,mit_notice,mit_warranty"
    assert out[3]["sentence_ids"] == out[7]["sentence_ids"] == "apache2_head,apache2_comply"


def test_sentences_end_at_lines_and_not_inside_words(spark):
    texts = ["some words\nReleased under the\nMIT License\nand more", "unreleased under the MIT license", "licensed under the\n\nApache License, Version 2.0", "a\nSPDX-License-Identifier:\tGPL-3.0-or-later\nb"]
    out = {r["doc_id"]: r["sentence_ids"] for r in license.scan(documents(spark, texts)).collect()}
    assert [out[k] for k in range(4)] == ["mit_ref", "", "", "gpl3_ref"]


def test_every_known_sentence_has_a_cue_and_a_normal_form(spark):
    rows = spark.createDataFrame([(s,) for s in license.SENTENCES], "s string")
    from pyspark.sql import functions as F

    assert rows.filter(~F.col("s").rlike(license.CUES)).drop_duplicates().count() == len([s for s in license.SENTENCES if not any(c in s for c in ("licen", "copyright", "permi", "warrant", "redistribut", "public domain"))])
    assert rows.filter(license.normal(F.col("s")) != F.col("s")).count() == 0
    known = set(license.SENTENCES.values()) | {i for _, i in license.PATTERNS}
    assert {i for _, run in license.RULES for i in run} <= known


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices(["on", "er", "th", "ti", "ou", "an"], k=rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 6 == 0
        own = rng.choices(words, k=rng.randint(5, 200))
        if toxic:
            own += rng.choices(["moron", "idiot", "lowei" + rng.choice(words)], k=1 + len(own) // 40)
            rng.shuffle(own)
        rows.append(" ".join(own))
        labels.append((k, int(toxic)))
    labels += [(1, None), (10**6, 1)]
    docs = documents(spark, [*rows, None, ""])
    out = {r["doc_id"]: r for r in toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [k for k in range(1500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(out[k]["held_out"] for k in held)
    right = sum(out[k]["predicted"] == (k % 6 == 0) for k in held)
    assert right >= 0.97 * len(held)
    assert out[1500]["predicted"] == 0 and 0 <= out[1501]["score"] <= 1
    none = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.filter("predicted = 1").count() == 0


def test_kneser_ney_ratios():
    import pandas as pd

    seen, rest = toxicity.kneser_ney(pd.DataFrame({"gram": ["aaaab", "aaaac", "bbbbc"], "toxic": [9, 1, 0], "ordinary": [1, 9, 4]}))
    assert seen["aaaab"] > 1 and seen["aaaac"] < -1 and abs(seen["aaaab"] + seen["aaaac"]) < 0.5
    assert rest["aaaa"] == 0  # both classes know the context equally well
    assert toxicity.kneser_ney(pd.DataFrame({"gram": [], "toxic": [], "ordinary": []})) == ({}, {})


REFERENCES = {
    "This file is licensed under the MIT License.": "MIT",
    "The source code is released under the terms of the Apache License, Version 2.0": "Apache-2.0",
    "Distributed under the BSD 3-Clause License": "BSD-3-Clause",
    "This project is available under the GNU Lesser General Public License v2.1": "LGPL-2.1",
    "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "// SPDX-License-Identifier: (MIT)": "MIT",
    "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */": "GPL-2.0-only WITH Linux-syscall-note",
    " * SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
    "licensed under the mithril": "",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
    "This crate is licensed under either of\n Apache License, Version 2.0 or the MIT license\n at your option.": "Apache-2.0,MIT",
    "Dual licensed under the MIT and GPLv2 licenses": "",
    "Dual licensed under the MIT license and GPLv2": "GPL-2.0,MIT",
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
    "License: MIT": "MIT",
    "released under the terms of the GPLv3": "GPL-3.0",
    "released under the terms of the GNU GPL version 3.0": "GPL-3.0",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT OR Apache-2.0",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC": "(MIT OR Apache-2.0) AND ISC",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.": "GPL-2.0-only",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.": "GPL-2.0-only",
}


def test_licences_by_reference(spark):
    out = {r["doc_id"]: r["licenses"] for r in license.scan(documents(spark, [f"words before\n{t}\nwords after" for t in REFERENCES])).collect()}
    assert [out[k] for k in range(len(REFERENCES))] == list(REFERENCES.values())


BSD = """Copyright (c) 2011, {holder}
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
THIRD = "3. Neither the name of {holder} nor the\n   names of its contributors may be used to endorse or promote products derived\n   from this software without specific prior written permission.\n"


def test_bsd_licences_of_any_holder(spark):
    holders = ["the copyright holder", "the University", "Example Inc.", "the\n   Some Long Named Institute of Things", "Example, Inc. and Others"]
    texts = [BSD.format(holder="X", third=THIRD.format(holder=h)) for h in holders]
    texts += [BSD.format(holder="X", third="3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n")]
    texts += [BSD.format(holder="X", third="3. Neither the names of the authors nor of anyone else may be used to\n   endorse or promote products of any kind.\n")]
    texts += [BSD.format(holder="X", third="")] * 2
    texts += ["\n".join(f" * {line}" for line in t.splitlines()) for t in texts[:3]]
    out = {r["doc_id"]: r["licenses"] for r in license.scan(documents(spark, texts)).collect()}
    assert [out[k] for k in range(len(texts))] == ["BSD-3-Clause"] * 7 + ["BSD-2-Clause"] * 2 + ["BSD-3-Clause"] * 3


def test_licences_of_repeated_rows_and_long_texts(spark):
    long = "some words and more. " * 60_000 + "\nReleased under the MIT License.\n" + "words " * 1000
    rows = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (None, "License: MIT", "z"), (2, None, "w")], "doc_id long, text string, licenses string")
    out = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["licenses"]) for r in license.scan(rows).collect())
    assert out == [(False, 1, "MIT"), (False, 1, "MIT"), (False, 2, ""), (True, 0, "MIT")]


def test_licences_as_distributed(spark):
    """Whole texts, by this module's sentences and by rules made from the texts themselves."""
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    if not all(os.path.exists(f"{folder}/{f}") for f in files.values()):
        pytest.skip("needs the distribution's licence texts")
    texts = {name: open(f"{folder}/{f}").read() for name, f in files.items()}
    sentences, rules = license.rules_of(texts)
    commented = ["\n".join(f"# {line}" for line in t.splitlines()) for t in texts.values()]
    rows = documents(spark, [*texts.values(), *commented, "x" * 1_000_000, *list(texts.values())[:1], "words\n\n" * 10_000 + texts["GPL-3.0"]])
    out = {r["doc_id"]: r for r in license.scan(rows, sentences, rules).collect()}
    for k, name in enumerate([*texts, *texts]):
        assert name in out[k]["licenses"].split(",")
    assert out[12]["licenses"] == "" and out[13]["licenses"] == out[0]["licenses"] and "GPL-3.0" in out[14]["licenses"]
    plain = {r["doc_id"]: r["licenses"] for r in license.scan(rows).collect()}
    for k, name in enumerate(texts):
        if name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0"):
            assert name in plain[k].split(",")


def models_by_loops(words):
    """Probabilities of both classes' models by plain loops over (word, times in toxic, times in ordinary texts)."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    grams = collections.defaultdict(lambda: [0, 0])
    for w, toxic, ordinary in words:
        if toxic + ordinary:
            padded = toxicity._PAD + w + toxicity._END
            for k in range(len(w) + 1):
                grams[padded[k : k + n]][0] += toxic
                grams[padded[k : k + n]][1] += ordinary
    suffixes = {k: {g[-k:] for g in grams} for k in range(1, n + 1)}
    letters = sorted({g[-1] for g in grams})

    @functools.cache
    def shared(context, c):
        """The continuation probability after ``context``, which is shorter than the models' order."""
        k = len(context)
        below = shared(context[1:], c) if k else 1 / len(suffixes[1])
        count = {x: sum(g[1:] == context + x for g in suffixes[k + 2]) if k + 2 <= n else 0 for x in letters}
        total = sum(count.values())
        return (max(count.get(c, 0) - d, 0) + d * sum(v > 0 for v in count.values()) * below) / total if total else below

    def p(kind, context, c):
        count = {x: grams[context + x][kind] if context + x in grams else 0 for x in letters}
        total, back = sum(count.values()), shared(context[1:], c)
        return (max(count.get(c, 0) - d, 0) + d * sum(v > 0 for v in count.values()) * back) / total if total else back

    @functools.cache
    def ratio(w):
        padded, out = toxicity._PAD + w + toxicity._END, 0.0
        for k in range(len(w) + 1):
            context, c = padded[k : k + n - 1], padded[k + n - 1]
            out += math.log(p(0, context, c) / p(1, context, c))
        return out

    return grams, letters, p, ratio


def test_kneser_ney_is_that_of_its_formula():
    """All probabilities by plain loops over the training words, and that they sum to one."""
    rng = random.Random(4)
    texts = [("".join(rng.choices("abc", k=rng.randint(1, 6))), rng.randint(0, 5), rng.randint(0, 5)) for _ in range(60)]
    grams, letters, p, ratio = models_by_loops(texts)
    frame = pd.DataFrame({"gram": list(grams), "toxic": [v[0] for v in grams.values()], "ordinary": [v[1] for v in grams.values()]})
    model = toxicity.ToxicityModel(*toxicity.kneser_ney(frame))
    for context in {g[:-1] for g in list(grams)[:40]}:
        for kind in (0, 1):
            assert abs(sum(p(kind, context, c) for c in letters) - 1) < 1e-9
    for w in [w for w, _, _ in texts[:20]] + ["aabbc", "ccc", "abcabcab"]:
        assert abs(model.ratio(w) - ratio(w)) < 1e-9
    model.chance = 0.01
    assert abs(model.difference("abc, ABC ccc") - (2 * model.word("abc") + model.word("ccc")) / 3) < 1e-12
    assert abs(model.word("abc") - math.log(0.99 + 0.01 * math.exp(model.ratio("abc")))) < 1e-12


def test_the_whole_toxicity_score_is_that_of_its_definition(spark):
    """Learning rows, models, chance and coefficients anew, by loops and another way to the least loss."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abe", k=rng.randint(1, 4))) for _ in range(25)]
    rows, labels = [], []
    for k in range(240):
        own = rng.choices(vocabulary, k=rng.randint(0, 12))
        if k % 3 == 0:
            own += rng.choices(["bebad", "daba", "baddie"], k=rng.randint(0, 2))
        rows.append((k, " ".join(own)))
        labels.append((k, int(k % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)).alias("p")).collect()}
    text, toxic = dict(rows), dict(labels)
    learn = [k for k in text if zlib.crc32(str(k).encode()) % 5]
    count = collections.defaultdict(lambda: [0, 0])
    for k in learn:
        if part[k] < toxicity.MODEL_TENTHS:
            for w in text[k].split():
                count[w][1 - toxic[k]] += 1
    ratio = models_by_loops([(w, *c) for w, c in count.items()])[3]

    def difference(t, chance):
        own = t.split()
        return sum(math.log(1 - chance + chance * math.exp(ratio(w))) for w in own) / max(1, len(own))

    best = None
    fitted = [k for k in learn if part[k] >= toxicity.MODEL_TENTHS]
    y = np.array([toxic[k] for k in fitted], dtype=float)
    for chance in toxicity.CHANCES:
        x = np.array([difference(text[k], chance) for k in fitted])
        scale = max(np.abs(x).mean(), 1e-9)
        a, b = 0.0, 0.0
        for _ in range(20_000):  # plain descent on the same penalised loss
            p = 1 / (1 + np.exp(-(a * x / scale + b)))
            a, b = a - 0.02 * (((p - y) * x / scale).sum() + 1e-2 * a), b - 0.02 * ((p - y).sum() + 1e-6 * b)
        loss = np.logaddexp(0, np.where(y > 0, -1, 1) * (a * x / scale + b)).sum()
        if best is None or loss < best[0] - 1e-9:
            best = loss, chance, a / scale, b
    _, chance, a, b = best
    for k, t in text.items():
        assert abs(got[k] - 1 / (1 + math.exp(-(a * difference(t, chance) + b)))) < 1e-4


def test_more_grams_than_memory_has_are_learned_from_fewer_rows(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(20)) + (" moronic" if k % 2 else "")) for k in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    whole, bounded = toxicity.fit(docs, labels), toxicity.fit(docs, labels, most_grams=6000)
    assert len(whole.seen) > 20_000 and 1000 < len(bounded.seen) <= 6000
    assert bounded.scores(["plain moronic words", "plain words"])[0] > bounded.scores(["plain moronic words", "plain words"])[1]


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    docs = [(k, f"plain words are here {k}" if k % 3 else f"you are a moronic fool {k}") for k in range(150)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    twice = toxicity.fit(spark.createDataFrame(docs + docs[:40], "doc_id long, text string"), labels)
    assert once.seen == twice.seen and once.chance == twice.chance and np.allclose(once.weights, twice.weights)
    long = "plain words are here " * 100_000
    clean, toxic, mixed = once.scores([long, "moronic fool " * 100_000, long + "x" * 10_000])
    assert clean < 0.5 < toxic and mixed < 0.5
