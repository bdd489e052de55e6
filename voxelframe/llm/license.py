"""Licence recognition by sentence rules, in DataFrame functions.

A text is brought to a normal form that keeps where sentences and lines end, known sentences
between such ends are found, whatever lines they are wrapped to, and mapped to identifiers, and
the text's sequence of identifiers is matched against licence rules in their order: a rule that
finds its run of identifiers takes it away, so that a full licence text isn't reported again by
the shorter rules after it.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences in their normal form, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "licensed under the apache license version 2.0": "apache2_ref",
    "licensed under the apache license version 2.0 the license": "apache2_head",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "licensed under the bsd 3 clause license": "bsd3_ref",
    "licensed under the mozilla public license version 2.0": "mpl2_ref",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2_ref",
    "licensed under cc by nc 4.0": "ccbync4_ref",
    "licensed under cc by 4.0": "ccby4_ref",
    "licensed under cc by sa 4.0": "ccbysa4_ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4_ref",
    "released into the public domain under cc0 1.0": "cc0_ref",
    "this is free and unencumbered software released into the public domain": "unlicense_head",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost_grant",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd_liability",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21_later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_hope",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl2_preamble",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3_preamble",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl3_preamble",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl3_preamble",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2_where",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2_where",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": "epl2_head",
}

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
# Notices of one version alone.
for _v in (2, 3):
    for _said in (f"version {_v} as published by the free software foundation", f"version {_v} only as published by the free software foundation", f"as published by the free software foundation version {_v}", f"as published by the free software foundation version {_v} of the license"):
        SENTENCES[f"{_GPL} {_said}"] = f"gpl{_v}_only"

# What licences are called in sentences that refer to them, as patterns on the normal form.
NAMES = (
    ("MIT", "mit", "(the )?(mit|expat)( license)?"),
    ("Apache-2.0", "apache2", "(the )?apache( software)?( license)?( version)? 2.0"),
    ("BSD-3-Clause", "bsd3", "(the )?((bsd )?3 clause( bsd)?|(new|modified|revised) bsd)( license)?"),
    ("BSD-2-Clause", "bsd2", "(the )?((bsd )?2 clause( bsd)?|(simplified|freebsd) bsd)( license)?"),
    ("ISC", "isc", "(the )?isc( license)?"),
    ("MPL-2.0", "mpl2", "(the )?(mozilla public license|mpl)( version)?( ?v)? ?2.0"),
    ("AGPL-3.0", "agpl3", "(the )?(gnu )?(affero general public license|agpl)( version| ?v)? ?3(.0)?"),
    ("LGPL-2.1", "lgpl21", "(the )?(gnu )?(lesser general public license|lgpl)( version| ?v)? ?2.1"),
    ("LGPL-3.0", "lgpl3", "(the )?(gnu )?(lesser general public license|lgpl)( version| ?v)? ?3(.0)?"),
    ("GPL-2.0", "gpl2", "(the )?(gnu )?(general public license|gpl)( version| ?v)? ?2(.0)?"),
    ("GPL-3.0", "gpl3", "(the )?(gnu )?(general public license|gpl)( version| ?v)? ?3(.0)?"),
    ("EPL-2.0", "epl2", "(the )?(eclipse public license|epl)( version| ?v)? ?2.0"),
    ("BSL-1.0", "boost", "(the )?boost software license( version)? 1.0"),
    ("Zlib", "zlib", "(the )?zlib license"),
    ("Unlicense", "unlicense", "(the )?unlicense"),
    ("CC0-1.0", "cc0", "(the )?(creative commons )?(cc0|zero)( universal)?( version)? 1.0( universal)?"),
    ("CC-BY-NC-4.0", "ccbync4", "(the |a )?(cc by nc|creative commons attribution non ?commercial) 4.0( international)?( license)?"),
    ("CC-BY-SA-4.0", "ccbysa4", "(the |a )?(cc by sa|creative commons attribution share ?alike) 4.0( international)?( license)?"),
    ("CC-BY-4.0", "ccby4", "(the |a )?(cc by|creative commons attribution) 4.0( international)?( license)?"),
)
_REFERS = "^((this|the|all|our) ([a-z0-9]+ ){1,4}(is|are) )?(dual )?(licensed|released|distributed|available|published|provided|covered) (under|by) (the terms (and conditions )?of )?"

# A sentence that refers to two licences or more names each of them.
_ANY = "(" + "|".join(called for _, _, called in NAMES) + ")"
SEVERAL = f"{_REFERS}(either( of)? |both )?{_ANY}( (or|and)( the)? {_ANY}){{1,3}}( at your (option|choice))?$".replace(".", "[.]")

# Forms of sentences with a part of their own, as anchored patterns, tried in this order.
PATTERNS = (
    ("^copyright( c)? [0-9]{4}.*$", "copyright"),
    ("^spdx license identifier mit$", "mit_ref"),
    ("^spdx license identifier apache 2.0$", "apache2_ref"),
    ("^spdx license identifier gpl 3.0( only| or later)?$", "gpl3_ref"),
    # Any holder may be named, and whatever such a clause says else, a licence with it has three.
    ("^neither the names? [a-z0-9.+ ]{1,400} endorse or promote [a-z0-9.+ ]{1,200}$", "bsd_endorse"),
    ("^the names? of [a-z0-9.+ ]{1,200} may not be used to endorse or promote [a-z0-9.+ ]{1,200}$", "bsd_endorse"),
    ("^(the )?apache license version 2.0 january 2004( https?)?( (www.)?apache.org licenses)?( license 2.0)?$", "apache2_title"),
    *((f"{_REFERS}{called.replace('.', '[.]')}$", f"{name}_ref") for _, name, called in NAMES),
    *((f"^licen[sc]e (is )?{called.replace('.', '[.]')}$", f"{name}_ref") for _, name, called in NAMES),
    ("^spdx license identifier .*$", "spdx"),
)
#: The expression that an SPDX line gives, as it stands in the text, and parentheses round the whole of one.
SPDX = r"SPDX-License-Identifier:[ \t]*([(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)"
ROUND = "^[(]([^()]*)[)]$"

# Licence rules, matched in this order.
RULES = (
    ("MIT", ("mit_title", "copyright", "mit_grant", "mit_notice", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_title", "copyright", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty", "bsd_liability")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty", "bsd_liability")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant", "isc_warranty")),
    ("ISC", ("isc_grant",)),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("Apache-2.0", ("apache2_head", "apache2_comply", "apache2_as_is", "apache2_see")),
    ("Apache-2.0", ("apache2_head", "apache2_comply")),
    ("Apache-2.0", ("apache2_head",)),
    ("AGPL-3.0-or-later", ("agpl3_later",)),
    ("LGPL-2.1-or-later", ("lgpl21_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_later",)),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("GPL-2.0-only", ("gpl2_only",)),
    ("GPL-3.0-only", ("gpl3_only",)),
    ("GPL-2.0", ("gpl2_preamble",)),
    ("GPL-3.0", ("gpl3_preamble",)),
    ("AGPL-3.0", ("agpl3_preamble",)),
    ("LGPL-3.0", ("lgpl3_preamble",)),
    ("Unlicense", ("unlicense_head",)),
    ("MPL-2.0", ("mpl2_ref", "mpl2_where")),
    ("EPL-2.0", ("epl2_head",)),
    *((licence, (f"{name}_ref",)) for licence, name, _ in NAMES),
    ("Apache-2.0", ("apache2_title",)),
    ("MIT", ("mit_title",)),
)

#: Every known sentence holds one of these, so that others needn't be brought to normal form.
CUES = "(licen|copyright|permi|warrant|redistribut|public domain|(released|distributed|available|published|provided|covered)[^a-z0-9]+(under|by)[^a-z0-9])"
_SPACE = r"[ \t\n\r\f\x0B]+"

#: Short forms whose point need not end a sentence.
SHORT_FORMS = ("v", "inc", "ltd", "corp", "co")
_INSIDE = "".join(f"(?<!(?<![a-z0-9.+]){w})" for w in SHORT_FORMS)
#: What ends a sentence, and what may end one or stand inside it.
END, LINE = "\x1e", "\n"


def known(sentences: dict[str, str]) -> str:
    """A pattern of known sentences between such ends, whatever lines they are wrapped to; the longest where several begin."""
    plain = lambda s: s.replace(".", "[.]").replace("+", "[+]").replace(" ", f"[ {LINE}]")
    # Inside a set of characters, another set is added to it.
    forms = (p[1:-1].replace(".*", f"[^{LINE}{END}]*").replace(" ?", " {0,1}").replace(" ", f"[ {LINE}]") for p in (SEVERAL, *(p for p, _ in PATTERNS)))
    return f"(?<![^{LINE}{END}])(?:" + "|".join(map(plain, sorted(sentences, key=len, reverse=True))) + "|" + "|".join(forms) + f")(?![^{LINE}{END}])"


def normal(sentence: Column) -> Column:
    """Small letters, digits, inner points and plus signs, parted by single spaces."""
    kept = F.regexp_replace(F.lower(sentence), "[^a-z0-9.+]+", " ")
    return F.trim(F.regexp_replace(kept, "[.]+( |$)", " "))


def lines(text: Column) -> Column:
    """The normal form of a whole text: ``END`` at sentence ends and blank lines, ``LINE`` at other line ends, ';', ':' and the points of short forms.

    A line of comment signs alone is blank.
    """
    kept = F.lower(F.regexp_replace(F.translate(text, END, " "), "\r\n?", "\n"))
    kept = F.regexp_replace(kept, "\n[^a-z0-9\n]*(?=\n)", END)
    kept = F.regexp_replace(kept, f"([!?]|{_INSIDE}[.]){_SPACE}", f"$1{END}")
    kept = F.regexp_replace(kept, f"([;:]|(?:{'|'.join(SHORT_FORMS)})[.])(?={_SPACE})", f"$1{LINE}")
    kept = F.regexp_replace(kept, f"[^a-z0-9.+{LINE}{END}]+", " ")
    kept = F.regexp_replace(kept, f"[.]+(?=[ {LINE}{END}]|$)", " ")
    kept = F.regexp_replace(kept, f"[ {LINE}]*+{END}[ {LINE}{END}]*+", END)
    return F.trim(F.regexp_replace(F.regexp_replace(kept, f" *+{LINE}[ {LINE}]*+", LINE), " ++", " "))


def segments(text: str) -> list[str]:
    """What ``lines`` makes of a text between sentence ends, each with single spaces: for texts on the driver."""
    kept = re.sub("\r\n?", "\n", text.replace(END, " ")).lower()
    kept = re.sub("\n[^a-z0-9\n]*(?=\n)", END, kept)
    kept = re.sub(f"([!?]|{_INSIDE}[.]){_SPACE}", rf"\1{END}", kept.replace("\x0c", " "))
    kept = re.sub(f"[^a-z0-9.+{END}]+", " ", kept)
    kept = re.sub(f"[.]+(?=[ {END}]|$)", " ", kept)
    return [" ".join(part.split()) for part in kept.split(END) if part.strip()]


def rules_of(texts: dict[str, str], least_words: int = 4) -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """Sentences and rules of whole licences, given by name: a licence is its sentences of ``least_words`` or more, in order.

    A sentence that several licences have keeps its first identifier; those of this module keep theirs.
    """
    sentences, rules = dict(SENTENCES), []
    for name, text in texts.items():
        own = [s for s in segments(text) if len(s.split()) >= least_words]
        rules.append((name, tuple(sentences.setdefault(s, f"{name}.{k}") for k, s in enumerate(own))))
    return sentences, (*sorted(rules, key=lambda r: -len(r[1])), *RULES)


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: tuple | None = None) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses, for every row.

    ``sentence_ids`` are the identifiers in the text's order, joined by commas, several for a
    sentence that names several licences; ``licenses`` the
    licences whose rules matched and the expressions of SPDX lines, sorted, each once, joined by
    commas. Both are empty for texts without known sentences, null and empty texts among them.
    Repeated rows are kept. ``sentences`` and ``rules`` are this module's unless given, as by
    ``rules_of`` for whole licence texts.
    """
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(sentences.items())])

    def identify(sentence: Column) -> Column:
        each = F.concat_ws(",", *[F.when(sentence.rlike(f" {called.replace('.', '[.]')}( or | and | at your |$)"), f"{name}_ref") for _, name, called in NAMES])
        other = F.when(sentence.rlike(SEVERAL), each)
        for pattern, name in PATTERNS:
            other = other.when(sentence.rlike(pattern), name)
        return F.coalesce(F.try_element_at(table, sentence), other)

    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    # Most texts hold no cue: theirs needn't be brought to normal form. Given sentences may have none.
    cue = F.lower(text).rlike(CUES) if sentences is SENTENCES else F.lit(True)
    ids = F.filter(F.transform(F.regexp_extract_all(lines(text), F.lit(known(sentences)), F.lit(0)), lambda s: identify(F.translate(s, LINE, " "))), lambda x: x.isNotNull())
    said = F.when(F.contains(text, F.lit("SPDX-License-Identifier:")), F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))).otherwise(none)
    said = F.transform(said, lambda e: F.regexp_replace(F.regexp_replace(e, "[ \t]+", " "), ROUND, "$1"))
    found = docs.select("doc_id", F.when(cue, ids).otherwise(none).alias("ids"), said.alias("said"))
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(run) + ",").alias("run")) for name, run in rules if run])

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["run"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["run"], F.lit(",|,"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    # Identifiers stand between commas of their own, so that runs can't share one.
    start = F.struct(F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")).alias("left"), F.col("said").alias("found"))
    licenses = F.aggregate(listed, start, apply, lambda state: F.array_join(F.array_sort(F.array_distinct(state["found"])), ","))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.when((F.size("ids") > 0) | (F.size("said") > 0), licenses).otherwise("").alias("licenses"),
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL for texts that hold each known sentence on one line."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = " ".join(f"WHEN {quoted(s)} THEN {quoted(i)}" for s, i in SENTENCES.items())
    each = ", ".join("CASE WHEN regexp_matches(s, {}) THEN {} END".format(quoted(f" {called.replace('.', '[.]')}( or | and | at your |$)"), quoted(f"{name}_ref")) for _, name, called in NAMES)
    forms = f"WHEN regexp_matches(s, {quoted(SEVERAL)}) THEN concat_ws(',', {each}) " + " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(i)}" for p, i in PATTERNS)
    steps, left, names = [], "state0", []
    steps.append("state0 AS (SELECT doc_id, n, ids, said, ',' || coalesce(ids, '') || ',' AS l FROM ids)")
    columns = ""
    for k, (name, run) in enumerate(RULES, 1):
        part = quoted("," + ",".join(run) + ",")
        columns += f", h{k}"
        steps.append(f"state{k} AS (SELECT * REPLACE (replace(l, {part}, ',|,') AS l), CASE WHEN contains(l, {part}) THEN {quoted(name)} END AS h{k} FROM {left})")
        left = f"state{k}"
        names.append(f"h{k}")
    return f"""
WITH sentence AS (
  SELECT rid, doc_id, pos, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9.+]+', ' ', 'g'), '[.]+( |$)', ' ', 'g')) AS s
  FROM (SELECT rid, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw FROM (
    SELECT row_number() OVER () AS rid, doc_id,
           string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), '\\n+') AS parts
    FROM documents))
  WHERE regexp_matches(lower(raw), {quoted(CUES)})
), identified AS (
  SELECT rid, doc_id, pos, coalesce(CASE s {known} END, CASE {forms} END) AS id FROM sentence
), per_doc AS (
  SELECT rid, doc_id, count(id) AS n, string_agg(id, ',' ORDER BY pos) FILTER (WHERE id IS NOT NULL) AS ids FROM identified GROUP BY rid, doc_id
), ids AS (
  SELECT d.doc_id, coalesce(p.n, 0) AS n, p.ids, d.said FROM (SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), {quoted(SPDX)}, 1), lambda e: regexp_replace(regexp_replace(e, '[ \\t]+', ' ', 'g'), {quoted(ROUND)}, '\\1')) AS said FROM documents) d LEFT JOIN per_doc p ON d.rid = p.rid
), {", ".join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(said, list_filter([{", ".join(names)}], lambda x: x IS NOT NULL)))), ','), '') AS licenses
FROM {left}"""
