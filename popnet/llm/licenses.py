"""License scans by sentence rules (operator 8, DataFrame functions only).

A text is brought to lower-case words in which a bar stands for the end of a sentence or a
paragraph and a slash for a line end; signs that begin comment lines go.  A known licence
sentence begins where a sentence, a paragraph or a line does, may be wrapped over lines, and
may go on.  Leads such as "this project is distributed under the terms of the" are brought
to one form, and years and holders are variable parts.  A known sentence gets its
identifier, one letter; the identifiers of a text, in order of place, are matched against
the ordered rules.  A rule is a sequence of identifiers that must follow each other with at
most ``GAP`` sentence ends between; the first rule that matches at an identifier wins, and
matching goes on behind it.  A known sentence that no rule takes is reported as unmatched.

All work is inside a row: no shuffle, no join; the tables are literals.  ``scan`` takes
other tables as well.

Defined cases: null or empty texts have no findings; repeated rows are scanned again; long
texts are read whole, by patterns without nested repeats; further columns, whatever their
names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popnet.llm.shared import table

#: Identifier and how a sentence begins (public licence wording); several may share an identifier.
#: "Licensed under" stands for all leads; <year> and <holder> are variable parts.
SENTENCES = (
    ("A", "Licensed under Apache License, Version 2.0"), ("A", "Licensed under Apache License 2.0"), ("A", "Licensed under Apache 2.0 License"), ("A", "SPDX-License-Identifier: Apache-2.0"),
    ("B", "you may not use this file except in compliance with the License"), ("C", "You may obtain a copy of the License at"),
    ("D", "Licensed under MIT License"), ("D", "SPDX-License-Identifier: MIT"), ("D", "Use of this source code is governed by an MIT-style license"),
    ("E", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("F", "Licensed under GNU General Public License, version 3"), ("F", "Licensed under GNU General Public License v3.0"), ("F", "Licensed under GNU GPL v3"), ("F", "SPDX-License-Identifier: GPL-3.0-only"),
    ("G", "either version 3 of the License, or (at your option) any later version"), ("G", "either version 3 of the License, or any later version"),
    ("H", "Licensed under CC BY-NC 4.0"), ("H", "Licensed under Creative Commons Attribution-NonCommercial 4.0"), ("H", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("I", "Licensed under CC BY 4.0"), ("I", "Licensed under Creative Commons Attribution 4.0"), ("I", "SPDX-License-Identifier: CC-BY-4.0"),
    ("J", "Licensed under CC BY-NC-SA 4.0"), ("J", "Licensed under Creative Commons Attribution-NonCommercial-ShareAlike 4.0"), ("J", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    ("K", "All rights reserved"),
    ("L", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("L", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("M", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("M", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("N", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("N", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"),
    ("N", "Licensed under GNU General Public License, version 2"), ("N", "Licensed under GNU General Public License v2.0"), ("N", "SPDX-License-Identifier: GPL-2.0-only"),
    ("O", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("O", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("P", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("P", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("P", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("Q", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("R", "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("S", "Licensed under BSD 2-Clause License"), ("S", "Licensed under Simplified BSD License"), ("S", "SPDX-License-Identifier: BSD-2-Clause"),
    ("T", "Licensed under BSD 3-Clause License"), ("T", "Licensed under New BSD License"), ("T", "SPDX-License-Identifier: BSD-3-Clause"),
    ("U", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), ("U", "Licensed under Mozilla Public License 2.0"), ("U", "Licensed under Mozilla Public License, version 2.0"), ("U", "SPDX-License-Identifier: MPL-2.0"),
    ("V", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"), ("V", "Licensed under ISC License"), ("V", "SPDX-License-Identifier: ISC"),
    ("W", "Licensed under CC0 1.0"), ("W", "This work is dedicated to the public domain under CC0 1.0"), ("W", "SPDX-License-Identifier: CC0-1.0"),
    ("X", "Licensed under CC BY-SA 4.0"), ("X", "Licensed under Creative Commons Attribution-ShareAlike 4.0"), ("X", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("Y", "Licensed under CC BY-ND 4.0"), ("Y", "Licensed under Creative Commons Attribution-NoDerivatives 4.0"), ("Y", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("Z", "Licensed under CC BY-NC-ND 4.0"), ("Z", "Licensed under Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"), ("Z", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    ("a", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("a", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("b", "Licensed under GNU Affero General Public License, version 3"), ("b", "Licensed under GNU Affero General Public License v3.0"), ("b", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("c", "Copyright (c) <year>"), ("c", "Copyright <year>"),
    ("d", "Redistributions of source code must retain the above copyright notice"), ("e", "Redistributions in binary form must reproduce the above copyright notice"),
    ("f", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("g", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"), ("g", "SPDX-License-Identifier: 0BSD"),
    ("h", "This is free and unencumbered software released into the public domain"), ("h", "SPDX-License-Identifier: Unlicense"),
    ("i", "Licensed under Boost Software License, Version 1.0"), ("i", "SPDX-License-Identifier: BSL-1.0"),
    ("j", "This software is provided 'as-is', without any express or implied warranty"), ("k", "Permission is granted to anyone to use this software for any purpose, including commercial applications"), ("l", "SPDX-License-Identifier: Zlib"),
    ("m", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"), ("m", "Licensed under Eclipse Public License 2.0"), ("m", "SPDX-License-Identifier: EPL-2.0"),
    ("n", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"), ("o", "Use of this source code is governed by a BSD-style license"),
    ("p", "Licensed under GNU Lesser General Public License, version 2.1"), ("p", "SPDX-License-Identifier: LGPL-2.1-only"), ("q", "Licensed under GNU Lesser General Public License, version 3"), ("q", "SPDX-License-Identifier: LGPL-3.0-only"),
)
#: Rule name, the sequence of sentence identifiers, and the SPDX name; the first that fits wins.
RULES = (
    ("apache-header", "ABC", "Apache-2.0"), ("apache-notice", "AB", "Apache-2.0"), ("apache-line", "A", "Apache-2.0"),
    ("mit-text", "cEn", "MIT"), ("mit-text", "DcE", "MIT"), ("mit-text", "DE", "MIT"), ("mit-text", "En", "MIT"), ("mit-line", "D", "MIT"), ("mit-grant", "E", "MIT"),
    ("agpl-notice", "a", "AGPL-3.0-or-later"), ("agpl-later", "bG", "AGPL-3.0-or-later"), ("agpl-line", "b", "AGPL-3.0-only"),
    ("gpl-notice", "L", "GPL-3.0-or-later"), ("gpl-later", "FG", "GPL-3.0-or-later"), ("gpl-line", "F", "GPL-3.0-only"), ("gpl2-notice", "M", "GPL-2.0-or-later"), ("gpl2-line", "N", "GPL-2.0-only"),
    ("lgpl21-notice", "O", "LGPL-2.1-or-later"), ("lgpl21-line", "p", "LGPL-2.1-only"), ("lgpl3-notice", "P", "LGPL-3.0-or-later"), ("lgpl3-later", "qG", "LGPL-3.0-or-later"), ("lgpl3-line", "q", "LGPL-3.0-only"),
    ("bsd4-text", "QdefR", "BSD-4-Clause"), ("bsd3-text", "QdeR", "BSD-3-Clause"), ("bsd3-text", "QR", "BSD-3-Clause"), ("bsd2-text", "Qde", "BSD-2-Clause"), ("bsd2-text", "Q", "BSD-2-Clause"),
    ("bsd2-line", "S", "BSD-2-Clause"), ("bsd3-line", "T", "BSD-3-Clause"), ("bsd-style", "o", "LicenseRef-BSD-Style"),
    ("mpl", "U", "MPL-2.0"), ("isc", "V", "ISC"), ("zero-bsd", "g", "0BSD"), ("unlicense", "h", "Unlicense"), ("boost", "i", "BSL-1.0"), ("zlib-text", "jk", "Zlib"), ("zlib-line", "l", "Zlib"), ("eclipse", "m", "EPL-2.0"),
    ("cc0", "W", "CC0-1.0"), ("cc-by-sa", "X", "CC-BY-SA-4.0"), ("cc-by", "I", "CC-BY-4.0"), ("cc-by-nc", "H", "CC-BY-NC-4.0"), ("cc-by-nd", "Y", "CC-BY-ND-4.0"), ("cc-by-nc-sa", "J", "CC-BY-NC-SA-4.0"), ("cc-by-nc-nd", "Z", "CC-BY-NC-ND-4.0"),
    ("reserved", "cK", "LicenseRef-All-Rights-Reserved"), ("reserved", "K", "LicenseRef-All-Rights-Reserved"),
)
#: Sentence ends that may stand between two sentences of a rule: a BSD clause has a number with a stop before it, and two sentences.
GAP = 8
#: What may stand for "licensed under", in normalised words.
LEAD = "(?:this (?:project|software|work|code|file|library|package|program|repository|document) is )?(?:licensed|released|distributed|available|made available) under (?:(?:the|a|an) )?(?:terms of (?:the |a )?)?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of the normal form: pattern and replacement, in Spark's and in the SQL's dialect where they differ.
_BLANK = r"[ \t*#;%>\n-]*"
_STEPS = (
    ("\r\n?", "\n", None), ("[|/]", " ", None), (r"\bv\. (?=[0-9])", "v ", (r"\bv\. ([0-9])", r"v \1")), (r"[.!?](?=[ \t\n]|\z)", " | ", (r"[.!?]([ \t\n]|\z)", r" | \1")),
    (rf"\n{_BLANK}(?=\n)", " | ", (rf"\n{_BLANK}\n", " | \n")), ("\n", " / ", None), ("[^a-z0-9|/]+", " ", None),
)


def _plain(text: str) -> str:
    """A sentence of the table in normalised words, variable parts kept."""
    return " ".join(re.sub(r"[^a-z0-9<>]+", " ", re.sub(r"\bv\. (?=\d)", "v ", text.lower())).split())


def _tables(sentences: tuple, rules: tuple, gap: int) -> tuple[dict[str, str], list[tuple[str, str]], str, str]:
    """(identifiers of fixed sentences, patterns of variable ones, the pattern of all sentences, the pattern of rules)."""
    known = {_plain(s): i for i, s in sentences if "<" not in s}
    parts = {"<year>": "[0-9]{4}(?: [0-9]{4})*", "<holder>": "[a-z0-9]+(?: [a-z0-9]+){0,7}"}
    variable, phrases = [], []
    for i, s in sentences:
        words = _plain(s).split(" ")
        if "<" in s:
            variable.append((" ".join(parts.get(w, w) for w in words), i))
        # a sentence may be wrapped: a slash between two words
        wrapped = [parts[w].replace(" ", " (?:/ )?") if w in parts else w for w in words]
        if words[:2] == ["licensed", "under"]:
            wrapped = [LEAD.replace(" ", " (?:/ )?") + wrapped[2], *wrapped[3:]]
        phrases.append((len(_plain(s)), " (?:/ )?".join(wrapped)))
    alternatives = "|".join(p for _, p in sorted(phrases, key=lambda x: (-x[0], x[1])))
    between = r"\.{0,%d}" % gap
    return known, variable, alternatives, "|".join(between.join(seq) for _, seq, _ in rules) + "|[A-Za-z]"


def normalised(text: Column) -> Column:
    """A text's words, with bars and slashes for ends (see above)."""
    out = F.translate(text, _UPPER, _LOWER)
    for pattern, new, _ in _STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def scan(docs: DataFrame, sentences: tuple = SENTENCES, rules: tuple = RULES, gap: int = GAP) -> DataFrame:
    """doc_id, sentence_ids (a letter a known sentence, in order), rules (array), licenses (sorted distinct array), unmatched (long).

    ``sentences`` are (identifier, beginning), ``rules`` (name, identifiers, licence); identifiers are ASCII letters.
    """
    known, variable, phrases, pattern = _tables(sentences, rules, gap)
    found = F.regexp_extract_all(normalised(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(rf"((?:^|[|/] )[|/ ]*(?:{phrases})(?![a-z0-9])|\|)"), F.lit(1))
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")

    def identifier(hit: Column) -> Column:
        words = F.regexp_replace(F.trim(F.regexp_replace(hit, "[|/ ]+", " ")), f"^{LEAD}", "licensed under ")
        out = F.coalesce(F.try_element_at(lookup, words), F.lit("."))
        for p, i in variable:
            out = F.when(words.rlike(f"^(?:{p})$"), i).otherwise(out)
        return F.when(hit == "|", ".").otherwise(out)

    rows = docs.select("doc_id", F.array_join(F.transform(found, identifier), "").alias("coded"))
    hits = F.transform(F.regexp_extract_all("coded", F.lit(f"({pattern})"), F.lit(1)), lambda h: F.replace(h, F.lit("."), F.lit("")))
    by_sequence = F.create_map(*[F.lit(x) for name, seq, _ in rules for x in (seq, name)])
    spdx = F.create_map(*[F.lit(x) for _, seq, label in rules for x in (seq, label)])
    rows = rows.select("doc_id", F.replace("coded", F.lit("."), F.lit("")).alias("sentence_ids"), hits.alias("hits"))
    taken = F.filter("hits", lambda h: F.try_element_at(by_sequence, h).isNotNull())
    rows = rows.select("doc_id", "sentence_ids", "hits", taken.alias("taken"))
    return rows.select(
        "doc_id", "sentence_ids", F.transform("taken", lambda h: F.element_at(by_sequence, h)).alias("rules"),
        F.array_sort(F.array_distinct(F.transform("taken", lambda h: F.element_at(spdx, h)))).alias("licenses"),
        (F.size("hits") - F.size("taken")).cast("long").alias("unmatched"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence findings."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "sentence_ids", F.array_join("rules", ",").alias("rules"),
        F.array_join("licenses", ",").alias("licenses"), F.size("rules").cast("long").alias("n_rules"), "unmatched",
    )


def op8_sql() -> str:
    """The same in DuckDB: hits unnested, looked up by a join, and put together again."""
    known, variable, phrases, pattern = _tables(SENTENCES, RULES, GAP)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    for p, new, other in _STEPS:
        p, new = other or (p, new)
        text = f"regexp_replace({text}, {quoted(p)}, {quoted(new)}, 'g')"
    values = ", ".join(f"({quoted(s)}, '{i}')" for s, i in known.items())
    rules = ", ".join(f"('{seq}', '{name}', '{spdx}')" for name, seq, spdx in RULES)
    cases = " ".join(f"WHEN regexp_full_match(words, {quoted(p)}) THEN '{i}'" for p, i in variable)
    return rf"""
WITH known(words, sid) AS (VALUES {values}), rules(seq, rule, spdx) AS (VALUES {rules}),
texts AS (SELECT doc_id, regexp_extract_all(trim({text}, ' '), {quoted(rf"((?:^|[|/] )[|/ ]*(?:{phrases})(?: |$)|\|)")}, 1) AS found FROM documents),
hits AS (SELECT doc_id, unnest(found) AS hit, generate_subscripts(found, 1) AS pos FROM texts),
plain AS (SELECT doc_id, pos, hit, regexp_replace(trim(regexp_replace(hit, '[|/ ]+', ' ', 'g'), ' '), {quoted("^" + LEAD)}, 'licensed under ') AS words FROM hits),
coded AS (
  SELECT doc_id, string_agg(CASE WHEN hit = '|' THEN '.' {cases} ELSE coalesce(sid, '.') END, '' ORDER BY pos) AS coded
  FROM plain LEFT JOIN known USING (words) GROUP BY doc_id
), whole AS (SELECT doc_id, coalesce(coded, '') AS coded FROM documents LEFT JOIN coded USING (doc_id)),
matched AS (
  SELECT doc_id, unnest(regexp_extract_all(coded, '({pattern})', 1)) AS h, generate_subscripts(regexp_extract_all(coded, '({pattern})', 1), 1) AS pos FROM whole
), named AS (SELECT doc_id, pos, rule, spdx FROM matched LEFT JOIN rules ON seq = replace(h, '.', '')),
summed AS (
  SELECT doc_id, coalesce(string_agg(rule, ',' ORDER BY pos), '') AS rules, coalesce(string_agg(DISTINCT spdx, ',' ORDER BY spdx), '') AS licenses,
    count(rule) AS n_rules, count(*) - count(rule) AS unmatched FROM named GROUP BY doc_id
)
SELECT doc_id, replace(coded, '.', '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses,
  CAST(coalesce(n_rules, 0) AS BIGINT) AS n_rules, CAST(coalesce(unmatched, 0) AS BIGINT) AS unmatched
FROM whole LEFT JOIN summed USING (doc_id)
"""
