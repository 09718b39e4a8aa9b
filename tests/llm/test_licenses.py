"""Licences in the forms in which files carry them: headers, wrapped, behind comment marks, with holders and years."""

import textwrap

import pytest

from popnet.llm import licenses

NOTICE = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
MIT = """MIT License

Copyright (c) 2021 Jane Roe and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Copyright (c) 2001-2019, Some University of Somewhere. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.
"""
ADVERTISED = "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software.\n"
NEITHER = "\n{n}. Neither the name of the University of Somewhere nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ANY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Texts as licences' own pages give them, by hand, with what they are.
LABELLED = [
    ('Copyright 2019 The Authors.\n\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software is distributed as is.', ["Apache-2.0"]),
    (MIT, ["MIT"]), ("This project is licensed under the terms of the MIT license.", ["MIT"]), (BSD, ["BSD-2-Clause"]), (BSD + NEITHER.format(n=3), ["BSD-3-Clause"]), (BSD + ADVERTISED + NEITHER.format(n=4), ["BSD-4-Clause"]),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ["LicenseRef-BSD-Style"]),
    (NOTICE.format(what="program", name="General Public License", v=3), ["GPL-3.0-or-later"]), (NOTICE.format(what="program", name="General Public License", v=2), ["GPL-2.0-or-later"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0-only"]),
    (NOTICE.format(what="program", name="Affero General Public License", v=3), ["AGPL-3.0-or-later"]), (NOTICE.format(what="library", name="Lesser General Public License", v="2.1"), ["LGPL-2.1-or-later"]),
    (NOTICE.format(what="library", name="Lesser General Public License", v=3), ["LGPL-3.0-or-later"]), (NOTICE.format(what="program", name="Lesser General Public License", v=3), ["LGPL-3.0-or-later"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.", ["MPL-2.0"]),
    (ANY + ", provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]), (ANY + ".", ["0BSD"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.", ["Unlicense"]), ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", ["BSL-1.0"]),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications.", ["Zlib"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at a page.", ["EPL-2.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]), ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-4.0"]), ("Licensed under CC0 1.0.", ["CC0-1.0"]),
    ("This software is distributed under the terms of the GNU General Public License v3.0.", ["GPL-3.0-only"]), ("This library is distributed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1-only"]),
    ("This code is released under the GNU Affero General Public License, version 3.", ["AGPL-3.0-only"]), ("Copyright 2020 A. Holder\nAll rights reserved.", ["LicenseRef-All-Rights-Reserved"]), ("Licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-only"]),
]
#: No licence: mentions inside a sentence, and what a licence's words have in common with prose.
CLEAN = [
    "It is not released under the MIT License.", "The program was free, and you may copy it.", "We discussed the Apache License, Version 2.0, at length.", "Redistribution of wealth and its use are permitted topics.",
    "His permission is hereby withdrawn.", "Licensed underwriters attended.", "The copyright of 2020 expired.", "",
]


def dressed(text, form):
    """A text as it is, wrapped at 60 characters, or wrapped behind comment marks."""
    if form == "plain":
        return text
    lines = [x for part in text.split("\n") for x in (textwrap.wrap(part, 60) or [""])]
    first, mark, last = {"wrapped": ("", "", ""), "hash": ("", "# ", ""), "slashes": ("", "// ", ""), "stars": ("/*\n", " * ", "\n */"), "dashes": ("", "-- ", "")}[form]
    return first + "\n".join((mark + x).rstrip() for x in lines) + last + "\ncode follows\n"


@pytest.mark.parametrize("form", ["plain", "wrapped", "hash", "slashes", "stars", "dashes"])
def test_labelled_headers(spark, form):
    rows = [(i, dressed(t, form), "x") for i, (t, _) in enumerate([*LABELLED, *[(c, []) for c in CLEAN]])]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()}
    for i, (t, want) in enumerate(LABELLED):
        assert [x for x in got[i] if x != "LicenseRef-All-Rights-Reserved" or x in want] == want, (form, t)
    assert all(got[len(LABELLED) + i] == [] for i in range(len(CLEAN)))


def test_every_licence_is_known_by_its_short_form(spark):
    short = sorted({(i, s) for i, s in licenses.SENTENCES if s.startswith("SPDX")})
    rows = [(n, f"#!/bin/sh\n# {s}\ncode") for n, (_, s) in enumerate(short)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[n] for n in range(len(rows))] == [[s.split(": ")[1]] for _, s in short]


def test_a_table_of_ones_own(spark):
    docs = spark.createDataFrame([(0, "Text.\nmore"), (1, None), (2, "a text"), (3, "Text of <b>\nText")], "doc_id long, text string")
    own = licenses.scan(docs, (("Z", "Text"),), (("own", "Z", "X-1"),)).collect()
    assert [(r["sentence_ids"], r["rules"]) for r in own] == [("Z", ["own"]), ("", []), ("", []), ("ZZ", ["own", "own"])]


def test_long_runs_of_blanks_and_stops(spark):
    docs = spark.createDataFrame([(0, "\n" * 200_000 + "Licensed under CC0 1.0."), (1, ". " * 200_000 + "Licensed under CC0 1.0."), (2, "| / " * 100_000 + "\nAll rights reserved"), (3, "Licensed under " * 50_000)], "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan(docs).collect()] == [["CC0-1.0"], ["CC0-1.0"], ["LicenseRef-All-Rights-Reserved"], []]
