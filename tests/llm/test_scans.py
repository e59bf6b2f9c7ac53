"""Licence scans and decontamination against plain Python."""

import random
import re
import textwrap

import duckdb
import numpy as np
import pytest

from flowtide.llm import decontaminate, license_scan, queries

from ..oracle import differences
from .helpers import SF, documents, prose

S = license_scan.SENTENCES


def plain_licences(text):
    """The rules over the pieces between marks: at each piece the longest run of pieces that is a known sentence."""
    def normal(s):
        return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in s)).strip()

    book, ids = {v: k for k, v in S.items()}, []
    for part in re.split(license_scan.HARD_END + r"|\n[\x20\x09\x0D]*\n", text):
        part = "\x02".join(filter(None, map(normal, re.split(license_scan.SOFT_END, part))))
        for pattern, one_form in license_scan.VARIANTS:
            part = re.sub(pattern, one_form, part)
        pieces, at = part.split("\x02"), 0
        while at < len(pieces):
            end = next((e for e in range(len(pieces), at, -1) if " ".join(pieces[at:e]) in book), None)
            if end:
                ids.append(book[" ".join(pieces[at:end])])
            at = end or at + 1
    rest, hits = "".join(f"<{i}>" for i in ids), []
    for licence, wanted in license_scan.RULES:
        key = "".join(f"<{w}>" for w in wanted)
        hits += [licence] * rest.count(key)
        rest = rest.replace(key, "|")
    left = [x for x in re.split(r"[<>|]+", rest) if x]
    return ids, sorted(hits + [license_scan.SINGLE[x] for x in left if x in license_scan.SINGLE]), [
        x for x in left if x not in license_scan.SINGLE]


def test_licences_equal_plain_python(spark):
    rng = random.Random(16)
    sentences = [s.capitalize() for s in S.values()]
    texts = ["", None, ". ".join(S[k] for k in ("mit.grant", "mit.notice", "mit.asis")) + "."]
    texts += ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted "
              "provided that the following conditions are met:\n\nNothing else.", "# Released under the MIT License.\nx"]
    for _ in range(60):
        parts = rng.choices(sentences + ["Some words here", "Copyright 2020 A"], k=rng.randrange(8))
        texts.append("".join(p + rng.choice([". ", ".\n", "\n\n", "! "]) for p in parts))
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.sentence_ids, r.licences, r.unmatched) == plain_licences(t or ""), t
    assert got[2].licences == ["MIT"] and got[3].unmatched == ["bsd.grant"] and got[4].licences == ["MIT"]


def test_longer_rules_win_and_odd_tables(spark):
    three = ". ".join(S[k] for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"))
    docs = documents(spark, [three, three], ids=[None, None]).withColumnRenamed("lang", "licences")
    assert [r.licences for r in license_scan.scan(docs).collect()] == [["BSD-3-Clause"]] * 2
    assert license_scan.scan(documents(spark, [])).collect() == []


# Wording of public licence notices.
GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General \
Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any \
later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied \
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
BSD2 = """Copyright (c) 2020, A. Writer
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the \
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following \
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following \
disclaimer in the documentation and/or other materials provided with the distribution.
"""
NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated \
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the \
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit \
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the \
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE \
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS""",
    "BSD-2-Clause": BSD2 + "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS",
    "BSD-3-Clause": BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products \
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS""",
    "Apache-2.0": """Copyright 2020 A. Writer

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the \
License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law""",
    "GPL-3.0-or-later": GPL.format(":", ",", 3),
    "GPL-2.0-or-later": GPL.format(";", ";", 2),
}
GNU = GPL.split("PURPOSE")[0]
NOTICES |= {
    "LGPL-2.1-or-later": GNU.format(";", ";", 2.1).replace("program", "library").replace("General", "Lesser General")
    + "PURPOSE.  See the GNU\nLesser General Public License for more details.",
    "AGPL-3.0-or-later": GNU.format(":", ",", 3).replace("General", "Affero General")
    + "PURPOSE.  See the GNU Affero General Public License for more details.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL \
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby \
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL \
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be \
held liable.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it \
and redistribute it freely, subject to the following restrictions:

1. The origin""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public \
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring \
rights to this software to the public domain worldwide. This""",
}
#: Texts of a holder's own name.
OWN = BSD2 + """
3. Neither the name of the Regents of the University nor the names of its contributors may be used to endorse or promote \
products derived from this software without specific prior written permission.
"""


def test_sql_finds_the_same_in_notices(spark):
    texts = [OWN, OWN.replace("3. Neither", "3. All advertising materials mentioning features or use of this software must display "
                              "the following acknowledgement:\nThis product.\n4. Neither"), None, ""]
    for notice in [*NOTICES.values(), *(f"SPDX-License-Identifier: {t}" for t in license_scan.TAGS)]:
        for width in (30, 75, 1000):
            lines = [x for p in notice.split("\n") for x in (textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False) or [""])]
            texts += ["\n".join(f"{sign}{x}".rstrip() for x in ["tool.c: a tool", *lines]) for sign in ("", " * ", "# ")]
    docs = documents(spark, texts)
    got = queries.license_columns(license_scan.scan(docs)).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert differences(got, con.sql(queries.ORACLES["op2_license_scan"]).df()) == ""
    told = dict(zip(got["doc_id"], got["licences"]))
    assert told[0] == "BSD-3-Clause" and told[1] == "BSD-4-Clause" and told[2] == told[3] == ""
    want = [x for n in [*NOTICES, *license_scan.TAGS] for x in [n] * 9]
    assert [told[i + 4] for i in range(len(want))] == want
    assert len(set(license_scan.SINGLE.values()) | {n for n, _ in license_scan.RULES}) >= 25


SPDX = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0-or-later", "BSD-3-Clause": "BSD-3-Clause"}


def test_notices_are_recognised_wrapped_and_behind_comment_signs(spark):
    texts, want = [], []
    for licence, notice in NOTICES.items():
        for width in (30, 60, 75, 1000):
            kept = {"break_long_words": False, "break_on_hyphens": False}
            lines = [x for p in notice.split("\n") for x in (textwrap.wrap(p, width, **kept) or [""])]
            for sign in ("", "# ", " * ", "// ", ";; "):
                texts.append("\n".join(f"{sign}{x}".rstrip() for x in ["tool.c: a tool", *lines]))
                want.append(licence)
    for name, licence in SPDX.items():
        line = f"SPDX-License-Identifier: {name}"
        texts += [line, f"#!/bin/sh\n# {line}\n# Copyright 2020 A\nx=1", f"/* {line} */\nint x;", f"<!-- {line} -->\n"]
        want += [licence] * 4
    texts += ["SPDX-License-Identifier: MIT OR Zlib", "Not released under the MIT license"]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    for i, licence in enumerate(want):
        assert (got[i].licences, got[i].unmatched) == ([licence], []), texts[i]
    assert not got[len(want)].sentence_ids and not got[len(want) + 1].sentence_ids


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_prefixes():
    rng = np.random.default_rng(17)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        row = decontaminate.edit_distance(a, b, 99)
        assert row.tolist() == [plain_distance(a, b[:n]) for n in range(len(b) + 1)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "zz" + prose(rng, 1)
        elif kind == 1:
            out.insert(at, "yy" + prose(rng, 1))
        else:
            del out[at]
    return out


def test_recall_at_the_largest_distance_and_no_false_leak(spark):
    rng = random.Random(18)
    items = [(k, prose(rng, rng.randrange(12, 60))) for k in range(40)]
    texts, want = [], set()
    for k, text in items:
        words = decontaminate.words_of(text)
        for edits in (0, 1, decontaminate.allowed(len(words))):
            copy = edited(rng, words, edits)
            if plain_distance(words, copy) <= decontaminate.allowed(len(words)):
                want.add((len(texts), k))
            texts.append(" ".join([prose(rng, 40), *copy, prose(rng, rng.choice([0, 40]))]).replace(" ", "  \n", 3))
    clean = len(texts)
    texts += [prose(rng, 300) for _ in range(60)]
    found = decontaminate.find_leaks(documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert len(want & set(got)) >= 0.97 * len(want) and all(d < clean for d, _ in got)
    for (d, k), r in got.items():
        window = decontaminate.words_of(texts[d])[r.first_word:r.end_word]
        assert plain_distance(decontaminate.words_of(items[k][1]), window) == r.edits


@pytest.mark.parametrize("tables", [400, 1])
def test_all_windows_near_an_item_are_found(spark, monkeypatch, tables):
    """Against brute force over every window of every text, planted or near by chance; with too few tables too."""
    monkeypatch.setattr(decontaminate, "MOST_TABLES", tables)
    rng = random.Random(20)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(6, 13)))) for k in range(25)]
    texts = [" ".join(rng.choices([*words, "zz"], k=rng.randrange(0, 60))) for _ in range(60)]
    texts += [" ".join([*rng.choices(words, k=5), *edited(rng, items[k % 25][1].split(), 1)]) for k in range(50)]
    index = decontaminate.Index(items)
    assert (index.all_pairs != set()) == (tables == 1)
    assert all(r >= decontaminate.TARGET_RECALL or n in index.all_pairs for n, r in index.recall.items())
    want = {}
    for t, text in enumerate(texts):
        row = text.split()
        for k, item in items:
            item = item.split()
            most = decontaminate.allowed(len(item))
            near = [plain_distance(item, row[a:b]) for a in range(len(row))
                    for b in range(max(a + 1, a + len(item) - most), min(len(row), a + len(item) + most) + 1)]
            if near and min(near) <= most:
                want[t, k] = min(near)
    docs = documents(spark, texts)
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(
        docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(want) > 50 and got.keys() <= want.keys() and len(got) >= (0.97 if tables > 1 else 1) * len(want)
    assert all(e >= want[key] for key, e in got.items())
    assert sum(e == want[key] for key, e in got.items()) >= 0.97 * len(got)


def test_whole_items_in_all_documents_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    normal = {r.doc_id: f" {' '.join(decontaminate.words_of(r.text))} " for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in normal.items()
            if f" {' '.join(decontaminate.words_of(r.text))} " in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert want and want <= got


@pytest.mark.parametrize("chars", [500_000, 100])
def test_blocks_and_odd_tables(spark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    items = spark.createDataFrame(
        [(1, "Alpha beta gamma delta epsilon zeta."), (2, "alpha BETA gamma, delta epsilon zeta"), (3, None), (4, ""),
         (None, "one two three four five six seven")], "item_id bigint, text string")
    docs = documents(spark, ["x alpha beta gamma delta\nepsilon zeta", None, "", "one two three four five six seven",
                             "alpha beta", "quite other words stand here"], ids=[1, 2, 3, None, 5, 6])
    docs = docs.withColumnRenamed("lang", "item_id")
    got = [tuple(r) for r in decontaminate.find_leaks(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1, 7, 0), (1, 2, 1, 7, 0), (None, None, 0, 7, 0)], key=str)
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6]
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), items).collect() == []
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 6
