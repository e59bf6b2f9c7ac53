"""License scans: known sentences become identifiers, and ordered rules recognise licences in the identifier sequence.

A text is normalised (lower-case A-Z, digits, single blanks) with marks where sentences and lines end; the known sentences
that stand between marks are found, however the lines are wrapped and whatever comment signs they begin with. Their
identifiers, in order, are matched against the rules. A rule takes its identifiers away, so that a longer rule that
stands earlier wins over its parts; then come sentences that tell a licence alone, and what is left is unmatched.

Cases: a null or empty text has no licence; rows may repeat, each is scanned by itself; columns other than id and text are
not read. An empty table gives an empty result. Texts are scanned whole. Everything is built from column functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole_text

_GNU = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1} public license as \
published by the free software foundation either version {2} of the license or at your option any later version"
_HOPE = "this {0} is distributed in the hope that it will be useful but without any warranty without even the implied \
warranty of merchantability or fitness for a particular purpose"
_ECLIPSE = "this program and the accompanying materials are made available under the terms of the eclipse public license "
#: Normalised sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software",
    "mit.asis": "the software is provided as is without warranty of any kind express or implied including but not "
    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission",
    "bsd.advertise": "all advertising materials mentioning features or use of this software must display the following "
    "acknowledgement",
    "apache.grant": "licensed under the apache license version 2 0 the license",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl.redistribute": _GNU.format("program", "general", "3"),
    "gpl2.redistribute": _GNU.format("program", "general", "2"),
    "lgpl3.redistribute": _GNU.format("library", "lesser general", "3"),
    "lgpl21.redistribute": _GNU.format("library", "lesser general", "2 1"),
    "lgpl2.redistribute": _GNU.format("library", "library general", "2"),
    "agpl3.redistribute": _GNU.format("program", "affero general", "3"),
    "gpl.hope": _HOPE.format("program"),
    "lgpl.hope": _HOPE.format("library"),
    "gpl.details": "see the gnu general public license for more details",
    "lgpl.details": "see the gnu lesser general public license for more details",
    "lgpl2.details": "see the gnu library general public license for more details",
    "agpl.details": "see the gnu affero general public license for more details",
    "mpl.subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl.copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted",
    "isc.asis": "the software is provided as is and the author disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness",
    "zlib.asis": "this software is provided as is without any express or implied warranty",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial "
    "applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl.line": "distributed under the boost software license version 1 0",
    "epl2.grant": _ECLIPSE + "2 0 which is available at http www eclipse org legal epl 2 0",
    "epl1.grant": _ECLIPSE + "v1 0 which accompanies this distribution and is available at http www eclipse org legal "
    "epl v10 html",
    "cc0.dedicate": "to the extent possible under law the author s have dedicated all copyright and related and "
    "neighboring rights to this software to the public domain worldwide",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "wtfpl.copy": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and "
    "changing it is allowed as long as the name is changed",
    "cddl.subject": "the contents of this file are subject to the terms of the common development and distribution license",
    "artistic.terms": "you can redistribute it and or modify it under the terms of the artistic license 2 0",
    "eupl.grant": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission "
    "subsequent versions of the eupl the licence",
    "line.gpl3": "this work is licensed under the gnu general public license version 3",
    "line.gpl2": "this work is licensed under the gnu general public license version 2",
    "line.ccbync": "licensed under cc by nc 4 0",
    "line.ccby": "licensed under cc by 4 0",
    "line.ccbysa": "licensed under cc by sa 4 0",
    "line.apache": "licensed under the apache license version 2 0",
}
#: Rules of several sentences, in order; a licence and the identifiers that must follow one another among the
#: known sentences.
RULES = [
    ("MIT", ["mit.grant", "mit.notice", "mit.asis"]),
    ("BSD-4-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.advertise", "bsd.endorse"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("Apache-2.0", ["apache.grant", "apache.comply", "apache.copy"]),
    ("GPL-3.0-or-later", ["gpl.redistribute", "gpl.hope", "gpl.details"]),
    ("GPL-2.0-or-later", ["gpl2.redistribute", "gpl.hope", "gpl.details"]),
    ("LGPL-3.0-or-later", ["lgpl3.redistribute", "lgpl.hope", "lgpl.details"]),
    ("LGPL-2.1-or-later", ["lgpl21.redistribute", "lgpl.hope", "lgpl.details"]),
    ("LGPL-2.0-or-later", ["lgpl2.redistribute", "lgpl.hope", "lgpl2.details"]),
    ("AGPL-3.0-or-later", ["agpl3.redistribute", "gpl.hope", "agpl.details"]),
    ("MPL-2.0", ["mpl.subject", "mpl.copy"]),
    ("ISC", ["isc.grant", "isc.asis"]),
    ("0BSD", ["0bsd.grant", "isc.asis"]),
    ("Zlib", ["zlib.asis", "zlib.grant"]),
]
#: Sentences that tell the licence by themselves, where no rule above took them.
SINGLE = {
    "gpl.redistribute": "GPL-3.0-or-later", "gpl2.redistribute": "GPL-2.0-or-later", "lgpl3.redistribute": "LGPL-3.0-or-later",
    "lgpl21.redistribute": "LGPL-2.1-or-later", "lgpl2.redistribute": "LGPL-2.0-or-later",
    "agpl3.redistribute": "AGPL-3.0-or-later", "apache.grant": "Apache-2.0", "mit.grant": "MIT", "mpl.subject": "MPL-2.0",
    "mpl.copy": "MPL-2.0", "isc.grant": "ISC", "0bsd.grant": "0BSD", "zlib.grant": "Zlib", "bsl.line": "BSL-1.0",
    "epl2.grant": "EPL-2.0", "epl1.grant": "EPL-1.0", "cc0.dedicate": "CC0-1.0", "unlicense.free": "Unlicense",
    "wtfpl.copy": "WTFPL", "cddl.subject": "CDDL-1.0", "artistic.terms": "Artistic-2.0", "eupl.grant": "EUPL-1.2",
    "line.gpl3": "GPL-3.0", "line.gpl2": "GPL-2.0", "line.ccbync": "CC-BY-NC-4.0", "line.ccby": "CC-BY-4.0",
    "line.ccbysa": "CC-BY-SA-4.0", "line.apache": "Apache-2.0",
}
#: Licences by their public short names; a tag line or a line of one sentence may name them.
TAGS = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-1.0",
    "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-or-later", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "WTFPL", "CDDL-1.0", "Artistic-2.0", "EUPL-1.2",
]
#: Names of licences in lines such as "Released under the MIT license".
NAMES = {"MIT": "mit", "ISC": "isc", "BSD-2-Clause": "bsd 2 clause", "BSD-3-Clause": "bsd 3 clause", "Zlib": "zlib"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
for _tag in TAGS:
    _plain = re.sub("[^a-z0-9]+", " ", _tag.lower())
    SENTENCES[f"spdx.{_tag}"], SINGLE[f"spdx.{_tag}"] = f"spdx license identifier {_plain}", _tag
for _tag, _name in NAMES.items():
    for _word in ("released", "licensed"):
        SENTENCES[f"line.{_word}.{_tag}"], SINGLE[f"line.{_word}.{_tag}"] = f"{_word} under the {_name} license", _tag
#: Notices have ':', ';' and line ends inside their sentences, so those are places where a known sentence may begin or end,
#: not ends of all of them.
#: What no known sentence runs across, and what one may run across or begin or end at; and their marks.
HARD_END, SOFT_END = r"[.!?][\x20\x09-\x0D]+", r"[:;][\x20\x09-\x0D]+|\n"
_HARD, _SOFT = "\x01", "\x02"
#: Wordings that are put into one form, after normalising: pattern and replacement.
VARIANTS = [
    ("https", "http"),
    (f"neither the names? of[a-z0-9 {_SOFT}]{{1,120}}? nor the names of", "neither the name of the copyright holder nor the names of"),
    ("copy modify and distribute this software", "copy modify and or distribute this software"),
]
#: Texts without any of these words hold no known sentence.
HINT = r"[lL][iI][cC][eE][nN][sS]|[cC][oO][pP][yY]|[rR][eE][dD][iI][sS][tT]|[wW][aA][rR][rR][aA][nN]"
HINT += r"|[eE][nN][dD][oO][rR][sS]|[pP][eE][rR][mM][iI][sS][sS][iI][oO][nN]|[mM][oO][zZ][iI][lL][lL][aA]|[mM][pP][lL]"
HINT += r"|[aA][dD][vV][eE][rR][tT][iI][sS]|[dD][oO][mM][aA][iI][nN]"


def marked(text: Column) -> Column:
    """The text in normal form (lower-case A-Z, digits, single blanks) with a mark at each hard or soft end."""
    out = F.translate(text, _UPPER + _HARD + _SOFT, _LOWER + "  ")
    out = F.regexp_replace(F.regexp_replace(out, HARD_END, _HARD), SOFT_END, _SOFT)
    out = F.regexp_replace(F.concat(F.lit(_HARD), out, F.lit(_HARD)), f"[^a-z0-9{_HARD}{_SOFT}]+", " ")
    out = F.regexp_replace(out, f"[ {_SOFT}]*{_HARD}[ {_HARD}{_SOFT}]*", _HARD)
    out = F.regexp_replace(out, f" *{_SOFT}[ {_SOFT}]*", _SOFT)
    for pattern, one_form in VARIANTS:
        out = F.regexp_replace(out, pattern, one_form)
    return out


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences, in order: those that stand between two ends of any kind, with soft ends for
    blanks. Of sentences that begin at one place the longest counts."""
    book = F.create_map(*[x for k, v in SENTENCES.items() for x in (F.lit(v), F.lit(k))])
    longest = sorted(SENTENCES.values(), key=len, reverse=True)
    any_known = "|".join(s.replace(" ", f"[ {_SOFT}]") for s in longest)
    places = F.lit(f"(?<=[{_HARD}{_SOFT}])(?:{any_known})(?=[{_HARD}{_SOFT}])")
    found = F.regexp_extract_all(marked(text), places, F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(book, F.translate(s, _SOFT, " ")))
    return F.when(text.rlike(HINT), ids).otherwise(F.array().cast("array<string>"))


def _key(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def recognised(ids: Column) -> Column:
    """Struct of the licences (sorted, with how often) and the identifiers that no rule took."""

    def step(rule):
        licence, wanted = rule
        key = _key(wanted)

        def take(acc):
            n = ((F.length(acc["rest"]) - F.length(F.replace(acc["rest"], F.lit(key), F.lit("")))) / len(key)).cast("int")
            return F.struct(
                F.replace(acc["rest"], F.lit(key), F.lit("|")).alias("rest"),
                F.when(n > 0, F.concat(acc["hits"], F.array_repeat(F.lit(licence), n))).otherwise(acc["hits"])
                .alias("hits"),
            )

        return take

    text = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    state = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("hits"))
    for rule in RULES:
        state = let(state, step(rule))
    single = F.create_map(*[F.lit(x) for pair in SINGLE.items() for x in pair])

    def told(hits, rest):
        alone = F.filter(F.transform(rest, lambda i: F.try_element_at(single, i)), lambda x: x.isNotNull())
        unmatched = F.filter(rest, lambda i: F.try_element_at(single, i).isNull())
        return F.struct(F.array_sort(F.concat(hits, alone)).alias("licences"), unmatched.alias("unmatched"))

    return let(state, lambda s: let(
        F.filter(F.split(s["rest"], "[<>|]+", -1), lambda x: x != ""), lambda rest: told(s["hits"], rest)))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``sentence_ids`` (in order), ``licences`` (sorted, each hit) and ``unmatched`` identifiers."""
    both = let(known_sentences(whole_text(text)), lambda ids: F.struct(
        ids.alias("sentence_ids"), recognised(ids).alias("found")))
    return docs.select(F.col(id_col), both.alias("__s")).select(
        id_col, "__s.sentence_ids", "__s.found.licences", "__s.found.unmatched")
