"""Licence scan by sentence-rule recognition.

A text is normalised to words (A-Z in lower case, runs of letters a-z and digits),
whatever lines and marks they run across, and known licence sentences are found
among them by one automaton: from the left, the longest first, none overlapping.
A known sentence may have a gap (``*``) of any number of words, for the name of a
holder; its two parts are found like sentences, and a first part counts if the
next part of that sentence is its second.  Titles count only from the beginning
of a line to the end of one.  The identifiers, in order of their first places,
form a sequence, which ordered rules turn into licences: a rule whose identifiers
stand next to one another in the sequence takes them away from the rules after
it, so full notices win over the sentences they share.

What follows ``SPDX-License-Identifier:`` on its line is an expression, whose known
licences (but for what stands after ``WITH``) count one by one; their identifiers
follow those of the sentences.

All of it is within the row; nothing is shuffled.  Defined results: a null text
counts as empty; a text without known sentences has an empty sequence and no
licences, an empty table no rows; a very long text is read whole; a repeated
sentence counts once, at its first place; repeated rows get equal results.
Ill-formed UTF-8 counts as U+FFFD.  Only doc_id and text are read, whatever other
columns are named.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised (fixed values): identifier, text.  Identifiers of titles end in "title".
SENTENCES = """
mit.grant|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
mit.notice|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit.disclaim|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit.name|released under the mit license
mit.name|licensed under the mit license
mit.name|this project is licensed under the mit license
mit.name|distributed under the mit license
mit.title|mit license
mit.title|the mit license mit
isc.grant|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
bsd.grant|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd.source|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd.binary|redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd.disclaim|this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd.endorse|neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd.endorse|the name of * may not be used to endorse or promote products derived from this software without specific prior written permission
isc.disclaim|the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
zlib.grant|permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
bsl.grant|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
epl.name|this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0
lgpl.free|this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
agpl.free|this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
apache.name|licensed under the apache license version 2 0
apache.name|licensed under the apache license version 2 0 the license
apache.name|released under the apache license version 2 0
apache.limit|you may not use this file except in compliance with the license
apache.copy|you may obtain a copy of the license at
apache.title|apache license version 2 0
gpl3.name|this work is licensed under the gnu general public license version 3
gpl3.name|licensed under the gnu general public license version 3
gpl3.name|licensed under the gnu general public license v3 0
gpl2.name|licensed under the gnu general public license version 2
gpl.free|this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl.free2|this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl.hope|this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
lgpl.name|licensed under the gnu lesser general public license version 3
agpl.name|licensed under the gnu affero general public license version 3
mpl.name|this source code form is subject to the terms of the mozilla public license v 2 0
mpl.copy|if a copy of the mpl was not distributed with this file you can obtain one at
mpl.name|licensed under the mozilla public license version 2 0
ccbync.name|licensed under cc by nc 4 0
ccby.name|licensed under cc by 4 0
ccbysa.name|licensed under cc by sa 4 0
ccbync.name|this work is licensed under a creative commons attribution noncommercial 4 0 international license
ccby.name|this work is licensed under a creative commons attribution 4 0 international license
ccbysa.name|this work is licensed under a creative commons attribution sharealike 4 0 international license
cc0.name|licensed under cc0 1 0
unlicense.name|this is free and unencumbered software released into the public domain
reserved|all rights reserved
apache.title|apache license version 2 0 january 2004
apache.basis|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
apache.name|licensed under the apache 2 0 license
apache.name|licensed under apache 2 0
apache.name|released under the apache 2 0 license
apache.name|under the terms of the apache license version 2 0
dual.apachemit|licensed under the apache license version 2 0 or the mit license
dual.apachemit|licensed under either of apache license version 2 0 * or mit license
dual.apachemit|licensed under the mit or apache 2 0 license
dual.apachemit|dual licensed under the mit and apache 2 0 licenses
dual.apachemit|licensed under the mit license or the apache license version 2 0
mit.name|under the terms of the mit license
mit.name|available under the mit license
mit0.grant|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
ncsa.grant|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
zbsd.grant|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc.grant|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc.title|isc license
isc.name|licensed under the isc license
bsd3.title|bsd 3 clause license
bsd2.title|bsd 2 clause license
bsd3.name|licensed under the bsd 3 clause license
bsd2.name|licensed under the bsd 2 clause license
postgres.grant|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
gpl3.full|gnu general public license version 3 29 june 2007
gpl2.full|gnu general public license version 2 june 1991
lgpl3.full|gnu lesser general public license version 3 29 june 2007
lgpl21.full|gnu lesser general public license version 2 1 february 1999
agpl3.full|gnu affero general public license version 3 19 november 2007
gpl3.name|under the terms of the gnu general public license version 3
gpl2.name|under the terms of the gnu general public license version 2
gpl3.name|licensed under the gnu gpl v3
gpl3.name|licensed under the gpl v3
gpl3.name|licensed under gplv3
gpl2.name|licensed under the gnu gpl v2
gpl2.name|licensed under the gpl v2
gpl2.name|licensed under gplv2
lgpl.free3|this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl.free3|this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
mpl.title|mozilla public license version 2 0
epl.name|licensed under the eclipse public license 2 0
epl.title|eclipse public license v 2 0
bsl.title|boost software license version 1 0 august 17th 2003
bsl.name|distributed under the boost software license version 1 0
bsl.name|licensed under the boost software license version 1 0
unlicense.name|licensed under the unlicense
cc0.title|cc0 1 0 universal
cc0.name|licensed under cc0 1 0 universal
cddl.name|the contents of this file are subject to the terms of the common development and distribution license
artistic.name|licensed under the artistic license 2 0
psf.name|licensed under the python software foundation license version 2
ccbynd.name|licensed under cc by nd 4 0
ccbyncsa.name|licensed under cc by nc sa 4 0
ccbyncnd.name|licensed under cc by nc nd 4 0
ccbynd.name|this work is licensed under a creative commons attribution noderivatives 4 0 international license
ccbyncsa.name|this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license
ccbyncnd.name|this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license
"""

#: Ordered rules (fixed values): licences, the identifiers of their sentences.
RULES = """
MIT|mit.grant mit.notice mit.disclaim
BSD-3-Clause|bsd.grant bsd.source bsd.binary bsd.endorse bsd.disclaim
BSD-3-Clause|bsd.grant bsd.source bsd.binary bsd.endorse
BSD-2-Clause|bsd.grant bsd.source bsd.binary bsd.disclaim
BSD-2-Clause|bsd.grant bsd.source bsd.binary
Apache-2.0|apache.name apache.limit apache.copy
GPL-3.0-or-later|gpl.free gpl.hope
GPL-2.0-or-later|gpl.free2 gpl.hope
MIT|mit.grant mit.notice
BSD-1-Clause|bsd.grant bsd.source
MIT|mit.grant
ISC|isc.grant isc.disclaim
ISC|isc.grant
Zlib|zlib.grant
BSL-1.0|bsl.grant
EPL-2.0|epl.name
LGPL-2.1-or-later|lgpl.free gpl.hope
LGPL-2.1-or-later|lgpl.free
AGPL-3.0-or-later|agpl.free gpl.hope
AGPL-3.0-or-later|agpl.free
MIT|mit.name
MIT|mit.title
Apache-2.0|apache.name
Apache-2.0|apache.title
GPL-3.0-only|gpl3.name
GPL-2.0-only|gpl2.name
GPL-3.0-or-later|gpl.free
GPL-2.0-or-later|gpl.free2
LGPL-3.0-only|lgpl.name
AGPL-3.0-only|agpl.name
MPL-2.0|mpl.name mpl.copy
MPL-2.0|mpl.name
CC-BY-NC-4.0|ccbync.name
CC-BY-SA-4.0|ccbysa.name
CC-BY-4.0|ccby.name
CC0-1.0|cc0.name
Unlicense|unlicense.name
Apache-2.0 MIT|dual.apachemit
MIT-0|mit0.grant
NCSA|ncsa.grant
0BSD|zbsd.grant
ISC|isc.title
ISC|isc.name
BSD-3-Clause|bsd3.title
BSD-3-Clause|bsd3.name
BSD-2-Clause|bsd2.title
BSD-2-Clause|bsd2.name
PostgreSQL|postgres.grant
GPL-3.0-only|gpl3.full
GPL-2.0-only|gpl2.full
LGPL-3.0-only|lgpl3.full
LGPL-2.1-only|lgpl21.full
AGPL-3.0-only|agpl3.full
LGPL-3.0-or-later|lgpl.free3
MPL-2.0|mpl.title
EPL-2.0|epl.title
BSL-1.0|bsl.title
BSL-1.0|bsl.name
CC0-1.0|cc0.title
CDDL-1.0|cddl.name
Artistic-2.0|artistic.name
PSF-2.0|psf.name
CC-BY-ND-4.0|ccbynd.name
CC-BY-NC-SA-4.0|ccbyncsa.name
CC-BY-NC-ND-4.0|ccbyncnd.name
"""
#: Licences that an expression may name (fixed values); the second form stands for deprecated ones.
SPDX = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0
CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0-only GPL-2.0-only GPL-2.0-or-later
GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0
NCSA OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""
DEPRECATED = {"AGPL-3.0": "AGPL-3.0-only", **{f"{n}{end}": n + now for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for end, now in (("", "-only"), ("+", "-or-later"))}}
EXPRESSION = r"spdx-license-identifier:[ \t]*([^\n\r]*)"
EXCEPTION = r"\bwith[ \t]+[^ \t)]+"
TOKEN = r"[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?"

#: Every known sentence holds one of these (a test checks it), so that texts without them need no look-up.
ANCHOR = "licen|permission|redistribut|software|domain|rights|spdx|gpl|mpl|cc0"


def _rows(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in table.strip().split("\n")]


def _spdx() -> dict[str, str]:
    """Licences by their names in lower case."""
    return {x.lower(): x for x in SPDX.split()} | {x.lower(): now for x, now in DEPRECATED.items()}


def segments() -> list[tuple[str, str, str]]:
    """(text, identifier, part) of what is looked for, part being empty, or the sentence's number
    and 1 or 2 for the parts around its gap; the longest first."""
    out = []
    for k, (name, said) in enumerate(_rows(SENTENCES)):
        parts = [p.strip() for p in said.split("*")]
        out += [(p, name, f"{k}:{n}" if len(parts) > 1 else "") for n, p in enumerate(parts, 1)]
    return sorted(out, key=lambda x: (-len(x[0]), x[0]))


class Recogniser:
    """The known sentences and rules, ready for use in a task."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for text, name, part in segments():
            words = text.split()
            self.automaton.add_word(f" {'  '.join(words)} ", (len(words), len(text), name, part))
        self.automaton.make_automaton()
        self.anchors = [a.encode() for a in ANCHOR.split("|")]
        self.rules = [(name.split(), "," + ids.replace(" ", ",,") + ",") for name, ids in _rows(RULES)]
        self.spdx = _spdx()
        self.expression, self.exception, self.token = (re.compile(p.encode()) for p in (EXPRESSION, EXCEPTION, TOKEN))
        self.word = re.compile(rb"[a-z0-9]+")

    def sentences(self, low: bytes) -> list[str]:
        """Identifiers of the sentences of a lower-cased text, in order of first place."""
        words = self.word.findall(low)
        said = (b" " + b"  ".join(words) + b" ").decode("ascii")
        found = [(end, *known) for end, known in self.automaton.iter(said)]
        if not found:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2) - 1  # places of the spaces after the words
        spans = [m.span() for m in self.word.finditer(low)] if any(name.endswith("title") for *_, name, _ in found) else []
        places = []
        for end, n, size, name, part in found:
            last = int(np.searchsorted(ends, end))
            first = last - n + 1
            title = name.endswith("title")
            if title:
                before = low[spans[first - 1][1] if first else 0 : spans[first][0]]
                after = low[spans[last][1] : spans[last + 1][0] if last + 1 < len(spans) else len(low)]
                if first and not re.search(rb"[\n\r]", before) or last + 1 < len(spans) and not re.search(rb"[\n\r]", after):
                    continue
            places.append((first, not title, -size, last, name, part))
        taken, kept = -1, []
        for first, _, _, last, name, part in sorted(places):
            if first > taken:
                taken = last
                kept.append((name, part))
        out = []
        for k, (name, part) in enumerate(kept):
            sentence, _, which = part.partition(":")
            if which == "2":
                continue
            if which == "1" and next((p for _, p in kept[k + 1 :] if p.partition(":")[0] == sentence and p), "").partition(":")[2] != "2":
                continue
            out.append(name)
        return [*dict.fromkeys(out)]

    def expressions(self, low: bytes) -> list[str]:
        """The known licences of a lower-cased text's expressions, in order of first place."""
        said = b" ".join(self.exception.sub(b" ", e) for e in self.expression.findall(low))
        return [*dict.fromkeys(self.spdx[t.decode()] for t in self.token.findall(said) if t.decode() in self.spdx)]

    def licences(self, ids: list[str]) -> list[str]:
        """What the ordered rules find in a sequence."""
        left, found = ",".join(["", *(f"{i}," for i in ids)]) if ids else "", []
        for names, rule in self.rules:
            if rule in left:
                found += names
                left = left.replace(rule, "|")
        return found

    def scan(self, text: str | None) -> tuple[list[str], list[str]]:
        """(sentence_ids, licences) of a text."""
        low = (text or "").encode().lower()  # of bytes: A-Z only
        if not any(a in low for a in self.anchors):
            return [], []
        ids, named = self.sentences(low), self.expressions(low)
        return ids + [f"spdx.{n}" for n in named], sorted({*self.licences(ids), *named})


@functools.cache
def recogniser() -> Recogniser:
    """The one of a process."""
    return Recogniser()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences) of every document."""

    @F.arrow_udf("struct<sentence_ids:array<string>,licences:array<string>>")
    def found(texts: pa.Array) -> pa.Array:
        from lodestrata.llm.licences import recogniser  # the worker's own

        known, some = recogniser(), pa.list_(pa.string())
        rows = [known.scan(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], some) for k in (0, 1)], ["sentence_ids", "licences"])

    return docs.select("doc_id", found(F.make_valid_utf8("text")).alias("f")).select("doc_id", "f.sentence_ids", "f.licences")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(said: str, title: bool) -> str:
    """A sentence, or a part of one, as a pattern over text whose line ends are two bars."""
    words = "[ |]+".join(said.split())
    return rf"\| ?{words} ?\|" if title else rf"\b{words}\b"


def oracle() -> str:
    """The same in DuckDB's SQL, over the table ``documents``."""
    pattern = "|".join(_pattern(text, name.endswith("title")) for text, name, _ in segments())
    held = "trim(regexp_replace(x, '[ |]+', ' ', 'g'))"
    cases = " ".join(f"when {_quoted(text)} then {_quoted(part or name)}" for text, name, part in segments())
    whole = " ".join(f"when {_quoted(part)} then case when list_filter(l[i + 1:], lambda y: starts_with(y, {_quoted(part[:-1])}))[1] = {_quoted(part[:-1] + '2')} then {_quoted(name)} end" for _, name, part in segments() if part.endswith(":1"))
    spdx = " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in _spdx().items())
    found, steps = [], []
    for i, (name, ids) in enumerate(_rows(RULES)):
        said = _quoted("," + ids.replace(" ", ",,") + ",")
        steps.append(f"s{i} as (select *, contains(l{i}, {said}) f{i}, replace(l{i}, {said}, '|') l{i + 1} from {'seqs' if not i else f's{i - 1}'})")
        found += [f"case when f{i} then {_quoted(n)} end" for n in name.split()]
    once = lambda x: f"list_filter({x}, lambda v, k: v is not null and list_position({x}, v) = k)"
    return f"""
with docs as (select row_number() over () r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
normal as (select *, '|' || regexp_replace(regexp_replace(t, '[\\n\\r]', '||', 'g'), '[^a-z0-9|]+', ' ', 'g') || '|' n from docs),
listed as (select *, list_transform(regexp_extract_all(n, '{pattern}'), lambda x: case {held} {cases} end) l from normal),
paired as (select *, list_transform(l, lambda x, i: case x {whole} else case when contains(x, ':') then null else x end end) p,
  list_transform(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(t, '{EXPRESSION}', 1), lambda e: regexp_replace(e, '{EXCEPTION}', ' ', 'g')), ' '), '{TOKEN}'), lambda x: case x {spdx} end) e from listed),
once as (select r, doc_id, {once("p")} l, {once("e")} e from paired),
seqs as (select r, doc_id, e, array_to_string(list_concat(l, list_transform(e, lambda x: 'spdx.' || x)), ',') ids, ',' || array_to_string(l, ',,') || ',' l0 from once),
{", ".join(steps)}
select doc_id, ids as sentence_ids, array_to_string(list_sort(list_distinct(list_filter(list_concat([{", ".join(found)}], e), lambda x: x is not null))), ',') as licences from s{len(steps) - 1}
"""
