"""Licence scans by sentence rules.

A text is cut into pieces at ends of sentences and of lines; each is normalised (case, spaces, quotes
and punctuation). Known licence sentences form a tree of words: from each piece the tree is walked,
over as many lines as the sentence takes but over no end of a sentence, and the longest known one
gives an identifier. A copyright line (it names a year or has the sign) and a licence tag have
identifiers of their own. The sequence of a text's identifiers is then matched against ordered
rules: at each place the longest rule that fits names a licence; identifiers that no rule takes are
reported as left over. A walk ends with the longest known sentence, so the work is linear in the text.

Edge cases: a null or empty text has no sentence and no licence; repeated rows give repeated
results; an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from medloom.llm.common import arrow_map

#: References: how such a sentence begins, and the names that may follow, by identifier.
LEADS = ["licensed under", "released under", "distributed under", "available under", "provided under", *(f"this {x} is {v} under" for x in ("work", "project", "file", "software", "program", "document", "text", "code") for v in ("licensed", "released", "distributed"))]
NAMES = {
    "apache2_ref": ["apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license"],
    "mit_ref": ["mit license"],
    "bsd_ref": ["bsd license", "bsd 2 clause license", "bsd 3 clause license"],
    "gpl2_ref": ["gnu general public license version 2", "gnu gpl version 2", "gpl v2"],
    "gpl3_ref": ["gnu general public license version 3", "gnu gpl version 3", "gpl v3"],
    "lgpl3_ref": ["gnu lesser general public license version 3", "gnu lgpl version 3"],
    "agpl3_ref": ["gnu affero general public license version 3", "gnu agpl version 3"],
    "mpl2_ref": ["mozilla public license version 2 0", "mozilla public license v 2 0"],
    "cc0_ref": ["cc0 1 0", "cc0 1 0 universal"],
    "lgpl21_ref": ["gnu lesser general public license version 2 1", "gnu lgpl version 2 1"],
    "isc_ref": ["isc license"],
    "zlib_ref": ["zlib license"],
    "bsl_ref": ["boost software license version 1 0", "boost software license 1 0"],
    "epl2_ref": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0"],
    "unlicense_ref": ["unlicense"],
}
#: Parts of the public licences for works, which go by short and long names and have versions.
PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
WORKS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
for _kind in WORKS:
    _long = " ".join(PARTS[x] for x in _kind.split())
    for _version in ("2 0", "3 0", "4 0"):
        NAMES[f"cc_{_kind}_{_version}_ref".replace(" ", "_")] = [f"cc {_kind} {_version}", f"creative commons {_long} {_version}", f"creative commons {_long} {_version} international license", f"creative commons {_long} {_version} license"]

#: Known sentences after normalising, by identifier.
SENTENCES = {
    "apache2_comply": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache2_asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2_form": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "public_domain": ["this work is dedicated to the public domain"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zlib_asis": ["this software is provided as is without any express or implied warranty"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl_grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense_free": ["this is free and unencumbered software released into the public domain"],
    "unlicense_grant": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "reserved": ["all rights reserved"],
}
SENTENCES |= {i: [f"{lead} {the}{name}" for lead in LEADS for name in own for the in ("", "the ", "a ")] for i, own in NAMES.items()}
SENTENCES["epl2_ref"] += [f"this program and the accompanying materials are made available under the terms of the {name}{more}" for name in NAMES["epl2_ref"] for more in ("", " which accompanies this distribution", " which is available at https www eclipse org legal epl 2 0")]
#: Notices of the free software foundation's licences: the name, its versions, and what may follow.
FREE = {"gpl": ("general", ("2", "3")), "lgpl": ("lesser general", ("2 1", "3")), "agpl": ("affero general", ("3",))}
for _name, (_long, _versions) in FREE.items():
    for _version in _versions:
        for _later, _more in (("later", ["either version {} of the license or at your option any later version", "version {} or at your option any later version"]), ("only", ["version {} of the license", "version {}"])):
            SENTENCES[f"{_name}_{_version}_{_later}_free".replace(" ", "_")] = [
                f"this {work} is free software you can redistribute it and or modify it under the terms of the gnu {_long} public license as published by the free software foundation {more.format(_version)}"
                for work in ("program", "library", "software", "file") for more in _more
            ]
#: Notices by licence: the run of identifiers that is the whole notice, and shorter ones.
NOTICES = [
    ("Apache-2.0", ("apache2_ref", "apache2_comply", "apache2_copy", "apache2_asis", "apache2_see")),
    ("Apache-2.0", ("apache2_ref", "apache2_comply", "apache2_copy", "apache2_asis")),
    ("Apache-2.0", ("apache2_ref", "apache2_comply")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant", "isc_asis")),
    ("ISC", ("isc_grant",)),
    ("Zlib", ("zlib_asis", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("bsl_grant",)),
    ("Unlicense", ("unlicense_free", "unlicense_grant")),
    ("Unlicense", ("unlicense_free",)),
    *((f"{name.upper()}-{v.replace(' ', '.') if ' ' in v else v + '.0'}-{'or-later' if later == 'later' else 'only'}", (f"{name}_{v}_{later}_free".replace(" ", "_"), *more)) for name, (_, versions) in FREE.items() for v in versions for later in ("later", "only") for more in (("gpl_hope",), ())),
    ("MPL-2.0", ("mpl2_form",)),
    ("Public-Domain", ("public_domain",)),
]
REFERENCES = {
    "apache2_ref": "Apache-2.0", "mit_ref": "MIT", "gpl2_ref": "GPL-2.0", "gpl3_ref": "GPL-3.0", "lgpl21_ref": "LGPL-2.1", "lgpl3_ref": "LGPL-3.0", "bsd_ref": "BSD", "agpl3_ref": "AGPL-3.0", "mpl2_ref": "MPL-2.0",
    "cc0_ref": "CC0-1.0", "isc_ref": "ISC", "zlib_ref": "Zlib", "bsl_ref": "BSL-1.0", "epl2_ref": "EPL-2.0", "unlicense_ref": "Unlicense",
} | {f"cc_{k}_{v}_ref".replace(" ", "_"): f"CC-{k.upper().replace(' ', '-')}-{v.replace(' ', '.')}" for k in WORKS for v in ("2 0", "3 0", "4 0")}
#: Ordered rules: the licence that a run of identifiers names; the longest run that fits wins. A
#: notice takes reserved rights before it along, which say nothing of another licence then.
RULES = [(name, (*before, *run)) for name, run in NOTICES for before in ((), ("copyright", "reserved"), ("reserved",))]
RULES += [(name, (i,)) for i, name in REFERENCES.items()]
RULES += [("Proprietary", ("copyright", "reserved")), ("Proprietary", ("reserved",))]

_END = re.compile(r"(?<![.!?;:])[.!?;:]++[\"')\]]*+(?=\s|$)|\n+")
_STOP = re.compile(r"[.!?]")
#: A text without one of these can't hold a known sentence.
_HINT = re.compile(r"licen[sc]e|copyright|\(c\)|©|all rights|permission|redistribut|warrant|merchantab|public domain|endorse|free software|cc0|cc by|creative commons", re.I)
_COPYRIGHT = re.compile(r"[\s#/*;-]{0,40}(?:copyright(?![a-z])|\(c\)|©).{0,80}", re.I | re.S)
_MARKED = re.compile(r"\(c\)|©|\b(?:19|20)[0-9]{2}\b", re.I)
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]{0,9}([A-Za-z0-9.+()-]{1,80}(?: (?:AND|OR|WITH) [A-Za-z0-9.+()-]{1,80}){0,20})")
_OTHER = re.compile(r"[\W_]+")
_FIRST = re.compile(r"[^\W_]+")
TAG = "tag:"
#: Characters that a known sentence has at most, with room for comment signs and spaces.
LONGEST = 8192

SCHEMA = "doc_id bigint, n_sentences bigint, sentence_ids string, licenses string, left_over string"


def normal(sentence: str) -> str:
    """Lower case words and numbers with single spaces."""
    return _OTHER.sub(" ", sentence.lower()).strip()


def is_copyright(piece: str) -> bool:
    """Whether a piece is a copyright line: the word or the sign at its start, and the sign or a year
    within 80 characters from there."""
    m = _COPYRIGHT.match(piece)
    return bool(m) and bool(_MARKED.search(m.group(0)))


def tree_of(sentences: dict[str, list[str]]) -> dict:
    """The known sentences as a tree of words; the empty word leads to an identifier."""
    root: dict = {}
    for name, own in sentences.items():
        for sentence in own:
            node = root
            for word in sentence.split():
                node = node.setdefault(word, {})
            node[""] = name
    return root


def pieces_of(text: str) -> list[tuple[int, int, bool]]:
    """Start and end of each piece, and whether a sentence may go on in the next one: it may at the
    end of a line, at a semicolon and at a colon."""
    out, start = [], 0
    for m in _END.finditer(text):
        goes_on = not _STOP.search(m.group())
        if m.start() > start:
            out.append((start, m.start(), goes_on))
        elif out and not goes_on:
            out[-1] = (*out[-1][:2], False)
        start = m.end()
    if start < len(text):
        out.append((start, len(text), False))
    return out


def recognise(text: str, tree: dict) -> list[str]:
    """Identifiers of the licence sentences of a text, in order."""
    if not _HINT.search(text):
        return []
    pieces, words = pieces_of(text), {}
    found = [(m.start(), TAG + m.group(1).strip("()")) for m in _TAG.finditer(text)]
    at = 0
    while at < len(pieces):
        start, end, _ = pieces[at]
        if is_copyright(text[start : min(end, start + 120)]):
            found.append((start, "copyright"))
            at += 1
            continue
        first = _FIRST.search(text, start, end)
        node, last, name = tree if first and first.group().lower() in tree else None, at, None
        k = at
        while node is not None and k < len(pieces):
            if k not in words:
                # a piece of more characters than any sentence can't be part of one
                a, z, _ = pieces[k]
                words[k] = normal(text[a:z]).split() if z - a < LONGEST else [""]
            for word in words[k]:
                node = node.get(word) if word else None
                if node is None:
                    break
            if node is not None and "" in node:
                last, name = k, node[""]
            if node is not None and not pieces[k][2]:
                break
            k += 1
        if name:
            found.append((start, name))
        at = last + 1
    return [name for _, name in sorted(found, key=lambda x: x[0])]


class Ordered:
    """Rules by their first identifier, longer runs first."""

    def __init__(self, rules):
        self.by_first: dict[str, list] = {}
        for name, run in sorted(rules, key=lambda r: -len(r[1])):
            self.by_first.setdefault(run[0], []).append((name, run))


def match(ids: list[str], rules=RULES) -> tuple[list[str], list[str]]:
    """Licences that the rules read from a sequence of identifiers, and the identifiers left."""
    found, left, at = [], [], 0
    ordered = rules if isinstance(rules, Ordered) else Ordered(rules)
    while at < len(ids):
        if ids[at].startswith(TAG):
            found.append(ids[at][len(TAG) :])
            at += 1
            continue
        for name, run in ordered.by_first.get(ids[at], ()):
            if tuple(ids[at : at + len(run)]) == run:
                found.append(name)
                at += len(run)
                break
        else:
            left.append(ids[at])
            at += 1
    return found, left


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules=RULES) -> DataFrame:
    """doc_id, number and identifiers of licence sentences, licences in order of first place
    without repeats, and left-over identifiers, for each row. One narrow stage."""
    known, ordered = tree_of(sentences or SENTENCES), Ordered(rules)

    def run(batch):
        rows = []
        for text in batch.column(1).to_pylist():
            ids = recognise(text or "", known)
            found, left = match(ids, ordered)
            rows.append((len(ids), ",".join(ids), ",".join(dict.fromkeys(found)), ",".join(left)))
        n, ids, found, left = zip(*rows)
        return {"doc_id": batch.column(0), "n_sentences": pa.array(n, pa.int64()), "sentence_ids": pa.array(ids, pa.string()), "licenses": pa.array(found, pa.string()), "left_over": pa.array(left, pa.string())}

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, SCHEMA)
