"""License scans by conditional compression.

A block is the words around a trigger word, whatever line ends and comment marks lie between them. It is compressed
alone and with each template as a raw zstandard dictionary; templates are tried by the bytes they save. A template is
confirmed by the exact wording: the number of words that must be put in, left out or exchanged to get from a run of the
block's words to the template's. Names and versions must stand; names of other licenses, and words that deny, must not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Usual wordings of license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-title": "MIT License",
    "ISC-title": "ISC License",
    "BSD-2-Clause-title": "BSD 2-Clause License",
    "BSD-3-Clause-title": "BSD 3-Clause License",
    "GPL-3.0-title": "GNU General Public License v3",
    "LGPL-3.0-title": "GNU Lesser General Public License v3",
    "AGPL-3.0-title": "GNU Affero General Public License v3",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "Apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
}
#: Names and versions. A wording without them is that of another license.
NAMES = {
    "MIT": {"mit"},
    "Apache-2.0": {"apache", "2.0"},
    "GPL-3.0": {"gnu", "3"},
    "LGPL-3.0": {"gnu", "lesser", "3"},
    "AGPL-3.0": {"gnu", "affero", "3"},
    "CC-BY-NC-4.0": {"by-nc", "4.0"},
    "CC-BY-NC-ND-4.0": {"by-nc-nd", "4.0"},
    "CC-BY-SA-4.0": {"attribution-sharealike", "4.0"},
    "MPL-2.0": {"mozilla", "2.0"},
    "BSD-3-Clause": {"bsd-style"},
    "MIT-title": {"mit", "license"},
    "ISC-title": {"isc", "license"},
    "BSD-2-Clause-title": {"bsd", "2-clause"},
    "BSD-3-Clause-title": {"bsd", "3-clause"},
    "GPL-3.0-title": {"gnu", "general", "v3"},
    "LGPL-3.0-title": {"gnu", "lesser", "v3"},
    "AGPL-3.0-title": {"gnu", "affero", "v3"},
    "ISC-notice": {"fee"},
    "GPL-3.0-notice": {"gnu", "3"},
    "LGPL-3.0-notice": {"gnu", "lesser", "3"},
    "AGPL-3.0-notice": {"gnu", "affero", "3"},
}
#: License identifiers, each after the usual tag.
SPDX_TAG = "SPDX-License-Identifier"
SPDX = (
    "MIT", "ISC", "Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0",
)
TEMPLATES |= {f"{x}-SPDX": f"{SPDX_TAG}: {x}" for x in SPDX}
NAMES |= {f"{x}-SPDX": {SPDX_TAG.lower(), x.lower()} for x in SPDX}
#: Words that make a wording one of another license, in it or next to it in the same sentence.
OTHERS = {"lesser", "library", "affero", "nd", "noderivatives", "noderivs", "nc", "noncommercial"}
#: Words shortly before a wording, in the same sentence, with which it says the contrary.
DENIALS = {"not", "no", "never", "isn't", "cannot", "nor", "neither", "un"}
BEFORE = 6

BROKEN = r"-[^\S\r\n]*[\r\n][\s#/*;%!]*"
WORD = re.compile(rf"[^\W_]+(?:(?:[.\-]|{BROKEN})[^\W_]+)*")
HYPHEN = re.compile(BROKEN)
STOP = re.compile(r"[.,!?;:]")
LINE_END = re.compile(r"\s*[\r\n][\s#/*;%!\-]*")
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("license", pa.string()), ("differences", pa.int64()), ("bytes_alone", pa.int64()), ("bytes_given", pa.int64()), ("block", pa.string())])


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def whole_word(found: str, known: frozenset[str]) -> str:
    """A word as it stands, lower-cased; one that a line end breaks at a hyphen without it, if that is a known word."""
    word = found.lower()
    if "\n" not in word and "\r" not in word:
        return word
    joined = HYPHEN.sub("", word)
    return joined if joined in known else HYPHEN.sub("-", word)


def best_run(own: list[str], at: int, wording: list[str], allowed: int, names: frozenset[str] = frozenset()) -> tuple[int, int, int, int] | None:
    """(differences, surplus or lack of words, start, end) of the best run of own that has the word at, None if all have over allowed.

    Differences are the least number of words to put in, leave out or exchange; words in names can't be left out or
    exchanged. Fewest differences go first, then the length nearest to the wording's, then the first start.
    """
    most = len(wording) + allowed
    starts = np.arange(max(0, at - most + 1), at + 1)
    code = {w: k for k, w in enumerate(dict.fromkeys(wording))}
    coded = np.array([code.get(w, -1) for w in own] + [-1] * most)
    grid, steps = coded[starts[:, None] + np.arange(most)], np.arange(most + 1)
    row = np.broadcast_to(steps, (len(starts), most + 1))
    for w in wording:
        price = allowed + 1 if w in names else 1
        row = np.concatenate([row[:, :1] + price, np.minimum(row[:, 1:] + price, row[:, :-1] + price * (grid != code[w]))], axis=1)
        row = np.minimum.accumulate(row - steps, axis=1) + steps
    ends = starts[:, None] + steps
    s, n = np.nonzero((row <= allowed) & (ends > at) & (ends <= len(own)))
    return min(((int(row[i, j]), abs(int(j) - len(wording)), int(starts[i]), int(ends[i, j])) for i, j in zip(s, n, strict=True)), default=None)


class Scanner:
    """share: differing words allowed, as a part of the template's words; one at least, if others are left to know it by."""

    def __init__(self, templates: Mapping[str, str], share: float = 0.1, names: Mapping[str, set[str]] = NAMES, level: int = 3):
        self.licenses = list(templates)
        self.words = [words(templates[x]) for x in self.licenses]
        self.names = [frozenset(names.get(x, ())) & frozenset(w) for x, w in zip(self.licenses, self.words, strict=True)]
        self.allowed = [min(max(1, int(share * len(w))), len(set(w)) - 1) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        raw = [zstandard.ZstdCompressionDict(templates[x].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.licenses]
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False) for d in raw]
        #: Of each template so many words (the longest) that a run within its allowance has at least one of them.
        self.triggers: dict[str, list[int]] = {}
        for k, (ws, n) in enumerate(zip(self.words, self.allowed, strict=True)):
            for w in sorted(set(ws), key=lambda x: (-len(x), x))[: n + 1]:
                self.triggers.setdefault(w, []).append(k)
        self.known = frozenset(w for ws in self.words for w in ws)
        self.others = [frozenset(OTHERS) - frozenset(w) for w in self.words]
        self.reach = {w: max(len(self.words[k]) + self.allowed[k] for k in ks) for w, ks in self.triggers.items()}

    def denied(self, k: int, own: list[str], stops: list[bool], a: int, b: int) -> bool:
        """Whether words in the run, or next to it in its sentence, make it another license or none. stops: a sign that
        parts or ends a sentence stands after the word."""
        if not self.others[k].isdisjoint(own[a:b]) or b < len(own) and not stops[b - 1] and own[b] in self.others[k]:
            return True
        for i in range(a - 1, max(-1, a - 1 - BEFORE), -1):
            if stops[i]:
                return False
            if own[i] in DENIALS:
                return True
        return False

    def judge(self, block: str, own: list[str], stops: list[bool], at: int) -> tuple[int, int, int, int, int, int, int] | None:
        """Differences, place in the ranks, start, end (of words), template, bytes alone, bytes given of the best find that has
        the trigger word at, the one with the most words of its template; None if no template's wording is near enough."""
        there = set(own)
        fits = [k for k in self.triggers[own[at]] if self.names[k] <= there and len(set(self.words[k]) - there) <= self.allowed[k]]
        if not fits:
            return None
        raw = block.encode("utf-8", "replace")
        alone, best, most = len(self.plain.compress(raw)), None, (0, 0)
        for rank, (size, k) in enumerate(sorted((len(self.given[k].compress(raw)), k) for k in fits)):
            run = best_run(own, at, self.words[k], self.allowed[k], self.names[k])
            if run and (key := (run[0] - len(self.words[k]), run[0])) < most and not self.denied(k, own, stops, run[2], run[3]):
                best, most = (run[0], rank, run[2], run[3], k, alone, size), key
        return best

    def scan(self, text: str) -> list[tuple[int, str, int, int, int, str]]:
        """Each find: start (character), license, differences, bytes alone, bytes given, the wording as it stands.

        Finds don't overlap: the most words of a template go first, then the fewest differences, then the first. What they
        leave is searched again, so a run of words within a template's allowance always meets a find.
        """
        at = [m.span() for m in WORD.finditer(text)]
        own = [whole_word(text[a:b], self.known) for a, b in at]
        hits = [i for i, w in enumerate(own) if w in self.triggers]
        taken, found = np.zeros(len(own) + 1, bool), []
        while hits:
            offers = []
            for i in hits:
                a, b = max(0, i - self.reach[own[i]] - BEFORE), min(len(own), i + self.reach[own[i]] + 2)
                shut = np.flatnonzero(taken[a:b]) + a
                a, b = max([a, *(shut[shut < i][-1:] + 1)]), min([b, *shut[shut > i][:1]])
                stops = [bool(STOP.search(text, at[k][1], at[k + 1][0] if k + 1 < len(at) else len(text))) for k in range(a, b)]
                got = self.judge(LINE_END.sub(" ", text[at[a][0] : at[b - 1][1]]), own[a:b], stops, i - a)
                if got:
                    offers.append((got[0] - len(self.words[got[4]]), got[0], got[2] + a, got[3] + a, i, got))
            hits = []
            for _, _, a, b, i, got in sorted(offers):
                if not taken[a:b].any():
                    taken[a:b] = True
                    found.append((at[a][0], self.licenses[got[4]], got[0], got[5], got[6], text[at[a][0] : at[b - 1][1]]))
                elif not taken[i]:
                    hits.append(i)
            hits = [i for i in hits if not taken[i]]
        return sorted(found)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, share: float = 0.1, names: Mapping[str, set[str]] = NAMES) -> DataFrame:
    """doc_id, start, license, differences, bytes_alone, bytes_given, block: a row for each run of words that has a license's wording.

    Whole texts are searched; line ends and comment marks between words don't count. A text without any trigger word (see
    Scanner) cannot hold a find and is passed over in the JVM. Null and empty texts have no finds. Repeated rows and null
    ids are scanned row by row. Other columns are not read. No shuffle.
    """
    sample = Scanner(templates, share, names)
    pattern = "(?iu)" + "|".join(re.escape(w).replace(r"\-", "-") for w in sorted(sample.triggers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, share, names)
        for batch in batches:
            rows = [(i, *r) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in scanner.scan(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(OUT)], schema=OUT)

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(pattern) | F.col("text").rlike(r"-[^\S\r\n]*[\r\n]"))  # a trigger may be broken at a hyphen
    return rows.mapInArrow(run, "doc_id long, start long, license string, differences long, bytes_alone long, bytes_given long, block string")
