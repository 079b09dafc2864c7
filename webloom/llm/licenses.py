"""License notices by conditional compression.

A text is looked at around its hints: words such as license or copyright, and the first HINT_WORDS words of any template.
The block around a hint is compressed by zstandard without help and with each template as raw dictionary; the
templates are ranked by the bytes they save, in shares of the template's own compressed size. Those that save any are then
confirmed in that order by their exact wording: the template's words are aligned with the block's, and a template stands if
MIN_COVERAGE of its words are there in order in a span not much longer than it; the words that
are missing or extra are reported. A template is left out only where it cannot win any more (it has fewer words than the
one confirmed is worth) or cannot stand (too few of its words are within reach, in any order): such templates are neither compressed nor aligned, so that a text of many hints costs little.

Defined results: null and empty texts hold no notice; rows that repeat an id or text are scanned each; a
notice that stands several times in a text is reported each time; null ids stay null; an empty table gives an empty result.
Only the id and text columns are read, so that other columns' names don't matter. Places are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, read, tidy

#: Fixed wordings of public licenses' notices and openings: (license, wording).
WORDINGS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
)
#: Fixed names: parts of Creative Commons licenses, their versions, and identifiers of other licenses.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = ("4.0", "3.0", "2.0")
IDENTIFIERS = ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0", "Unlicense")
TEMPLATES = (
    *WORDINGS,
    *[(f"CC-{code}-{v}", f"Licensed under CC {code} {v}.") for code in COMMONS for v in VERSIONS],
    *[(f"CC-{code}-{v}", f"This work is licensed under a Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'} License.") for code, name in COMMONS.items() for v in VERSIONS],
    *[(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS],
)
HINT = r"licen[cs]e|copyright|rights reserved|creative commons|public domain|free software"
WORDS = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
MIN_COVERAGE, MAX_STRETCH, HINT_WORDS, LEVEL = 0.9, 1.3, 3, 9


def hint_pattern(templates) -> str:
    """Matches where a notice may stand: common words, and how each template begins (in lower case)."""
    begins = {tuple(WORDS.findall(t.lower())[:HINT_WORDS]) for _, t in templates}
    common = re.compile(HINT)
    begins = sorted(b for b in begins if b and not common.search(" ".join(b)))
    return "|".join([HINT, *(r"[^a-z0-9]+".join(w.replace(".", r"\.") for w in b) for b in begins)])


class Scanner:
    def __init__(self, templates=TEMPLATES):
        import zstandard

        self.templates, self.hint = templates, re.compile(hint_pattern(templates))
        self.words = [[m[0] for m in WORDS.finditer(t.lower())] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.alone = [len(self.plain.compress(t.lower().encode())) for _, t in templates]
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=raw)) for _, t in templates]

    def possible(self, places: dict[str, list[int]], among, hint: int | None = None, done: int = 0) -> list[int]:
        """The templates whose words are there, in the text or within reach of the hint and after `done`, as often as confirm() asks."""
        out = []
        for k in among:
            left = (1 - MIN_COVERAGE) * len(self.words[k]) + 1e-9
            reach = self.reach(k)
            for w, c in self.counts[k].items():
                at = places.get(w, ())
                n = len(at) if hint is None else max(0, bisect_right(at, hint + reach - len(w)) - bisect_left(at, max(done, hint - reach)))
                left -= max(0, c - n)
                if left < 0:
                    break
            else:
                out.append(k)
        return out

    def reach(self, k: int) -> int:
        return 2 * len(self.templates[k][1]) + 40

    def ranked(self, text: str, hint: int, among) -> list[tuple[float, int]]:
        """(share of the template that the block gains from it, template), best first."""
        out = []
        for k in among:
            template = self.templates[k][1]
            block = text[max(0, hint - len(template)) : hint + len(template)].encode()
            gain = len(self.plain.compress(block)) - len(self.given[k].compress(block))
            out.append((gain / self.alone[k], k))
        return sorted(out, key=lambda x: (-x[0], -len(self.templates[x[1]][1]), x[1]))

    def confirm(self, words: list[tuple[str, int, int]], hint: int, k: int, done: int = 0):
        """(coverage, start, end, missing, extra) of the template's wording around the hint and after `done`, where the notice before ends, if it stands; words: the text's, with their places."""
        want, reach = self.words[k], self.reach(k)
        found = words[bisect_left(words, max(done, hint - reach), key=lambda w: w[1]) : bisect_right(words, hint + reach, key=lambda w: w[2])]
        have = [w for w, _, _ in found]
        blocks = [b for b in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if b.size]
        # Strays far from the longest block do not belong to the notice.
        if not blocks:
            return None
        core = max(blocks, key=lambda b: b.size)
        near = [b for b in blocks if abs((b.b - core.b) - (b.a - core.a)) <= max(3, len(want) // 4)]
        first, last = near[0].b, near[-1].b + near[-1].size
        covered = {i for b in near for i in range(b.a, b.a + b.size)}
        used = {i for b in near for i in range(b.b, b.b + b.size)}
        coverage = len(covered) / len(want)
        if coverage < MIN_COVERAGE or last - first > MAX_STRETCH * len(want) + 1 or not found[first][1] <= hint < found[last - 1][2]:
            return None
        return coverage, found[first][1], found[last - 1][2], [w for i, w in enumerate(want) if i not in covered], [have[i] for i in range(first, last) if i not in used]

    def scan(self, text: str):
        lower, done = text.lower(), 0
        if len(lower) != len(text):  # folding moved the places
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places: dict[str, list[int]] = {}
        words = [(m[0], m.start(), m.end()) for m in WORDS.finditer(lower)]
        for w, start, _ in words:
            places.setdefault(w, []).append(start)
        # Compression is for templates that a count of words leaves: what cannot be confirmed is not compressed.
        among = self.possible(places, range(len(self.templates)))
        for m in self.hint.finditer(lower) if among else ():
            if m.start() < done:
                continue
            best = None
            for gain, k in self.ranked(lower, m.start(), self.possible(places, among, m.start(), done)):
                if gain <= 0 or best and len(self.words[k]) < best[0]:
                    continue
                got = self.confirm(words, m.start(), k, done)
                if got:
                    worth = len(self.words[k]) - 3 * len(got[3]) - 2 * len(got[4])
                    if best is None or (worth, gain) > best[:2]:
                        best = worth, gain, k, got
            if best:
                _, gain, k, (coverage, start, end, missing, extra) = best
                done = end
                yield self.templates[k][0], k, start, end, gain, coverage, missing, extra


def license_notices(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """A row for each notice: doc_id, license, template, start, end, gain, coverage, missing, extra."""
    limit_batches(df.sparkSession)

    @tidy
    def run(batches):
        own = Scanner(templates)
        names = ["doc_id", "license", "template", "start", "end", "gain", "coverage", "missing", "extra"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            rows = [(doc, *found) for doc, text in zip(*(c.to_pylist() for c in batch.columns)) for found in own.scan(text)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    hinted = df.where(F.lower(text_col).rlike(hint_pattern(templates))).select(F.col(id_col).cast("long"), F.col(text_col))
    return hinted.mapInArrow(run, "doc_id bigint, license string, template int, start bigint, end bigint, gain double, coverage double, missing array<string>, extra array<string>")


def op5_conditional_compression(spark, sf_dir: str) -> DataFrame:
    return license_notices(read(spark, sf_dir, "documents"))
