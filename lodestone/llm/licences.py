"""Licence scans by conditional compression.

Blocks of text around licence keywords are compressed alone and with every template
as a zstandard raw dictionary.  Templates are ranked by the bytes they save, as a
share of what the template itself takes; every one that saves enough is confirmed by
its exact wording: a template counts when its words stand in the block in a row, or
with differences that touch none of its telling words.  Templates are one-line
notices, file headers, identifier tags and whole licence texts.  Of overlapping finds
in a document whole texts stay before notices, exact ones before variants, then the
longest.

What a short template saves drowns in the noise of a long block, so templates are
sorted into classes by length, and each class has blocks of its own: they reach as
far around a keyword as the class's longest template is long, whatever the line
breaks; blocks that meet are one, read in pieces that overlap by more than a
template, so nothing is cut off.

Defined results: a null or empty text has no block; overlapping windows are one
block; repeated rows get equal results; extra columns are not read; empty in, empty
out.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import need, small_batches, table

# Public licence texts.
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"""
BSD_SOURCE = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
BSD_BINARY = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
#: (licence, wording); several wordings a licence.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Public-domain", "This work is in the public domain."),
    ("All-rights-reserved", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Apache-2.0", APACHE_HEADER),
    ("MIT", MIT_GRANT + " " + MIT_NOTICE + " " + MIT_DISCLAIMER),
    ("BSD", BSD_OPENING),
    ("BSD-2-Clause", " ".join((BSD_OPENING, BSD_SOURCE, BSD_BINARY, BSD_DISCLAIMER))),
    ("BSD-3-Clause", " ".join((BSD_OPENING, BSD_SOURCE, BSD_BINARY, BSD_NAMES, BSD_DISCLAIMER))),
    ("ISC", ISC_GRANT),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
TAGGED = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
TEMPLATES = (*NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in TAGGED))
KEYWORDS = ("licen", "copyright", "all rights", "public domain", "creative commons", "permission ", "redistribut")
#: Templates up to this length are one class; each further class has twice the length.
SHORTEST = 160
#: A block reaches this much further around its keyword than its class's templates are long.
SLACK = 40
#: A template that saves a smaller share of its own size is no candidate; in 3000 trials whole wordings saved 0.25 at least.
MIN_REDUCTION = 0.1
#: Least similarity of words for a variant wording.
MIN_WORDING = 0.85
#: Words of a notice that may differ in a variant; all others are telling.
PLAIN = frozenset("a an and any associated be by copy documentation files form free granted hereby in is license licensed obtaining of person permission released software source subject terms the this to under work charge code international program library".split())
#: In a template of more words than this, only numbers and these words are telling.
LONG = 40
#: Finds from this length on are more than a notice, and win over the notices in them.
LONG_CHARS = 200
TELLING = frozenset("agpl affero apache bsd eclipse endorse fee general gnu isc lesser mit mozilla mpl neither nor noncommercial noderivatives promote sharealike unencumbered".split())
#: Blocks whose results a worker remembers, and the longest such.
CACHE_BLOCKS, CACHE_CHARS = 20_000, 2_000
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def telling(word: str, long: bool) -> bool:
    return (word in TELLING or word[0].isdigit()) if long else word not in PLAIN


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        import zstandard as zstd

        plain = zstd.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.size = lambda b: len(plain.compress(b))
        self.floor = self.size(b"")
        self.templates = []
        for name, wording in templates:
            raw = wording.encode()
            data = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=3)
            given = zstd.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            w = words(wording)
            pattern = re.compile(r"\b" + r"[\W_]+".join(map(re.escape, w)) + r"\b(?!\.\d)", re.IGNORECASE)
            self.templates.append((name, w, pattern, given.compress, max(1, self.size(raw) - self.floor)))
        classes: dict[int, list[int]] = {}
        for k, (_, wording) in enumerate(templates):
            size = SHORTEST
            while size < len(wording):
                size *= 2
            classes.setdefault(size + SLACK, []).append(k)
        self.classes = sorted(classes.items())  # (reach, templates)
        self.memory: dict[tuple[int, str], list[tuple[str, int, int, str, float]]] = {}

    def rank(self, block: str, among: list[int]) -> list[tuple[float, int]]:
        """(reduction, template) of the candidates, best first."""
        raw = block.encode()
        alone = self.size(raw)
        out = [((alone - len(self.templates[k][3](raw))) / self.templates[k][4], k) for k in among]
        return sorted((x for x in out if x[0] >= MIN_REDUCTION), key=lambda x: (-x[0], x[1]))

    def confirm(self, block: str, k: int) -> list[tuple[int, int, str]]:
        """(start, end, "exact" or "variant") of the template's wording in the block."""
        _, w, pattern, _, _ = self.templates[k]
        out = [(m.start(), m.end(), "exact") for m in pattern.finditer(block)]
        at = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(block)]
        # A variant has all telling words, so the first one anchors a window of words; a long text is anchored by several long words.
        long = len(w) > LONG
        anchors = [j for j, x in enumerate(w) if telling(x, False)][:1] if not long else sorted(range(len(w)), key=lambda j: (-len(w[j]), j))[:3]
        anchors = anchors or [j for j, x in enumerate(w) if len(x) > 6]
        reach = len(w) // 5 + 2
        free = lambda s, e: all(e <= x[0] or s >= x[1] for x in out)
        for i, (s, e, x) in enumerate(at):
            for j in anchors:
                if x == w[j] and free(s, e):
                    found = self.variant(at[max(0, i - j - reach) : i - j + len(w) + reach], w)
                    if found and free(*found[:2]):
                        out.append(found)
        return out

    def variant(self, at: list[tuple[int, int, str]], w: list[str]) -> tuple[int, int, str] | None:
        """A variant of the template's words in a window of (start, end, word)."""
        match = difflib.SequenceMatcher(None, [x[2] for x in at], w, autojunk=False)
        same = [b for b in match.get_matching_blocks() if b.size]
        if not same:
            return None
        first, last = same[0].a, same[-1].a + same[-1].size
        window = [x[2] for x in at[first:last]]
        ratio = difflib.SequenceMatcher(None, window, w, autojunk=False)
        changed = [x for op, a, b, c, d in ratio.get_opcodes() if op != "equal" for x in window[a:b] + w[c:d]]
        if ratio.ratio() < MIN_WORDING or any(telling(x, len(w) > LONG) for x in changed):
            return None
        return at[first][0], at[last - 1][1], "variant"

    def block(self, block: str, reach: int, among: list[int]) -> list[tuple[str, int, int, str, float]]:
        """Confirmed (licence, start, end, wording, reduction) of one class's templates."""
        found = self.memory.get((reach, block))
        if found is None:
            found = [(self.templates[k][0], s, e, how, round(gain, 4)) for gain, k in self.rank(block, among) for s, e, how in self.confirm(block, k)]
            if len(block) <= CACHE_CHARS:
                if len(self.memory) >= CACHE_BLOCKS:
                    self.memory.clear()
                self.memory[reach, block] = found
        return found

    def keywords(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the keywords."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case; places must stay
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans = []
        for word in KEYWORDS:
            at = low.find(word)
            while at >= 0:
                spans.append((at, at + len(word)))
                at = low.find(word, at + len(word))
        return sorted(spans)

    def blocks(self, text: str, keywords: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, e in keywords:
            # Notices may be wrapped: only the class's longest template bounds a block, and it ends at whole words.
            a, b = max(0, s - reach), min(len(text), e + reach)
            while a < s and a and text[a - 1].isalnum():
                a += 1
            while e < b < len(text) and text[b].isalnum():
                b -= 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def pieces(self, text: str, keywords: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int]]:
        """The blocks, long ones in overlapping pieces."""
        for a, b in self.blocks(text, keywords, reach):
            while b - a > 3 * reach:
                yield a, a + 3 * reach
                a += reach
            yield a, b

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, str, float]]]:
        """The number of blocks, and (licence, start, end, wording, reduction) of the finds by start."""
        text = text or ""
        keywords = self.keywords(text)
        best: dict[tuple[str, int, int, str], float] = {}
        for reach, among in self.classes:
            for a, b in self.pieces(text, keywords, reach):
                for name, s, e, how, gain in self.block(text[a:b], reach, among):
                    key = (name, a + s, a + e, how)
                    best[key] = max(gain, best.get(key, gain))
        found: list[tuple[str, int, int, str, float]] = []
        ends: list[tuple[int, int]] = []
        for name, s, e, how in sorted(best, key=lambda h: (h[2] - h[1] < LONG_CHARS, h[3] != "exact", h[1] - h[2], h[1], h[0])):
            at = bisect.bisect_left(ends, (s, e))
            if (at == 0 or ends[at - 1][1] <= s) and (at == len(ends) or ends[at][0] >= e):
                ends.insert(at, (s, e))
                found.append((name, s, e, how, best[name, s, e, how]))
        return len(self.blocks(text, keywords, SHORTEST + SLACK)), sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_blocks, n_licences, licences, spans, reduction) of every row.

    ``licences`` are distinct names by code point, ``spans`` name:start:end:wording
    by start, both comma-joined; ``reduction`` is the best confirmed one, or null.
    """
    small_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["doc_id", "n_blocks", "n_licences", "licences", "spans", "reduction"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, hits = scanner.scan(text)
                found = sorted({h[0] for h in hits})
                out.append((doc, n, len(found), ",".join(found), ",".join(f"{h[0]}:{h[1]}:{h[2]}:{h[3]}" for h in hits), max((h[4] for h in hits), default=None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    return need(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_blocks long, n_licences long, licences string, spans string, reduction double")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
