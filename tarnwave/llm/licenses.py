"""Licence notices by conditional compression.

Blocks are cut around each word that speaks of licensing: for each template the span beside it whose wording comes
nearest, if it comes near enough; line breaks and comment marks count as spaces. A block's words are then compressed alone
and with each template as a zstandard raw dictionary, and templates are ranked by what they save. The first in this order
whose exact wording differences from the block are few enough is the block's licence. Of blocks that overlap, the one that
saves most stays.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Notices and their licence ids.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    # bodies, file headers and titles as they stand in source trees
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit '
        'persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice '
        'and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS '
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        'MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT '
        'HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, '
        'ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of '
        'conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, '
        'this list of conditions and the following disclaimer in the documentation and/or other materials provided with the '
        'distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or '
        'promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY '
        'THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        'THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE '
        'COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL '
        'DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR '
        'BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT '
        '(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE '
        'POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of '
        'conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, '
        'this list of conditions and the following disclaimer in the documentation and/or other materials provided with the '
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        'WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
        'PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, '
        'INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE '
        'GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF '
        'LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT '
        'OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        'the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by '
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        'WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        'governing permissions and limitations under the License.',
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    (
        "GPL-3.0",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public '
        'License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later '
        'version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more '
        'details.',
    ),
    (
        "GPL-2.0",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public '
        'License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later '
        'version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more '
        'details.',
    ),
    (
        "LGPL-3.0",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General '
        'Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any '
        'later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even '
        'the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License '
        'for more details.',
    ),
    (
        "AGPL-3.0",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General '
        'Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any '
        'later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even '
        'the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License '
        'for more details.',
    ),
    (
        "GPL-3.0",
        'GNU General Public License Version 3, 29 June 2007 Free Software Foundation, Inc. Everyone is permitted to copy and '
        'distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    (
        "GPL-2.0",
        'GNU General Public License Version 2, June 1991 Free Software Foundation, Inc. Everyone is permitted to copy and '
        'distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    (
        "LGPL-3.0",
        'GNU Lesser General Public License Version 3, 29 June 2007 Free Software Foundation, Inc. Everyone is permitted to copy '
        'and distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    (
        "AGPL-3.0",
        'GNU Affero General Public License Version 3, 19 November 2007 Free Software Foundation, Inc. Everyone is permitted to '
        'copy and distribute verbatim copies of this license document, but changing it is not allowed.',
    ),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    (
        "MPL-2.0",
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not '
        'distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "CC0-1.0",
        'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to '
        'this software to the public domain worldwide. This software is distributed without any warranty.',
    ),
    (
        "Unlicense",
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, '
        'compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, '
        'commercial or non-commercial, and by any means.',
    ),
)

#: A tag that names licences by their SPDX ids: its text and the expression after it.
SPDX_TAG = re.compile(r"SPDX-License-Identifier:[\x20\t]*([^\r\n]*)", re.IGNORECASE)
SPDX_ID = re.compile(r"[A-Za-z0-9.-]+\+?")
SPDX_LATER = re.compile(r"(?:-only|-or-later|\+)$", re.IGNORECASE)


@dataclass(frozen=True)
class LicenseRules:
    """signal: what makes a line a candidate. agree: least word ratio."""

    signal: str = r"licen[sc]e|public\W+domain|copyright|spdx"
    agree: float = 0.8


#: id, bytes alone, bytes given the template, word ratio, start and end in the text, words missing and added.
Match = tuple[str, int, int, float, int, int, list[str], list[str]]
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def best_span(own: np.ndarray, said: np.ndarray, at: int, agree: Fraction) -> tuple[Fraction, int, int] | None:
    """The span of said that holds place `at` and has the largest word ratio with own, if that reaches agree.

    Ratio = 2 * common / (words of own + words of the span), common: longest common subsequence. For a given ratio p/q,
    one pass finds the span with the largest 2q * common - p * length; the ratio is raised until no span exceeds it.
    """
    wide = len(said) + 1
    found = None
    while True:
        p, q = agree.numerator, agree.denominator
        # value * wide + start of the best span so far that uses a prefix of own, for each prefix
        held = np.full(len(own) + 1, -(1 << 60), np.int64)
        best = end = None
        for j, w in enumerate(said):
            if j <= at:
                held = np.maximum(held, j)
            new = held - p * wide
            np.maximum(new[1:], np.where(own == w, held[:-1] + (2 * q - p) * wide, new[1:]), out=new[1:])
            held = np.maximum.accumulate(new)
            if j >= at and (best is None or held[-1] > best):
                best, end = int(held[-1]), j + 1
        if best is None:
            return found
        value, start = divmod(best, wide)
        if value < p * len(own):
            return found
        hit = Fraction(value + p * (end - start), 2 * q)
        ratio = 2 * hit / (len(own) + end - start)
        if found and ratio <= found[0]:
            return found
        found, agree = (ratio, start, end), ratio


def differences(own: Sequence[str], said: Sequence[str]) -> tuple[list[str], list[str]]:
    """The words of own that said lacks, and those that said adds, each in order, by a longest common subsequence."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64) for ws in (own, said))
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (b == a[i])))
    missing, added = [], []
    i, j = len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or best[i, j - 1] == best[i, j]):
            j -= 1
            added.append(said[j])
        else:
            i -= 1
            missing.append(own[i])
    return missing[::-1], added[::-1]


def apart(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans in order of preference those that overlap none before them that stays."""
    kept: list[tuple[int, int]] = []
    for a, b in spans:
        k = bisect_right(kept, (a, b))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
            kept.insert(k, (a, b))
    return kept


class Matcher:
    def __init__(self, notices: Sequence[tuple[str, str]], rules: LicenseRules):
        import zstandard as zstd

        self.notices, self.rules, self.signal = notices, rules, re.compile(rules.signal, re.IGNORECASE)
        self.said = [words(t) for _, t in notices]
        self.plain = zstd.ZstdCompressor(level=3, write_checksum=False)
        kind = zstd.DICT_TYPE_RAWCONTENT
        self.given = [zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(" ".join(w).encode(), dict_type=kind)) for w in self.said]
        self.ids: dict[str, int] = {}
        self.words = [np.array([self.ids.setdefault(w, len(self.ids)) for w in ws], np.int64) for ws in self.said]
        self.counts = [Counter(w.tolist()) for w in self.words]
        self.first = {n.lower(): i for i, (n, _) in reversed(list(enumerate(notices)))}
        self.agree = Fraction(str(rules.agree))
        # a span that reaches agree has at most (2 - agree) / agree words for each of the template's
        self.reach = [int(len(w) * (2 - self.agree) / self.agree) for w in self.words]
        # templates of like length look at the same window
        self.classes: dict[int, list[int]] = {}
        for i, r in enumerate(self.reach):
            self.classes.setdefault(1 << r.bit_length(), []).append(i)
        self.judge = lru_cache(50_000)(self._judge)
        self.sizes = lru_cache(20_000)(self._sizes)
        self.held = lru_cache(20_000)(self._held)
        self.winner = lru_cache(20_000)(self._winner)

    def _judge(self, width: int, said: tuple[int, ...], at: int) -> list[tuple[int, Fraction, int, int]]:
        """(template, ratio, first and last + 1 word) of each template of a class that agrees with a span around `at`."""
        out = []
        for i in self.classes[width]:
            a, b = max(0, at - self.reach[i] + 1), min(len(said), at + self.reach[i])
            near = Counter(said[a:b])
            # an agreeing span has at least agree / (2 - agree) of the template's words
            if sum(min(n, near[w]) for w, n in self.counts[i].items()) * (2 - self.agree) < len(self.words[i]) * self.agree:
                continue
            if span := best_span(self.words[i], np.array(said[a:b], np.int64), at - a, self.agree):
                out.append((i, span[0], a + span[1], a + span[2]))
        return out

    def _sizes(self, said: tuple[str, ...]) -> tuple[int, list[int]]:
        """Bytes of a block's words alone, and with each template as a dictionary."""
        raw = " ".join(said).encode("utf-8", "surrogatepass")
        return len(self.plain.compress(raw)), [len(c.compress(raw)) for c in self.given]

    def _held(self, said: tuple[str, ...], i: int) -> tuple[Fraction, list[str], list[str]]:
        """Word ratio of a block with template i, and the words that the block lacks and adds."""
        missing, added = differences(self.said[i], said)
        return Fraction(2 * (len(said) - len(added)), len(said) + len(self.said[i])), missing, added

    def _winner(self, said: tuple[str, ...]) -> int | None:
        """Of the templates whose wording is confirmed the one that saves most, among equals the nearest, then the first."""
        near = Counter(self.ids.get(w, -1) for w in said)
        ranked: dict[int, list[int]] = {}
        for i, size in enumerate(self.sizes(said)[1]):
            ranked.setdefault(size, []).append(i)
        for size in sorted(ranked):
            ratios = []
            for i in ranked[size]:
                # the words both have, in any order, bound those in common
                if 2 * sum(min(n, near[w]) for w, n in self.counts[i].items()) >= self.agree * (len(said) + len(self.said[i])):
                    ratios.append((self.held(said, i)[0], -i))
            if ratios and max(ratios)[0] >= self.agree:
                return -max(ratios)[1]
        return None

    def tags(self, text: str) -> Iterator[tuple]:
        """SPDX ids as find ranks them, before all wordings: each id of an expression is a match, the first one's reaches back
        to its tag. Bytes are of a tag with this id alone; given is with the id's first template.
        """
        for tag in SPDX_TAG.finditer(text):
            seen = False
            for m in SPDX_ID.finditer(text, tag.start(1), tag.end(1)):
                i = self.first.get(SPDX_LATER.sub("", m.group()).lower())
                if i is not None:
                    alone, given = self.sizes(tuple(words(f"SPDX-License-Identifier: {m.group()}")))
                    yield 0, given[i] - alone, Fraction(-1), i, m.start() if seen else tag.start(), m.end(), alone, given[i], [], []
                    seen = True

    def find(self, text: str) -> list[Match]:
        """All notices of a text, by start: of those that overlap the one that saves most, then by ratio, template and start."""
        if not self.signal.search(text):
            return []
        starts, ends, ids = array("q"), array("q"), array("q")
        for m in WORD.finditer(text):
            starts.append(m.start())
            ends.append(m.end())
            ids.append(self.ids.get(m.group().lower(), -1))

        def said(first: int, last: int) -> tuple[str, ...]:
            return tuple(text[starts[k] : ends[k]].lower() for k in range(first, last))

        blocks = set()
        for at in {bisect_right(starts, m.start()) - 1 for m in self.signal.finditer(text)} - {-1}:
            cut = {}
            for width in self.classes:
                low = max(0, at - width)
                for i, _, first, last in self.judge(width, tuple(ids[low : at + width]), at - low):
                    cut[i] = low + first, low + last
            for span in set(cut.values()):
                i = self.winner(said(*span))
                if i is not None:
                    # a template confirmed on a block has itself been cut there, perhaps closer
                    blocks.add((i, *cut.get(i, span)))
        # a template's blocks that overlap are cuts of one notice: the closest is its block
        closest = sorted((i, -self.held(said(first, last), i)[0], first, last) for i, first, last in blocks)
        ranked = list(self.tags(text))
        for i, group in groupby(closest, lambda c: c[0]):
            for first, last in apart((c[2], c[3]) for c in group):
                block = said(first, last)
                alone, given = self.sizes(block)
                ratio, missing, added = self.held(block, i)
                ranked.append((1, given[i] - alone, -ratio, i, starts[first], ends[last - 1], alone, given[i], missing, added))
        ranked.sort()
        won = set(apart((a, b) for _, _, _, _, a, b, *_ in ranked))
        out = []
        for _, _, ratio, i, a, b, alone, given, missing, added in ranked:
            if (a, b) in won:
                won.remove((a, b))
                out.append((self.notices[i][0], alone, given, float(-ratio), a, b, missing, added))
        return sorted(out, key=lambda m: m[4])


#: Bounds of a table of templates: rows, and characters of all.
MOST_NOTICES, MOST_CHARACTERS = 2_000, 4_000_000


def notices_of(table: DataFrame) -> list[tuple[str, str]]:
    """Templates from a table (license_id, text), for instance of whole licence texts, by id and text.

    Templates go to every task, so a table beyond MOST_NOTICES rows or MOST_CHARACTERS is an error. Rows with a null, or
    without a word, are no templates; repeated rows are one.
    """
    rows = table.select("license_id", "text").dropna().distinct()
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if size[0] > MOST_NOTICES or size[1] > MOST_CHARACTERS:
        raise ValueError(f"{size[0]} templates of {size[1]} characters are more than go to every task")
    return sorted((i, t) for i, t in rows.collect() if words(t))


def scan_licenses(docs: DataFrame, notices: Sequence[tuple[str, str]] | DataFrame = NOTICES, rules: LicenseRules = LicenseRules(), text: str = "text") -> DataFrame:
    """Licence notices in the texts of docs, one row for each; they may be wrapped over lines.

    notices: templates (id, text), or a table of them (license_id, text; see notices_of).
    Returns doc_id, license_id, start, end (code points of the block), bytes_alone, bytes_given (the block's words, in lower
    case, compressed without and with the template), agreement (word ratio, 6 decimals), missing and added (the
    template's words that the block lacks, and those it adds). Texts that are null, empty or without notices give no rows;
    repeated rows give their own; a null doc_id stays null; ties go to the nearer wording, then the earlier notice; an empty
    table gives an empty one; texts have no limit; other columns of docs are ignored.
    """
    if isinstance(notices, DataFrame):
        notices = notices_of(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(notices, rules)
        for batch, texts in slices(batches):
            rows = [(i, j) for i, t in enumerate(texts) for j in m.find(t)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    "license_id": pa.array([j[0] for _, j in rows], pa.string()),
                    "start": pa.array([j[4] for _, j in rows], pa.int64()),
                    "end": pa.array([j[5] for _, j in rows], pa.int64()),
                    "bytes_alone": pa.array([j[1] for _, j in rows], pa.int64()),
                    "bytes_given": pa.array([j[2] for _, j in rows], pa.int64()),
                    "agreement": pa.array([round(j[3], 6) for _, j in rows], pa.float64()),
                    "missing": pa.array([j[6] for _, j in rows], pa.list_(pa.string())),
                    "added": pa.array([j[7] for _, j in rows], pa.list_(pa.string())),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, license_id string, start long, end long, bytes_alone long, bytes_given long, agreement double, missing array<string>, added array<string>")
