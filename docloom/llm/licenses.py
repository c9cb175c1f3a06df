"""Operator 2: license scans by patience alignment of texts with license templates.

A text and a template are word sequences. Words that occur once in both are
anchors; the longest increasing subsequence of their places in the text keeps
those that are in order; the gaps between anchors are aligned the same way, and
where a gap has no anchor, equal words at its two ends are matched. Coverage is
the share of the template's words that found a partner.

Templates are whole texts and standard notices, and sentences that name a license
(`` licensed under the ... ``), built from the families' names and versions. A
region counts as a template's license if

* its coverage is ``COVERAGE`` or more,
* every distinguishing word of the template (name, version, qualifiers) is matched,
* matched words make up ``DENSITY`` of the region, after stray pairs at its ends
  are dropped,
* no word left over in it, or next to it in the same sentence, belongs to another
  license of the kind (``ND`` in CC BY-ND, ``Lesser`` before GPL, another version),
* and no negation stands shortly before it in the same sentence.

Every region therefore holds the template's seed, one of its distinguishing
words: around each seed that no earlier region covers, the stretch
in which the template would lie, with some slack, is aligned. Texts of any length
are scanned whole, in linear time.

Defined results: null and empty texts hold no license; of overlapping regions
the one with more matched words counts, then the higher coverage, then the first
template; repeated licenses are all reported; of several names behind one
``licensed under`` the first is reported; rows that repeat an id are scanned one
by one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

COVERAGE = 0.8
DENSITY = 0.75
#: Words of letters beyond ASCII are no words of a license, nor are their parts.
WORD = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])[A-Za-z0-9]++(?:\.[0-9]++)*+(?![\x80-\xff])")

#: Words that count as one, and words that turn a notice into its opposite.
SAME = {b"licence": b"license", b"released": b"licensed", b"distributed": b"licensed", b"published": b"licensed", b"provided": b"licensed"}
#: Words before a region, within its sentence, among which a negation counts.
LOOK_BACK = 8
NEGATIONS = frozenset([b"not", b"never", b"nor", b"neither", b"isn", b"without", b"unlike"])

#: Words that lead to no license by themselves.
FREQUENT = frozenset([b"under", b"version", b"general", b"mit", b"later"])

#: Texts and notices that stand in files word for word; distinguishing words in braces.
MIT_GRANT = """Permission is hereby {granted}, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to {deal} in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, {sublicense}, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""
MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without {fee} is hereby
granted, provided that the above copyright notice and this permission notice {appear} in all copies."""
BSD_GRANT = """{Redistribution} and use in source and {binary} forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse} or {promote}
products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
APACHE_NOTICE = """Licensed under the {Apache} License, {Version} {2.0} (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
APACHE_TITLE = """{Apache} License Version {2.0}, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
REPRODUCTION, AND DISTRIBUTION"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU} NAME Public
License as published by the Free Software Foundation, either version {VERSION} of the License, or (at your option) any {later} version."""
GNU_TITLE = """{GNU} NAME PUBLIC LICENSE Version {VERSION}, DATE Copyright (C) YEAR Free Software Foundation, Inc. Everyone is
permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""

#: GNU licenses (identifier, name, abbreviation, version, date, year) and parts of the CC licenses.
GNU = (
    ("GPL-2.0", "{General}", "GPL", "2", "June 1991", "1989, 1991"),
    ("GPL-3.0", "{General}", "GPL", "3", "29 June 2007", "2007"),
    ("LGPL-2.1", "{Lesser} General", "LGPL", "2.1", "February 1999", "1991, 1999"),
    ("LGPL-3.0", "{Lesser} General", "LGPL", "3", "29 June 2007", "2007"),
    ("AGPL-3.0", "{Affero} General", "AGPL", "3", "19 November 2007", "2007"),
)
CC_PARTS = {"NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CC_KINDS = ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Sentences that name other licenses.
NAMED = (
    ("MIT", "the {MIT} {License}"),
    ("ISC", "the {ISC} {License}"),
    ("Apache-1.1", "the {Apache} License, Version {1.1}"),
    ("Apache-2.0", "the {Apache} License, Version {2.0}"),
    ("Apache-2.0", "the {Apache} License {2.0}"),
    ("Apache-2.0", "the {Apache} {2.0} License"),
    ("MPL-1.1", "the {Mozilla} Public License, version {1.1}"),
    ("MPL-2.0", "the {Mozilla} Public License, version {2.0}"),
    ("MPL-2.0", "the {Mozilla} Public License {2.0}"),
    ("BSD-2-Clause", "the {BSD} {2} {Clause} License"),
    ("BSD-2-Clause", "the {2} {Clause} {BSD} License"),
    ("BSD-2-Clause", "the {Simplified} {BSD} License"),
    ("BSD-3-Clause", "the {BSD} {3} {Clause} License"),
    ("BSD-3-Clause", "the {3} {Clause} {BSD} License"),
    ("BSD-3-Clause", "the {New} {BSD} License"),
    ("BSD-3-Clause", "the {Revised} {BSD} License"),
    ("CC0-1.0", "{CC0} {1.0}"),
)
#: Words, by kind of template, that belong to one license or another of the kind.
KIND_WORDS = {
    "name": "mit isc apache mozilla bsd gnu gpl lgpl agpl lesser library affero cc cc0 creative by nc nd sa noncommercial "
    "noderivatives noderivs sharealike new revised simplified clause 1 2 3 4 1.0 1.1 2.0 2.1 2.5 3.0 4.0",
    "gnu": "lesser library affero 1 2 3 2.0 2.1 3.0",
    "bsd": "endorse promote advertising acknowledgment",
    "text": "",
}


@dataclass(frozen=True)
class Template:
    """Words, which of them distinguish the license, and which may not be left over in a region."""

    name: str
    words: tuple[bytes, ...]
    needed: frozenset[int]
    foreign: frozenset[bytes]

    @classmethod
    def of(cls, name: str, kind: str, text: str) -> Template:
        data = text.encode()
        words = tuple(words_of(data))
        marks = [m.start() for m in re.finditer(rb"\{", data)]
        starts = [m.start() for m in WORD.finditer(data)]
        needed = frozenset(bisect_left(starts, m) for m in marks)
        return cls(name, words, needed, frozenset(KIND_WORDS[kind].encode().split()) - set(words))

    @property
    def seed(self) -> int:
        """Place of the longest distinguishing word that is not in most notices."""
        return min(self.needed, key=lambda i: (self.words[i] in FREQUENT, -len(self.words[i]), i))


def license_templates() -> list[Template]:
    """All templates: whole texts and notices, then sentences made of names and versions."""
    found = [
        ("MIT", "text", MIT_GRANT),
        ("MIT", "text", f"{MIT_GRANT} {MIT_DISCLAIMER}"),
        ("ISC", "text", ISC_GRANT),
        ("BSD-2-Clause", "bsd", f"{BSD_GRANT} {BSD_DISCLAIMER}"),
        ("BSD-3-Clause", "bsd", f"{BSD_GRANT} {BSD_NAMES} {BSD_DISCLAIMER}"),
        ("Apache-2.0", "text", APACHE_NOTICE),
        ("Apache-2.0", "text", APACHE_TITLE),
        ("MPL-2.0", "text", MPL_NOTICE),
    ]
    names = list(NAMED)
    for name, long, short, version, date, year in GNU:
        for text, as_name in ((GNU_NOTICE, f"{name}-or-later"), (GNU_TITLE, name)):
            for old, new in (("NAME", long), ("VERSION", version), ("DATE", date), ("YEAR", year)):
                text = text.replace(old, new)
            found.append((as_name, "gnu", text))
        part = long.removesuffix("General").strip().removeprefix("{General}")
        for v in dict.fromkeys([version, version if "." in version else f"{version}.0"]):
            for form in (f"the {{GNU}} {long} Public License", f"the {{{short}}}", f"the {{GNU}} {{{short}}}", f"the GNU {part} {{GPL}}" if part else ""):
                if form:
                    names += [
                        (name, f"{form}, version {{{v}}}"),
                        (name, f"{form} {{{v}}}"),
                        (f"{name}-or-later", f"{form}, version {{{v}}} or any {{later}} version"),
                        (f"{name}-or-later", f"{form}, version {{{v}}} or {{later}}"),
                    ]
        names.append((name, f"the {{{short}v{version}}}"))
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            name = "-".join(["CC-BY", *kind, version])
            short = "-".join(["{CC} {BY}", *(f"{{{k}}}" for k in kind)])
            long = "-".join(["{Attribution}", *(f"{{{CC_PARTS[k]}}}" for k in kind)])
            names += [(name, f"{short} {{{version}}}")]
            names += [(name, f"a Creative Commons {long} {{{version}}} {of} License") for of in ("International", "Unported")]
            names += [(name, f"the Creative Commons {long} {{{version}}}")]
    found += [(name, "name", f"Licensed {{under}} {form}") for name, form in names]
    found += [(name, "name", f"This work is licensed {{under}} {form}") for name, form in names]
    return [Template.of(*x) for x in found]


def words_of(data: bytes) -> list[bytes]:
    return [SAME.get(w, w) for w in WORD.findall(data.lower())]


def longest_rise(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        before[i] = at[pile - 1] if pile else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, rising in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        places = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = [(places[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in places]
        anchors = [anchors[i] for i in longest_rise([p for p, _ in anchors])]
        pairs += anchors
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def sentence_ends(between: bytes) -> bool:
    """Whether what stands between two words ends a sentence or paragraph."""
    return any(c in between for c in (b". ", b".\n", b"\n\n", b"! ", b"? ", b"; "))


class LicenseScanner:
    """The templates with the seeds that lead to them."""

    def __init__(self, templates: list[Template] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = license_templates() if templates is None else templates
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            self.seeds.setdefault(template.words[template.seed], []).append((t, template.seed))
        self.any_seed = frozenset(self.seeds)

    def region(self, words: list[bytes], low: int, high: int, t: int) -> tuple[int, int, int, float] | None:
        """(first word, end, matched words, coverage) of the template in a stretch, if it counts."""
        template = self.templates[t]
        stretch = words[low:high]
        if not all(template.words[i] in stretch for i in template.needed):
            return None
        pairs = align(stretch, list(template.words))
        while len(pairs) >= self.coverage * len(template.words) and len(pairs) < DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
            # stray pairs at the ends: the one behind the wider gap goes
            del pairs[0 if pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0] else -1]
        if len(pairs) < self.coverage * len(template.words) or not template.needed.issubset(j for _, j in pairs):
            return None
        first, end = low + pairs[0][0], low + pairs[-1][0] + 1
        matched = {low + i for i, _ in pairs}
        if any(words[i] in template.foreign or words[i] in NEGATIONS for i in range(first, end) if i not in matched):
            return None
        return first, end, len(pairs), len(pairs) / len(template.words)

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, license, coverage) of the regions, in code points and order, without overlaps."""
        data = (text or "").encode("utf-8", "surrogatepass")
        words = words_of(data)
        if self.any_seed.isdisjoint(words):
            return []
        found = [m.span() for m in WORD.finditer(data)]
        regions: list[tuple[int, int, int, int, float]] = []
        done = [0] * len(self.templates)
        for place, w in enumerate(words):
            for t, offset in self.seeds.get(w, ()):
                if place < done[t]:
                    continue
                size = len(self.templates[t].words)
                slack = max(2, size // 4)
                got = self.region(words, max(done[t], place - offset - slack), min(len(words), place - offset + size + slack), t)
                if got and self._stands(data, words, found, got, t):
                    regions.append((got[0], got[1], got[2], t, got[3]))
                    done[t] = got[1]
        return self._spans(data, found, regions)

    def _stands(self, data: bytes, words: list[bytes], found: list[tuple[int, int]], region: tuple, t: int) -> bool:
        """Whether the words around a region leave its license as it is."""
        first, end = region[:2]
        foreign = self.templates[t].foreign
        at = first
        for i in range(first - 1, max(-1, first - 1 - LOOK_BACK), -1):
            if sentence_ends(data[found[i][1] : found[at][0]]):
                break
            if words[i] in NEGATIONS:
                return False
            at = i
        if end < len(words) and not sentence_ends(data[found[end - 1][1] : found[end][0]]):
            return words[end] not in foreign
        return True

    def _spans(self, data: bytes, found: list[tuple[int, int]], regions: list[tuple]) -> list[tuple[int, int, str, float]]:
        """Of overlapping regions the one that counts, in code points."""
        regions.sort(key=lambda r: (-r[2], -r[4], r[3], r[0]))
        kept: list[tuple[int, int, int, int, float]] = []
        for r in regions:
            i = bisect_left(kept, r)
            if (i == 0 or kept[i - 1][1] <= r[0]) and (i == len(kept) or kept[i][0] >= r[1]):
                kept.insert(i, r)
        out, at, chars = [], 0, 0
        for first, last, _, t, share in kept:
            start, end = found[first][0], found[last - 1][1]
            chars += len(data[at:start].decode("utf-8", "surrogatepass"))
            size = len(data[start:end].decode("utf-8", "surrogatepass"))
            out.append((chars, chars + size, self.templates[t].name, round(share, 6)))
            chars, at = chars + size, end
        return out


def scan_licenses(
    docs: DataFrame,
    templates: list[Template] | None = None,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_licenses, licenses (distinct names in order), spans (name:start:end:coverage), best_coverage."""
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, coverage)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({x[2] for x in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{n}:{s}:{e}:{c:g}" for s, e, n, c in f) for f in found], pa.string()),
                    pa.array([max((x[3] for x in f), default=0.0) for f in found], pa.float64()),
                ],
                names=[id_col, "n_licenses", "licenses", "spans", "best_coverage"],
            )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"{id_col} {kind}, n_licenses long, licenses string, spans string, best_coverage double").select(
        F.col(id_col), "n_licenses", "licenses", "spans", "best_coverage"
    )
