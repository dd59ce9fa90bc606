"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Each template is fingerprinted: hashes of all runs of K words, of which the least of every WINDOW neighbours is kept
(winnowing), in an inverted index hash -> (template, place). All runs of K words of a document are looked up, so any
stretch of K + WINDOW - 1 words that it shares with a template is found. Hits of one template on near diagonals make a
candidate; a local alignment of the template with the document, in a band around them, gives matched words and span. To
the left and right of each alignment the search goes on until none covers enough of the template.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from refminer.llm import batches

K = 3
WINDOW = 2
BAND = 12
MIN_COVERAGE = 0.8
#: Templates of fewer words must match in all words, unless NAMES has what tells them apart.
SHORT = 10

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will "
    "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
    "for more details."
)
TEMPLATES: dict[str, str] = {
    "MIT": _MIT_BODY,
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "BSD-notice": "Released under the BSD License.",
    "BSD-notice-2": "Licensed under the BSD License.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "ISC-notice": "Licensed under the ISC License.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": _GNU_NOTICE.format(name="General Public License", version="3"),
    "GPL-2.0": _GNU_NOTICE.format(name="General Public License", version="2"),
    "AGPL-3.0": _GNU_NOTICE.format(name="Affero General Public License", version="3"),
    "LGPL-3.0": _GNU_NOTICE.format(name="Lesser General Public License", version="3"),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "All-rights-reserved": "All rights reserved.",
}

#: What a find of these notices must contain, phrase by phrase: the license's name and version.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT-notice": ("MIT",),
    "MIT-notice-2": ("MIT",),
    "BSD-notice": ("BSD",),
    "BSD-notice-2": ("BSD",),
    "BSD-2-Clause-notice": ("BSD 2",),
    "BSD-3-Clause-notice": ("BSD 3",),
    "ISC-notice": ("ISC",),
    "Apache-2.0-notice": ("Apache", "2.0"),
    "GPL-3.0-notice": ("GNU General Public", "3"),
    "GPL-2.0-notice": ("GNU General Public", "2"),
    "AGPL-3.0-notice": ("Affero", "3"),
    "LGPL-3.0-notice": ("Lesser", "3"),
    "MPL-2.0-notice": ("Mozilla", "2.0"),
    "CC-BY-4.0": ("Attribution 4.0",),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike 4.0",),
    "CC-BY-4.0-notice": ("BY 4.0",),
    "CC-BY-SA-4.0-notice": ("BY-SA 4.0",),
    "CC-BY-NC-4.0-notice": ("BY-NC 4.0",),
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The places of the least hash (the rightmost of equals) of every window."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: list[int], doc: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """(matched words, score, first, end) of the best local alignment within low <= doc place - template place <= high.

    A match gives 2, a mismatch or a gap costs 1. Of equal scores the one that ends first in the template, then in the
    document, counts; of equal ways to a cell, the one with more matches, then with the later first word.
    """
    nothing = (0, 0, 0)
    best = (0, 0, 0, 0)
    previous: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        current: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low), min(len(doc), i + high + 1)):
            score, matched, first = previous.get(j - 1, nothing)
            if not score:
                first = j
            here = (score + 2, matched + 1, first) if doc[j] == word else (score - 1, matched, first)
            up, left = previous.get(j, nothing), current.get(j - 1, nothing)
            here = max(here, (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]))
            if here[0] > 0:
                current[j] = here
                if here[0] > best[1]:
                    best = (here[1], here[0], here[2], j + 1)
        previous = current
    return best


def contains(words: list[int], phrase: list[int]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


@dataclass
class TemplateIndex:
    names: list[str] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    grams: list[set[tuple[int, ...]]] = field(default_factory=list)
    phrases: list[list[list[int]]] = field(default_factory=list)

    @classmethod
    def compile(cls, templates: dict[str, str], k: int = K, window: int = WINDOW) -> TemplateIndex:
        self = cls()
        data, offsets = batches.text_buffers(pa.array(list(templates.values()), pa.large_string()))
        _, _, hashes, bounds = batches.words(data, offsets)
        self.vocabulary = np.unique(hashes)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        prints, owner, place = [], [], []
        for t, name in enumerate(templates):
            own = hashes[bounds[t] : bounds[t + 1]]
            self.names.append(name)
            self.words.append((np.searchsorted(self.vocabulary, own) + 1).tolist())
            grams, _ = batches.ngrams(own, np.array([0, len(own)]), k)
            at = winnow(grams, window)
            self.grams.append({tuple(self.words[-1][i : i + k]) for i in at.tolist()})
            prints.append(grams[at])
            owner.append(np.full(len(at), t))
            place.append(at)
            phrases = []
            for phrase in NAMES.get(name, ()):
                _, _, own, _ = batches.words(*batches.text_buffers(pa.array([phrase], pa.large_string())))
                if np.isin(own, self.vocabulary).all():
                    phrases.append((np.searchsorted(self.vocabulary, own) + 1).tolist())
            self.phrases.append([p for p in phrases if contains(self.words[-1], p)])
        order = np.argsort(np.concatenate(prints), kind="stable")
        self.prints = np.concatenate(prints)[order]
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        return self

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the templates' vocabulary, from 1; 0 for all others."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.gate[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes[maybe]
        out[maybe[known]] = at[known] + 1
        return out

    def hits(self, hashes: np.ndarray, bounds: np.ndarray, known: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the document's first word, template, place in the template) of all fingerprints met, rows not crossed."""
        usable = np.ones(max(len(hashes) - k + 1, 0), bool)
        for d in range(k):
            usable &= known[d : d + len(usable)] > 0
        at = np.flatnonzero(usable)
        row = np.searchsorted(bounds, at, "right") - 1
        at = at[at + k <= bounds[row + 1]]
        value = hashes[at]
        for d in range(1, k):
            value = batches.mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[at + d])
        low, high = np.searchsorted(self.prints, value, "left"), np.searchsorted(self.prints, value, "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[which], self.place[which]


def occurrences(index: TemplateIndex, t: int, window: list[int], low: int, high: int, min_coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of the best alignment of template t within low <= place - template place <= high, then of
    the best ones to the left and right of each, as far as they cover enough; a part without a fingerprint has none. Of those
    that lack a phrase of the license's name none counts; a short template without such phrases must match in all words."""
    template, grams, phrases = index.words[t], index.grams[t], index.phrases[t]
    own, need = set(template), min_coverage * len(template)
    if len(template) < SHORT and not phrases:
        need = len(template)
    out, parts = [], [(0, len(window))]
    while parts:
        a, b = parts.pop()
        part = window[a:b]
        if sum(w in own for w in part) < need or not any(g in grams for g in zip(*(part[d:] for d in range(K)), strict=False)):
            continue
        matched, _, first, end = align(template, part, low - a, high - a)
        if matched and matched >= need:
            if all(contains(part[first:end], p) for p in phrases):
                out.append((matched, a + first, a + end))
            parts += [(a, a + first), (a + end, b)]
    return out


def spans(diagonals: list[int], size: int, band: int) -> list[tuple[int, int]]:
    """Least and greatest diagonal of the windows in which a template of size words is searched.

    Diagonals within band of the one before make a group. An alignment drifts by less than 2 x size, as each step costs 1
    and a match gives 2, so a longer group is searched in windows of 4 x size, each overlapping half of the one before.
    """
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(diagonals):
        last = k
        while last + 1 < len(diagonals) and diagonals[last + 1] - diagonals[last] <= band:
            last += 1
        low, high = diagonals[k], diagonals[last]
        while high - low > 4 * size:
            out.append((low, low + 4 * size))
            low += 2 * size
        out.append((low, high))
        k = last + 1
    return out


def find_in_row(index: TemplateIndex, known: np.ndarray, hits: list[tuple[int, int, int]], band: int, min_coverage: float, memo: dict) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched words, first, end) in one document of word numbers known; overlapping finds give way to
    the one with more matched words, then the higher coverage, then the template listed first. What is left free where finds
    gave way is searched again."""
    out: list[tuple[int, float, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    while hits:
        by_part: dict[tuple[int, int, int], set[int]] = {}  # diagonals by template and free part of the document
        for at, t, place in hits:
            n = bisect(taken, (at, len(known)))
            begin, stop = taken[n - 1][1] if n else 0, taken[n][0] if n < len(taken) else len(known)
            if begin <= at and at + K <= stop:
                by_part.setdefault((t, begin, stop), set()).add(at - place)
        finds = set()
        for (t, begin, stop), diagonals in by_part.items():
            size = len(index.words[t])
            for low, high in spans(sorted(diagonals), size, band):
                left = max(begin, low - band)
                window = known[left : min(stop, high + band + size)].tolist()
                key = (t, low - left - band, high - left + band, *window)
                found = memo.get(key)
                if found is None:
                    if len(memo) > 50_000:
                        memo.clear()
                    found = memo[key] = occurrences(index, t, window, low - left - band, high - left + band, min_coverage)
                finds.update((-matched, -matched / size, t, left + first, left + end) for matched, first, end in found)
        gave_way = []
        for matched, coverage, t, first, end in sorted(finds):
            at = bisect(taken, (first, end))
            if (not at or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (first, end))
                out.append((t, -coverage, -matched, first, end))
            else:
                gave_way.append((first, end))
        hits = near(hits, gave_way, 3 * max(map(len, index.words)) + band) if gave_way else []
    return out


def near(hits: list[tuple[int, int, int]], places: list[tuple[int, int]], reach: int) -> list[tuple[int, int, int]]:
    """The hits at most reach words away from one of places."""
    merged: list[list[int]] = []
    for first, end in sorted(places):
        if merged and first - reach <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end + reach)
        else:
            merged.append([first - reach, end + reach])
    starts = [m[0] for m in merged]
    return [h for h in hits if (n := bisect(starts, h[0])) and h[0] <= merged[n - 1][1]]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, band: int = BAND) -> DataFrame:
    """One row per license found in a document: doc_id, license, coverage (matched words over words of the template),
    matched_words, start and end (characters of the text, end excluded).

    All of every text is searched. A find covers min_coverage of its template and, where NAMES lists them, has the license's
    name and version; a template of fewer than SHORT words without these must match in all words. Null and empty texts have no row, a null doc_id stays null, repeated rows each give
    their rows, other columns are ignored. The compiled templates are sent along with the function; they don't depend on
    the corpus.
    """
    index = TemplateIndex.compile(TEMPLATES if templates is None else templates)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for part in parts:
            ids = part.column("doc_id")
            data, offsets = batches.text_buffers(part.column("text"))
            out: list[tuple] = []
            for top, _, chunk, offs in batches.chunks(data, offsets):
                start, end, hashes, bounds = batches.words(chunk, offs)
                known = index.ids(hashes)
                at, template, place = index.hits(hashes, bounds, known)
                row = np.searchsorted(bounds, at, "right") - 1
                edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(row) else []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    r = int(row[a])
                    base, text = int(bounds[r]), offs[r]
                    listed = list(zip((at[a:b] - base).tolist(), template[a:b].tolist(), place[a:b].tolist(), strict=True))
                    found = find_in_row(index, known[base : bounds[r + 1]], listed, band, min_coverage, memo)
                    letters = np.flatnonzero((chunk[text : offs[r + 1]] & 0xC0) != 0x80) if found else []  # first byte of each character
                    for t, coverage, matched, first, stop in found:
                        chars = np.searchsorted(letters, [start[base + first] - text, end[base + stop - 1] - text]).tolist()
                        out.append((top + r, index.names[t], coverage, matched, *chars))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(arrays[0]), *arrays[1:]], ["doc_id", "license", "coverage", "matched_words", "start", "end"])

    return batches.with_doc_columns(docs).mapInArrow(search, "doc_id bigint, license string, coverage double, matched_words bigint, start bigint, end bigint")
