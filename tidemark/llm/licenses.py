"""License notices inside documents: winnowed fingerprints or enough words, then banded alignment.

Templates are fingerprinted by winnowing their word n-grams; an inverted index from
fingerprint to template and place picks candidates wherever a document has one of
these n-grams, or wherever as many words as must match stand close enough together.
Each candidate region is aligned with its template inside a band of
word shifts, and the alignment gives the matched words and their span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import blocks

# License notices as their publishers word them.
TEMPLATES: dict[str, str] = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        'software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
    ),
}

#: Words of an n-gram, n-grams of a winnowing window, and word shifts an alignment may make.
GRAM, WINNOW, BAND = 3, 2, 6
#: Share of a template's words that must be matched.
LEAST_COVERAGE = 0.7
#: Everything but ASCII letters and digits and non-ASCII bytes separates words here.
_GAPS = np.array([not (chr(c).isalnum() if c < 128 else True) for c in range(256)])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = blocks.words(data, offsets, _GAPS)
    return starts, ends, first, blocks.word_hashes(data, starts, ends, fold=True)


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the least n-gram of every window of WINNOW n-grams."""
    n = max(len(grams) - WINNOW + 1, min(len(grams), 1))
    return np.unique([i + int(np.argmin(grams[i : i + WINNOW])) for i in range(n)]).astype(np.int64)


class Index:
    """Fingerprint -> (template, place), and the templates' words."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = list(templates), []
        self.known, self.often = np.zeros(0, np.uint64), []
        codes, template, place = [], [], []
        for i, text in enumerate(templates.values()):
            data, offsets = blocks.flat(pa.array([text]))
            hashes = _words(data, offsets)[3]
            grams = blocks.Rolling(hashes).windows(GRAM)
            self.words.append(hashes)
            for p in winnowed(grams):
                codes.append(grams[p])
                template.append(i)
                place.append(int(p))
        # Every word of any template, and how often each template has it.
        self.known = np.unique(np.concatenate([self.known, *self.words]))
        self.often = [np.bincount(np.searchsorted(self.known, words), minlength=len(self.known)) for words in self.words]
        order = np.argsort(np.array(codes, np.uint64), kind="stable")
        self.codes, self.template, self.place = np.array(codes, np.uint64)[order], np.array(template)[order], np.array(place)[order]

    def hits(self, grams: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the document, template, place in the template)."""
        low = np.searchsorted(self.codes, grams)
        for at in np.flatnonzero(self.codes[np.minimum(low, len(self.codes) - 1)] == grams):
            j = int(low[at])
            while j < len(self.codes) and self.codes[j] == grams[at]:
                yield int(at), int(self.template[j]), int(self.place[j])
                j += 1


class Crowds:
    """Where a block's texts hold so many words of a template that it may stand there.

    An alignment that reaches the coverage matches that many words of the template, each
    no more often than the template has it; so the stretch it reads holds them, and
    places whose stretch does not need no alignment.  All stretches of all texts are
    counted at once: an occurrence of a word that the template has m times counts in
    the stretches that hold it but not the m-th occurrence before it.
    """

    def __init__(self, index: Index, hashes: np.ndarray, first: np.ndarray):
        self.index, self.first, self.size = index, first, len(hashes)
        at = np.searchsorted(index.known, hashes)
        at = np.minimum(at, max(len(index.known) - 1, 0))
        there = np.flatnonzero(index.known[at] == hashes) if len(index.known) else np.zeros(0, np.int64)
        word = at[there]
        order = np.argsort(word, kind="stable")
        self.word, self.place = word[order], there[order]
        # Where the text of each occurrence begins.
        self.edge = first[np.searchsorted(first, self.place, side="right") - 1]

    def starts(self, template: int, least: float) -> np.ndarray:
        """Places near which the template may begin; of neighbours every few, so that the
        band of an alignment covers the others."""
        words = self.index.words[template]
        need, reach = -int(-least * len(words) // 1), len(words) + 2 * BAND
        often = self.index.often[template][self.word]
        mine = np.flatnonzero(often > 0)
        if need < 1 or len(mine) < need:
            return np.zeros(0, np.int64)
        word, place, times = self.word[mine], self.place[mine], often[mine]
        before = mine - times
        same = (before >= 0) & (self.word[np.maximum(before, 0)] == word)
        barred = np.where(same, self.place[np.maximum(before, 0)], -1)
        low = np.maximum(np.maximum(barred, place - reach), self.edge[mine] - 1) + 1
        counts = np.cumsum(np.bincount(low, minlength=self.size + 1) - np.bincount(place + 1, minlength=self.size + 1))
        enough = np.flatnonzero(counts[: self.size] >= need)
        if not len(enough):
            return enough
        # A stretch begins BAND words before the template, or where its text begins.
        step = BAND // 2
        doc = np.searchsorted(self.first, enough, side="right") - 1
        opening = enough == self.first[doc]
        begins = np.concatenate([enough + BAND, *(enough[opening] + d for d in range(-BAND, BAND, step))])
        owner = np.concatenate((doc, *[doc[opening]] * len(range(-BAND, BAND, step))))
        cells = np.unique(np.stack((owner, begins // step)), axis=1)
        return np.concatenate((cells, cells + [[0], [1]]), axis=1).T


def aligned(template: np.ndarray, text: np.ndarray, start: int) -> tuple[int, int, int]:
    """Matched words and the span of words in ``text``, when the template begins near ``start``.

    Best global alignment of the template with free ends in the text, never more than
    BAND words off the diagonal; a match gains 2, a change or gap costs 1.
    """
    n, wide = len(template), 2 * BAND + 1
    low = -(10**9)
    # score[b]: template read to i, text read to i + start + b - BAND; with matches and begin.
    score, matched = [0] * wide, [0] * wide
    begin = [start + b - BAND for b in range(wide)]
    for i in range(n):
        new, hit, frm = [low] * wide, [0] * wide, [0] * wide
        for b in range(wide):
            at = i + start + b - BAND
            if 0 <= at < len(text):
                same = text[at] == template[i]
                new[b], hit[b], frm[b] = score[b] + (2 if same else -1), matched[b] + bool(same), begin[b]
            if b + 1 < wide and score[b + 1] - 1 > new[b]:
                new[b], hit[b], frm[b] = score[b + 1] - 1, matched[b + 1], begin[b + 1]
            if b and new[b - 1] - 1 > new[b]:
                new[b], hit[b], frm[b] = new[b - 1] - 1, hit[b - 1], frm[b - 1]
        score, matched, begin = new, hit, frm
    best = max(range(wide), key=lambda b: (score[b], matched[b], -abs(b - BAND)))
    end = min(n + start + best - BAND, len(text))
    return matched[best], max(begin[best], 0), max(end, 0)


SCAN = "doc_id long, license string, coverage double, matched_words int, template_words int, start_char long, end_char long, passage string"


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per notice found: which, its coverage, matched words, span and passage.

    Every place of every whole text that holds enough words of a template is aligned with
    it, never more than BAND words off the diagonal: a notice with more words than that
    inserted or left out in one place is found only if what stands on one side of them
    reaches the coverage.  ``start_char`` and ``end_char`` count code points.  Of hits of one template that overlap the one with more matched words
    stays.

    Rows: a null or blank text has no notice; a null or repeated id is reported as it
    is, row by row; no template or an empty table gives an empty result; further
    columns are ignored.
    """
    index = Index(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches):
            data, offsets = blocks.flat(block.column("text"))
            starts, ends, first, hashes = _words(data, offsets)
            doc = np.repeat(np.arange(block.num_rows), np.diff(first))
            grams = blocks.Rolling(hashes).windows(GRAM)
            wanted: dict[tuple[int, int, int], None] = {}
            for at, template, place in index.hits(grams) if len(index.codes) else ():
                if doc[at] == doc[at + GRAM - 1]:
                    begin = at - place - int(first[doc[at]])
                    # One alignment for all hits that its band covers.
                    if not any((int(doc[at]), template, begin + d) in wanted for d in range(-BAND // 2, BAND // 2 + 1)):
                        wanted[(int(doc[at]), template, begin)] = None
            crowds = Crowds(index, hashes, first)
            for template in range(len(index.words)):
                for number, cell in np.unique(crowds.starts(template, least).reshape(-1, 2), axis=0).tolist():
                    wanted[(number, template, cell * (BAND // 2) - int(first[number]))] = None
            found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for number, template, begin in wanted:
                words = index.words[template]
                low = max(begin - BAND, 0) + int(first[number])
                high = min(begin + len(words) + BAND + int(first[number]), int(first[number + 1]))
                matched, a, b = aligned(words, hashes[low:high], begin + int(first[number]) - low)
                if matched and matched >= least * len(words):
                    found.setdefault((number, template), []).append((matched, low + a, low + b))
            rows = []
            for (number, template), spans in sorted(found.items()):
                kept: list[tuple[int, int, int]] = []
                for matched, a, b in sorted(spans, key=lambda s: (-s[0], s[1])):
                    if all(b <= x or a >= y for _, x, y in kept):
                        kept.append((matched, a, b))
                for matched, a, b in sorted(kept, key=lambda s: s[1]):
                    from_, to, zero = int(starts[a]), int(ends[b - 1]), int(offsets[number])
                    head = len(data[zero:from_].tobytes().decode())
                    passage = data[from_:to].tobytes().decode()
                    n = len(index.words[template])
                    rows.append((block.column("doc_id")[number].as_py(), index.names[template], matched / n, matched, n, head, head + len(passage), passage))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                names = ["doc_id", "license", "coverage", "matched_words", "template_words", "start_char", "end_char", "passage"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(scan, SCAN)
