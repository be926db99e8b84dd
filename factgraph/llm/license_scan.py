"""License scans: winnowed word grams of templates in an inverted index, then banded alignment at each candidate place."""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
BAND, COVERAGE, MAX_TEMPLATE_BYTES = 16, 0.8, 16 << 20
#: Candidates that are aligned at once.
BLOCK = 4096
#: Longest grams of words that are fingerprints.
GRAM = 3
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
    or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
    PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MIT-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
    without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
    the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
    ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
    LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""),
    ("BSD-disclaimer", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
    FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def run_length(n: int, need: int) -> int:
    """Words that stay together somewhere if up to n - need edits, of any kind, hit a template of n words."""
    return -(-need // (n - need + 1))


def fingerprints(template: list[str], need: int) -> tuple[int, list[int]]:
    """Gram size and places of a template's winnowed fingerprints: of each window of grams the last one of the least hash.

    A window is as long as the run of words that any reported number of edits
    leaves whole, so every such run holds a fingerprint.
    """
    run = max(1, run_length(len(template), need))
    k = min(GRAM, run)
    w = run - k + 1
    hashes = [zlib.crc32(" ".join(template[p : p + k]).encode()) for p in range(len(template) - k + 1)]
    return k, sorted({min(range(p, p + w), key=lambda q: (hashes[q], -q)) for p in range(max(1, len(hashes) - w + 1)) if p + w <= len(hashes)})


def align(template: np.ndarray, text: np.ndarray, starts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Most template words found in order in the text from each start on, off the diagonal by at most the band; their number, first and end place.

    All starts go through the template's rows together. A cell holds the number
    of matched words and, below it, the place of the first: more words win,
    then a later first place, and at last the end that comes first.
    """
    n, width, one = len(template), 2 * band + 1, np.int64(1 << 32)
    padded = np.concatenate([np.full(band + 1, -1, np.int64), text, np.full(n + 2 * band + 2, -1, np.int64)])
    # Word j of the text stands at padded[j + band + 1]; in row i, offset o, the word is starts + i + o - band.
    place = starts[:, None] + np.arange(width) - band
    best = np.zeros((len(starts), width + 1), np.int64)
    for i in range(n):
        j = place + i
        hit = padded[np.clip(j + band + 1, 0, len(padded) - 1)] == template[i]
        found = np.where(best[:, :-1] == 0, one + j, best[:, :-1] + one)
        best[:, :-1] = np.maximum.accumulate(np.maximum(np.where(hit, found, 0), best[:, 1:]), axis=1)
        best[:, -1] = best[:, -2] * 0
    top = best[:, :-1].max(axis=1)
    end = place[np.arange(len(starts)), (best[:, :-1] == top[:, None]).argmax(axis=1)] + n
    return top >> 32, top & (one - 1), end


def tight(template: np.ndarray, text: np.ndarray, first: int, end: int, matched: int) -> int:
    """The end of the last matched word: the shortest text from `first` on in which so many template words are found in order."""
    row = np.zeros(len(template) + 1, np.int64)
    for j in range(first, end):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(template == text[j], row[:-1] + 1, 0)))
        if row[-1] >= matched:
            return j + 1
    return end


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, start, end, matched, coverage for each place where a template occurs; start and end count words.

    Templates are the operator's parameter; more than MAX_TEMPLATE_BYTES of them
    are refused, as their index goes to every task. Words are lower-cased
    letters and digits. Grams of a text that are fingerprints of a template name
    candidate places; those within the band of each other are one, aligned once.
    A place is reported if at least `coverage` of the template's words align;
    none is missed that is at most so many words edited, inserted words counted.
    Overlapping places of one template count once: the most words first, then
    the shorter, then the earlier. Null and empty texts and empty tables give no
    rows, a null doc_id is kept, repeated rows repeat theirs, other columns are
    left out. A text of any length is scanned once, and its candidates are
    aligned in blocks.
    """
    if sum(len(t) for _, t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError("templates are too large for an index in each task")
    known = [(name, words(t)) for name, t in templates if words(t)]
    needs = [max(1, next(n for n in range(len(own) + 1) if n >= coverage * len(own))) for _, own in known]
    index: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for t, (_, own) in enumerate(known):
        k, places = fingerprints(own, needs[t])
        for p in places:
            index.setdefault(k, {}).setdefault(" ".join(own[p : p + k]), []).append((t, p))
    ids = {w: i for i, w in enumerate(sorted({w for _, own in known for w in own}))}
    coded = [np.array([ids[w] for w in own], np.int64) for _, own in known]
    # How far edits may move a place off its candidate's diagonal.
    drifts = [max(1, min(BAND, len(own) // 2), len(own) - need) for (_, own), need in zip(known, needs, strict=True)]

    def places_of(t: int, starts: list[int], text: np.ndarray):
        """Places where enough of template t aligns, from the candidates' starts."""
        own, need = coded[t], needs[t]
        # Of starts that lie close behind a first one, only that is aligned, in a band that is wider by as much.
        close, keep, last = drifts[t] // 2, [], None
        for x in np.unique(np.array(starts, np.int64)).tolist():
            if last is None or x - last > close:
                keep.append(x)
                last = x
        for at in range(0, len(keep), BLOCK):
            found: dict[tuple[int, int], int] = {}
            matched, first, end = align(own, text, np.array(keep[at : at + BLOCK], np.int64), drifts[t] + close)
            for m, a, b in zip(matched.tolist(), first.tolist(), end.tolist(), strict=True):
                if m >= need:
                    found[m, a] = min(b, len(text), found.get((m, a), len(text)))
            for (m, a), b in found.items():
                yield m, a, tight(own, text, a, b, m)

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                tokens = words(text)
                near: dict[int, list[int]] = {}
                for k, grams in index.items():
                    for i, gram in enumerate(map(" ".join, zip(*(tokens[j:] for j in range(k)), strict=False)) if k > 1 else tokens):
                        for t, p in grams.get(gram, ()):
                            near.setdefault(t, []).append(i - p)
                if not near:
                    continue
                line = np.array([ids.get(w, -2) for w in tokens], np.int64)
                for t, starts in near.items():
                    name, own = known[t]
                    taken: list[tuple[int, int]] = []
                    for n, s, e in sorted(set(places_of(t, starts, line)), key=lambda x: (-x[0], x[2] - x[1], x[1])):
                        at = bisect.bisect_left(taken, (s, e))  # of those taken only the neighbours can overlap
                        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                            taken.insert(at, (s, e))
                            rows.append((doc, name, s, e, n, n / len(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "license", "start", "end", "matched", "coverage"])
            yield out.assign(doc_id=pd.array([None if d is None else int(d) for d in out.doc_id], "Int64"))

    # doc_id goes through as text: a column of longs with a null would reach pandas as doubles.
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(lean(run), "doc_id long, license string, start long, end long, matched long, coverage double")
