"""License scan: winnowed fingerprints pick candidates, banded alignment measures them (operator 10).

Templates and texts become terms (case-folded runs of letters and digits). Every run of ``GRAM`` terms is hashed; of each
``WINDOW`` consecutive hashes the least is a fingerprint, so any GRAM + WINDOW - 1 terms in common share one. Templates
under ``SHORT`` terms give all runs of two terms (one, for a single term) without winnowing: at the least coverage of 0.75
some run of two is whole wherever terms are replaced. The templates' fingerprints are an inverted index (a fixed, small table). A shared fingerprint proposes a template and a
diagonal; the text around it is aligned with the whole template within a band, and what covers enough of the template
is reported. Of overlapping reports the one with the most matched terms stays. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Remembered, mix64, read_table

GRAM = 3
WINDOW = 2
SHORT = 12
BAND = 8
MIN_COVERAGE = 0.75

#: Widely published notices and licence texts; others can be passed in.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT (line)": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD (line)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0 (line)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (line)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

_PARTED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").casefold().encode("utf-8", "surrogatepass").translate(_PARTED).split()


class Hashes:
    def __init__(self) -> None:
        import xxhash

        self._known = Remembered(xxhash.xxh64_intdigest)

    def terms(self, terms: list[bytes]) -> np.ndarray:
        return np.array(self._known.all(terms), np.uint64)

    def grams(self, h: np.ndarray, size: int = GRAM) -> np.ndarray:
        """Hash of each run of ``size`` terms, given theirs."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, np.uint64(size))
        for j in range(size):
            out = mix64(out + h[j : j + n])
        return out

    def fingerprints(self, terms: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of the fingerprints of a text: the winnowed runs of GRAM terms and all runs of the other sizes."""
        h, found = self.terms(terms), []
        for size in sizes:
            own = self.grams(h, size)
            at = winnow(own) if size == GRAM else np.arange(len(own))
            found.append((own[at], at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash (the last of equals) of each WINDOW consecutive hashes; of all if there are fewer."""
    if len(hashes) < WINDOW:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1))


class Index:
    """Sorted fingerprints with their templates and places."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = [n for n in sorted(templates) if terms_of(templates[n])]
        self.terms = [terms_of(templates[n]) for n in self.names]
        own, rows = Hashes(), []
        size = [GRAM if len(terms) >= SHORT else min(2, len(terms)) for terms in self.terms]
        self.sizes = tuple(sorted(set(size)))
        for t, terms in enumerate(self.terms):
            rows += [(int(h), t, int(i)) for h, i in zip(*own.fingerprints(terms, (size[t],)), strict=True)]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.of, self.at = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)


def align(template: list[bytes], part: list[bytes], diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """(matched, score, start, end): the template against the stretch of ``part`` that scores best, within ``band`` of
    ``diagonal`` (place in part less place in template). A match is 2, a gap or replaced term -1; the ends of ``part`` are free."""
    width = 2 * band + 1
    low = -(10**9)
    # cell: (score, matched, start)
    row = [(0, 0, diagonal - band + c) if 0 <= diagonal - band + c <= len(part) else (low, 0, 0) for c in range(width)]
    for i, t in enumerate(template):
        new = [(low, 0, 0)] * width
        for c in range(width):
            j = i + 1 + diagonal - band + c  # terms of part used so far
            best = (low, 0, 0)
            if c + 1 < width and row[c + 1][0] > low and 0 <= j <= len(part):
                s, m, a = row[c + 1]
                best = (s - 1, m, a)
            if 1 <= j <= len(part):
                if row[c][0] > low:
                    s, m, a = row[c]
                    same = part[j - 1] == t
                    best = max(best, (s + 2, m + 1, a) if same else (s - 1, m, a), key=lambda x: (x[0], x[1]))
                if c and new[c - 1][0] > low:
                    s, m, a = new[c - 1]
                    best = max(best, (s - 1, m, a), key=lambda x: (x[0], x[1]))
            new[c] = best
        row = new
    c = max(range(width), key=lambda c: (row[c][0], row[c][1], -c))
    score, matched, start = row[c]
    return matched, score, start, len(template) + diagonal - band + c


def band_of(template: list[bytes]) -> int:
    """Terms that a notice may shift by: half of a short one, so that its neighbour isn't taken for it."""
    return min(BAND, max(1, len(template) // 2))


def scan_terms(terms: list[bytes], hashes: Hashes, index: Index, min_coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched terms, start term, end term) of the notices in a text, by place."""
    h, at = hashes.fingerprints(terms, index.sizes)
    if not len(at) or not len(index.hash):
        return []
    low, high = np.searchsorted(index.hash, h, "left"), np.searchsorted(index.hash, h, "right")
    diagonals: dict[int, set[int]] = {}
    for k in np.flatnonzero(high > low).tolist():
        for e in range(int(low[k]), int(high[k])):
            diagonals.setdefault(int(index.of[e]), set()).add(int(at[k]) - int(index.at[e]))
    spots = []
    for t, some in diagonals.items():
        last, band = None, band_of(index.terms[t])
        for d in sorted(some):  # a band takes in every diagonal within half its width of its own
            if last is None or d > last + band // 2:
                last = d
                spots.append((t, d))
    found = []
    for t, diagonal in spots:
        template = index.terms[t]
        band = band_of(template)
        base = max(0, diagonal - band)
        part = terms[base : max(0, diagonal) + len(template) + band]
        matched, score, start, end = align(template, part, diagonal - base, band)
        if matched >= min_coverage * len(template):
            found.append((score, matched, t, base + start, base + end))
    found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
    out: list[tuple] = []
    for _score, matched, t, start, end in found:
        if all(end <= a or start >= z for *_, a, z in out):
            out.append((index.names[t], matched / len(index.terms[t]), matched, start, end))
    return sorted(out, key=lambda x: x[3])


_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_terms", pa.int32()), ("start_term", pa.int32()), ("end_term", pa.int32())])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, coverage (share of the template's terms), matched_terms, start_term,
    end_term (terms of the text, end exclusive).

    Null and empty texts hold none. A null doc_id is reported as null, repeated rows each by itself. Templates without
    terms are ignored; of equal matches the first template by name is reported. Texts of any length are scanned whole; an empty
    table gives no rows; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(templates), Hashes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                rows += [(doc, *x) for x in scan_terms(terms_of(text.as_py()), hashes, index, min_coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, matched_terms int, start_term int, end_term int")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
