"""Licence scans: MinHash bands over overlapping text windows, verified by exact containment.

A text's words (lower-cased, without punctuation at their ends) give shingles of `SHINGLE` words. Templates of like size
form a class: for the templates of n to m shingles, windows of W shingles start every S = max(1, n // 4) shingles, where
W = m + m // 4 + S - 1. Each window is signed by `BANDS` MinHash bands of one row, and a band index (band and value to
templates) retrieves the templates that share a band with it. A text is then verified against each template retrieved
from its windows: wherever m + m // 4 or fewer consecutive shingles hold a share `CONTAINMENT` of the template's distinct
shingles, there is a hit.

The guarantee. Such a passage lies wholly in some window, since W is the passage's greatest length and a stride less one.
It holds c = ceil(CONTAINMENT * n) of the template's n shingles, so the window's Jaccard similarity with the template is
at least j = c / (W + n - c). Classes are cut so that j >= `LEAST_JACCARD`; a window is missed with (1 - j) ** BANDS,
below 5e-6 for 0.4 and 24. Which windows are laid over a text changes what is retrieved with that probability only; what
is verified doesn't depend on them.

Windows are signed incrementally: every shingle is hashed once for each band, the least of each stride are taken once,
and a window's are the least of its strides'. Texts are laid end to end for that, so a batch costs a few array operations.
They are scanned whole, in one pass without a shuffle; the templates are a parameter of bounded size.

Defined cases: null, empty and short texts have no hits; a template shorter than a shingle is one shingle of
all its words and is compared with runs of as many words; overlapping hits of one licence (of any of its templates) are
one hit, from the first to the last of their shingles; hits that don't overlap are hits of their own; a hit of which
four fifths also belong to a hit of another licence with greater containment goes (notices of several licences differ by a
word); repeated rows have equal hits; rows without hits have an empty list in `scanned` and no row in `found`; all columns of the table, of any
name, come back in the column `row` of `scanned`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, mix, named, nested, of_row

SHINGLE, BANDS, CONTAINMENT, LEAST_JACCARD, SEED = 5, 24, 0.8, 0.4, 17
BLOCK, PART_WORDS = 1 << 14, 1 << 15
#: Licence texts, notices and passages by which licences are recognised: fixed values.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
}
ENDS = re.compile(r"^[^\w]+|[^\w]+$")


def plain(word: str) -> str:
    return ENDS.sub("", word.lower())


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of `size` word codes."""
    if len(words) < size or not size:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
    return mix(h)


def least_jaccard(n: int, window: int, containment: float) -> float:
    """Of a window that holds the share of a template of n shingles."""
    held = int(np.ceil(containment * n - 1e-9))
    return held / (window + n - held)


@dataclass
class Template:
    licence: str
    size: int  # words of a shingle
    hashes: np.ndarray  # distinct and sorted
    length: int  # shingles that a passage may span
    need: int  # of the distinct shingles

    def spans(self, hashes: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, last shingle, containment) of every passage, by its first shingle, in a whole text's shingles."""
        mine = np.flatnonzero(np.isin(hashes, self.hashes))
        kinds = np.searchsorted(self.hashes, hashes[mine]).tolist()
        places = mine.tolist()
        count = [0] * len(self.hashes)
        out, end, distinct = [], 0, 0
        for k, first in enumerate(places):
            while end < len(places) and places[end] < first + self.length:
                distinct += count[kinds[end]] == 0
                count[kinds[end]] += 1
                end += 1
            if distinct >= self.need:
                out.append((first, places[end - 1], distinct / len(self.hashes)))
            count[kinds[k]] -= 1
            distinct -= count[kinds[k]] == 0
        return out


@dataclass
class WindowClass:
    """Templates whose windows are laid alike, and their band index."""

    size: int
    stride: int
    strides: int  # of a window
    keys: np.ndarray  # band << 32 | value, sorted
    owners: np.ndarray  # the template of each key
    seen: np.ndarray  # whether any key's value ends in these 16 bits


class Scanner:
    """The templates' band index, and the scan of texts."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT):
        self.words: dict[str, int] = {}
        self.salts = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS // 2, dtype=np.uint64)
        self.templates: list[Template] = []
        for licence, own in sorted(templates.items()):
            for text in own:
                codes = np.array([h for w in ascii_words(text) if (h := self.word(w))], dtype=np.uint64)
                size = min(SHINGLE, len(codes))
                if size:
                    n, hashes = len(codes) - size + 1, np.unique(shingles(codes, size))
                    self.templates.append(Template(licence, size, hashes, n + n // 4, int(np.ceil(containment * len(hashes) - 1e-9))))
        self.classes: list[WindowClass] = []
        of_class: list[int] = []
        for at in sorted(range(len(self.templates)), key=lambda i: (self.templates[i].size, self.templates[i].length)):
            if of_class and not self._alike([*of_class, at], containment):
                self._close(of_class)
                of_class = []
            of_class.append(at)
        if of_class:
            self._close(of_class)

    def _window(self, members: list[int]) -> tuple[int, int]:
        """(stride, strides of a window)"""
        own = [self.templates[i] for i in members]
        stride = max(1, min(len(t.hashes) for t in own) // 4)
        return stride, -(-(max(t.length for t in own) + stride - 1) // stride)

    def _alike(self, members: list[int], containment: float) -> bool:
        stride, strides = self._window(members)
        own = [self.templates[i] for i in members]
        return len({t.size for t in own}) == 1 and min(least_jaccard(len(t.hashes), stride * strides, containment) for t in own) >= LEAST_JACCARD

    def _close(self, members: list[int]) -> None:
        stride, strides = self._window(members)
        pairs = sorted({(band << 32 | int(value), i) for i in members for band, value in enumerate(self.signed(self.templates[i].hashes).min(axis=1))})
        keys = np.array([k for k, _ in pairs], dtype=np.uint64)
        seen = np.zeros(1 << 16, dtype=bool)
        seen[keys.astype(np.uint16)] = True
        self.classes.append(WindowClass(self.templates[members[0]].size, stride, strides, keys, np.array([i for _, i in pairs]), seen))

    def word(self, raw: str) -> int:
        """The hash of a word as it stands in a text; 0 for one without letters or digits."""
        if len(self.words) > 1_000_000:
            self.words.clear()
        w = plain(raw)
        h = self.words[raw] = xxhash.xxh64_intdigest(w.encode(), SEED) | 1 if w else 0
        return h

    def signed(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each shingle in each band: two of 32 bits from every salted mix."""
        mixed = mix(hashes[None, :] ^ self.salts[:, None])
        return np.concatenate([(mixed >> np.uint64(32)).astype(np.uint32), mixed.astype(np.uint32)])

    def retrieved(self, hashes: np.ndarray, size: int) -> set[tuple[int, int, int]]:
        """(template, first, end) of the windows that share a band with a template."""
        out: set[tuple[int, int, int]] = set()
        classes = [c for c in self.classes if c.size == size]
        reach = max((c.stride * (c.strides + 1) for c in classes), default=0)
        for start in range(0, len(hashes), BLOCK):
            part = self.signed(hashes[start : start + BLOCK + reach])
            for c in classes:
                low = part
                if c.stride > 1:
                    low = part[:, :: c.stride].copy()
                    for k in range(1, c.stride):
                        other = part[:, k :: c.stride]
                        np.minimum(low[:, : other.shape[1]], other, out=low[:, : other.shape[1]])
                width = 1
                while width < c.strides:  # the least of the strides behind each place, by doubling
                    step = min(width, c.strides - width)
                    if step < low.shape[1]:
                        low = np.concatenate([np.minimum(low[:, :-step], low[:, step:]), low[:, -step:]], axis=1)
                    width += step
                hit = np.flatnonzero(c.seen[low.astype(np.uint16)])
                if not len(hit):
                    continue
                band, at = np.divmod(hit, low.shape[1])
                keys = band.astype(np.uint64) << np.uint64(32) | low[band, at]
                left, right = np.searchsorted(c.keys, keys), np.searchsorted(c.keys, keys, side="right")
                for k in np.flatnonzero(right > left):
                    first = start + int(at[k]) * c.stride
                    out.update((int(i), first, first + c.stride * c.strides) for i in c.owners[left[k] : right[k]])
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """(licence, first word, end word, containment) of each text's hits; word places count ASCII-space words."""
        out: list[list] = []
        part: list[np.ndarray] = []
        held = 0
        get = self.words.get
        for text in texts:
            part.append(np.array([h if (h := get(w)) is not None else self.word(w) for w in ascii_words(text)], dtype=np.uint64))
            held += len(part[-1])
            if held >= PART_WORDS:
                out += self._scanned(part)
                part, held = [], 0
        return out + self._scanned(part)

    def _scanned(self, codes: list[np.ndarray]) -> list[list[tuple[str, int, int, float]]]:
        found: list[dict[str, list]] = [{} for _ in codes]
        places = [np.flatnonzero(c) for c in codes]
        for size in sorted({c.size for c in self.classes}):
            each = [shingles(c[at], size) for c, at in zip(codes, places)]
            ends = np.cumsum([len(h) for h in each])
            wanted = set()
            for template, first, end in self.retrieved(np.concatenate(each) if each else np.zeros(0, np.uint64), size):
                a, b = np.searchsorted(ends, [first, end - 1], side="right")
                wanted.update((int(k), template) for k in range(a, min(b + 1, len(each))))
            for k, template in sorted(wanted):
                t, at = self.templates[template], places[k]
                spans = [(int(at[a]), int(at[b + size - 1]) + 1, held) for a, b, held in t.spans(each[k])]
                if spans:
                    found[k].setdefault(t.licence, []).extend(spans)
        return [strongest([(licence, *span) for licence, spans in sorted(own.items()) for span in merged(spans)]) for own in found]


def merged(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Spans (first, end, containment) with those that overlap as one."""
    out: list[tuple[int, int, float]] = []
    for a, b, held in sorted(spans):
        if out and a < out[-1][1]:
            first, end, most = out[-1]
            out[-1] = (first, max(end, b), max(most, held))
        else:
            out.append((a, b, held))
    return out


def strongest(hits: list[tuple[str, int, int, float]], share: float = 0.8) -> list[tuple[str, int, int, float]]:
    """hits without those of which a share belongs to one of another licence that holds more of its template."""

    by: dict[str, list] = {}
    for h in hits:
        by.setdefault(h[0], []).append(h)
    if len(by) < 2:
        return hits
    ends = {licence: [h[2] for h in own] for licence, own in by.items()}  # hits of one licence are in order and apart

    def beaten(h) -> bool:
        for licence, own in by.items():
            k = bisect_right(ends[licence], h[1]) if licence != h[0] else len(own)
            while k < len(own) and own[k][1] < h[2]:
                if own[k][3] > h[3] and min(own[k][2], h[2]) - max(own[k][1], h[1]) >= share * (h[2] - h[1]):
                    return True
                k += 1
        return False

    return [h for h in hits if not beaten(h)]


HIT = "licence string, first_word int, end_word int, containment double"
_KEPT: dict[str, Scanner] = {}


def _scanner(templates: dict[str, list[str]], containment: float) -> Scanner:
    """One for each worker process."""
    name = repr((templates, containment))
    if name not in _KEPT:
        _KEPT[name] = Scanner(templates, containment)
    return _KEPT[name]


def scanned(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """row (all of docs) and `hits`, over every whole text."""

    @F.pandas_udf(f"array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    def hits(column):
        import pandas as pd

        names = [x.split()[0] for x in HIT.split(", ")]
        return pd.Series([[dict(zip(names, h)) for h in own] for own in _scanner(templates, containment).scan_all([x or "" for x in column])])

    return nested(docs).withColumn("hits", hits(of_row(text).cast("string")))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """key and each hit of its text, a row for each: texts go through one Arrow pass and aren't carried along."""
    kind = docs.select(named(key)).schema[0].dataType

    def run(batches):
        import pyarrow as pa

        scanner = _scanner(templates, containment)
        for b in batches:
            hits = scanner.scan_all([x or "" for x in b.column(1).to_pylist()])
            at = [k for k, own in enumerate(hits) for _ in own]
            columns = list(zip(*(h for own in hits for h in own))) or [()] * 4
            types = (pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=[key, *(x.split()[0] for x in HIT.split(", "))])

    return docs.select(named(key).alias("key"), named(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind.simpleString()}, {HIT}")
