"""License notices in texts, by patience alignment with templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of a template's words that a text must hold in order.
COVERAGE = 0.8
#: Bytes of templates that one scan may hold; they are sent to every executor.
MAX_TEMPLATE_BYTES = 16 << 20

# Public license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_WORD = re.compile(r"[^\W_]+")


def license_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(places: Sequence[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        if pile == len(tops):
            tops.append(p)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = p, i
        back[i] = top_at[pile - 1] if pile else -1
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, by rows of bits: bit i of a row is 0 where word i of a adds to the length."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for w in b:
        last = rows[-1]
        hit = last & places.get(w, 0)
        rows.append(((last + hit) | (last - hit)) & full)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:  # word i - 1 adds nothing
            i -= 1
        elif (rows[j] ^ rows[j - 1]) & ((1 << i) - 1) == 0 or (rows[j] & (1 << i) - 1).bit_count() == (rows[j - 1] & (1 << i) - 1).bit_count():
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both.

    Words that are unique in both runs are anchors; the longest rising chain of them stands, and the gaps between are
    aligned in the same way. A gap without anchors is aligned by a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where]
        chain = [anchors[i] for i in _rising([j for _, j in anchors])]
        if chain:
            out += chain
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
                stack.append((i + 1, k, j + 1, m))
        else:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
    return sorted(out)


@dataclass
class Template:
    """A license text, and words of which a covering text must hold one: as many of its longest as may not all miss."""

    name: str
    words: list[str]
    coverage: float
    signs: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        may_miss = int((1 - self.coverage) * len(self.words) + 1e-9)
        longest = sorted(range(len(self.words)), key=lambda i: (-len(self.words[i]), self.words[i], i))
        for i in sorted(longest[: may_miss + 1]):
            self.signs.setdefault(self.words[i], i)

    def found(self, text: list[str], places: Mapping[str, list[int]]) -> list[tuple[int, int, int]]:
        """Separate places of the license in a text: (first word, last word, words matched).

        A place spans at most as many words more than the template as the template may miss. Around each sign, the
        stretch that such a place may take is aligned; what lies in a place found before is left out. Where the
        stretch reaches into a second copy, the alignment is repeated without what stands before the last matches.
        """
        n, out = len(self.words), []
        room = n - int(self.coverage * n)
        for p, q in sorted((p, q) for w, q in self.signs.items() for p in places.get(w, ())):
            if out and p <= out[-1][1]:
                continue
            low = max(out[-1][1] + 1 if out else 0, p - q - room)
            pairs = patience(self.words, text[low : p + (n - q) + room])
            while len(pairs) >= self.coverage * n - 1e-9:
                # tighten a stretch that starts in words before the notice: what is left must cover as much
                start = pairs[0][1] + 1
                again = patience(self.words, text[low + start : p + (n - q) + room])
                if len(again) < len(pairs):
                    break
                low, pairs = low + start, again
            if len(pairs) >= self.coverage * n - 1e-9:
                out.append((low + pairs[0][1], low + pairs[-1][1], len(pairs)))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and license found: doc_id, license, n_places, first_word, last_word, coverage.

    A license is found where at least `coverage` of its template's words stand in order in a stretch of the text with
    at most as many other words as the template may miss. The row holds the best place, the first of equal ones;
    n_places counts separate ones. Words are runs of letters and
    digits in lower case. Null, empty and blank texts hold no license; repeated rows give repeated rows; other
    columns are not read; an empty table gives no rows.

    A text is aligned with a template only if it holds one of the words that a covering text can't miss all of.
    Texts are scanned where they are read, without a shuffle; the templates are a parameter of checked size.
    """
    if sum(map(len, templates.values())) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"the templates hold more than {MAX_TEMPLATE_BYTES} characters; give them in parts")
    made = [Template(name, license_words(text), coverage) for name, text in sorted(templates.items()) if license_words(text)]
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = {w for t in sent.value for w in t.signs}
        any_sign = re.compile("|".join(sorted(map(re.escape, signs), key=len, reverse=True)) or "(?!)")
        for batch in batches:
            rows, which = [], []
            for i, value in enumerate(batch["text"]):
                low = (value.as_py() or "").lower()
                if not any_sign.search(low):
                    continue
                text = license_words(low)
                places: dict[str, list[int]] = {}
                for p, w in enumerate(text):
                    if w in signs:
                        places.setdefault(w, []).append(p)
                for t in sent.value:
                    if spans := t.found(text, places):
                        first, last, matched = max(spans, key=lambda s: (s[2], -s[0]))
                        rows.append((t.name, len(spans), first, last, matched / len(t.words)))
                        which.append(i)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            arrays = [batch["doc_id"].take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "license", "n_places", "first_word", "last_word", "coverage"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, license string, n_places long, first_word long, last_word long, coverage double")
