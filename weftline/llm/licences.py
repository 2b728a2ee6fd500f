"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters or digits in lower case (A-Z); shingles are five words. Each template is looked for in
windows of the smallest size (a ladder of sizes, each half as long again) of at least twice its words; windows
overlap by three quarters, so any passage of up to one and a half times its words lies whole inside some window.

Bands. A window of W words that holds 80 % of a template's T distinct shingles has a Jaccard similarity of at
least J = 0.8 T / (W - 4 + 0.2 T) with it (for few shingles 0.8 T is rounded up). Each template has as many bands
of one MinHash row as make (1 - J) ** bands at most MISS = 1e-9, so 16 to some 120: of a thousand million such
windows about one isn't retrieved, however short the template is. Windows with fewer distinct template shingles
than any template of their size needs can't match and are not hashed; this loses nothing.

A retrieved pair counts if the window holds at least 80 % of the template's distinct shingles, exactly.

Result: one row for each document and template: best containment, the first window's first byte and last
byte that template shingles cover (in the text's UTF-8), and how many windows matched.

Cases: null and empty texts give no rows, nor do texts shorter than five words; templates shorter than that are
refused. Null ids are returned as such. Repeated rows are scanned one by one. Texts of any length are read whole.
Of equal containments the first window counts. Columns besides id and text are not looked at; the id column may
not have an output column's name (ValueError).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import LOWER, combine, map_batches, mix, slices, span_hashes, text_buffer
from weftline.llm.quality import tokens

SHINGLE, CONTAINS, SMALLEST_WINDOW = 5, 0.8, 10
#: Probability that no band of a matching window and template agrees, at most.
MISS = 1e-9

# Parts of public licences.
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_PERMISSION = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)

#: Whole public licences, their notices and their one-line forms.
TEMPLATES: dict[str, str] = {
    "MIT whole": _MIT_PERMISSION + _MIT_DISCLAIMER,
    "BSD-2-Clause": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_CONDITIONS + _BSD_ENDORSEMENT + _BSD_DISCLAIMER,
    "ISC whole": (
        _ISC_PERMISSION + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including "
        "the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works "
        "of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "GPL-2.0 notice": _GNU_NOTICE.format("General Public License", 2),
    "LGPL-3.0 notice": _GNU_NOTICE.format("Lesser General Public License", 3),
    "AGPL-3.0 notice": _GNU_NOTICE.format("Affero General Public License", 3),
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT line": "Released under the MIT License",
    "MIT": _MIT_PERMISSION,
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 notice": _GNU_NOTICE.format("General Public License", 3),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC": _ISC_PERMISSION,
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many each text has."""
    starts, ends, kind, counts = tokens(data, offs)
    fine = kind != 3
    total = np.concatenate([[0], np.cumsum(fine)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return starts[fine], ends[fine], np.diff(total[at])


def shingle_hashes(word: np.ndarray) -> np.ndarray:
    """Hash of the five words from each word on; the last four of all words have none."""
    n = len(word) - SHINGLE + 1
    return combine(*(word[k : k + n] for k in range(SHINGLE))) if n > 0 else np.zeros(0, np.uint64)


def least_jaccard(shingles: int, window: int) -> float:
    """Similarity of a template with any window of so many words that holds CONTAINS of its distinct shingles, at least."""
    shared = math.ceil(CONTAINS * shingles - 1e-9)
    return shared / (max(window - SHINGLE + 1, shared) + shingles - shared)


class Index:
    """Templates by shingle and their MinHash values."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.shingles: list[np.ndarray] = []
        self.window: list[int] = []
        for name, text in templates.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            low = LOWER[raw]
            s, e, _ = word_spans(low, np.array([0, len(low)]))
            if len(s) < SHINGLE:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            self.shingles.append(np.unique(shingle_hashes(span_hashes(low, s, e))))
            size = SMALLEST_WINDOW
            while size < 2 * len(s):
                size += size // 2
            self.window.append(size)
        self.needs = [math.ceil(CONTAINS * len(x) - 1e-9) for x in self.shingles]
        self.bands = [max(16, math.ceil(math.log(MISS) / math.log1p(-j))) if (j := least_jaccard(len(x), w)) < 1 else 1 for x, w in zip(self.shingles, self.window, strict=True)]
        self.every = np.unique(np.concatenate(self.shingles))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.every & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.seeds = mix(np.arange(1, max(self.bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        #: By window size: its templates, their MinHash values (none beyond a template's bands) and the fewest shingles that can match.
        self.of_size: dict[int, tuple[list[int], np.ndarray, np.ndarray, int]] = {}
        for size in sorted(set(self.window)):
            ts = [t for t, w in enumerate(self.window) if w == size]
            most = max(self.bands[t] for t in ts)
            live = np.arange(most)[None] < np.array([self.bands[t] for t in ts])[:, None]
            self.of_size[size] = ts, np.stack([self.minhash(self.shingles[t], most) for t in ts]), live, min(self.needs[t] for t in ts)

    def minhash(self, shingles: np.ndarray, bands: int) -> np.ndarray:
        return mix(shingles[None, :] ^ self.seeds[:bands, None]).min(1)

    def retrieved(self, size: int, shingles: np.ndarray) -> list[int]:
        """Templates of this window size of which a band agrees with the window's."""
        ts, minima, live, _ = self.of_size[size]
        agree = ((minima == self.minhash(shingles, minima.shape[1])) & live).any(1)
        return [t for t, a in zip(ts, agree.tolist(), strict=True) if a]


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(items))


def windows_of(n_words: int, size: int) -> tuple[int, int]:
    """Words between the starts of two windows, and the last window's number."""
    step = max(1, size // 4)
    return step, -(-(n_words - size) // step) if n_words > size else 0


def scan_text(index: Index, sh: np.ndarray, hit: np.ndarray, n_words: int) -> dict[int, tuple[float, int, int, int]]:
    """Matches of one text: its shingles, which of them are template shingles (positions), its number of words.

    Gives for each template (containment, first word, last word, windows).
    """
    found: dict[int, tuple[float, int, int, int]] = {}
    for size, (_, _, _, least) in index.of_size.items():
        if len(hit) < least:
            continue
        step, last = windows_of(n_words, size)
        # Windows in which a template shingle lies whole.
        first = np.maximum(-(-(hit + SHINGLE - size) // step), 0)
        end = np.minimum(hit // step, last)
        candidates = np.unique(np.concatenate([np.minimum(first + k, end) for k in range(int((end - first).max()) + 1)]))
        for w in candidates.tolist():
            a, b = w * step, min(w * step + size, n_words) - SHINGLE + 1
            inside = hit[np.searchsorted(hit, a) : np.searchsorted(hit, b)]
            if len(inside) < least:
                continue
            for t in index.retrieved(size, sh[a:b]):
                mine = inside[np.isin(sh[inside], index.shingles[t])]
                held = len(np.unique(sh[mine]))
                if held >= index.needs[t]:
                    share = held / len(index.shingles[t])
                    best = found.get(t)
                    if best is None:
                        found[t] = (share, int(mine[0]), int(mine[-1]) + SHINGLE - 1, 1)
                    elif share > best[0]:
                        found[t] = (share, int(mine[0]), int(mine[-1]) + SHINGLE - 1, best[3] + 1)
                    else:
                        found[t] = (*best[:3], best[3] + 1)
    return found


def scan_texts(column: pa.Array, index: Index) -> list[tuple[int, str, float, int, int, int]]:
    """(row, template, containment, first byte, end byte, windows)."""
    data, offs = text_buffer(column)
    out = []
    for i, j in slices(offs):
        low = LOWER[data[offs[i] : offs[j]]]
        s, e, counts = word_spans(low, offs[i : j + 1] - offs[i])
        sh = shingle_hashes(span_hashes(low, s, e))
        if not len(sh):
            continue
        near = np.flatnonzero(index.maybe[(sh & np.uint64(0xFFFFF)).astype(np.int64)])
        near = near[np.isin(sh[near], index.every)]
        at = np.concatenate([[0], np.cumsum(counts)])
        text_of = np.searchsorted(at, near, "right") - 1
        whole = near + SHINGLE <= at[text_of + 1]  # not across two texts
        near, text_of = near[whole], text_of[whole]
        for t in np.unique(text_of).tolist():
            a, b = int(at[t]), int(at[t + 1])
            for k, (share, first, last, windows) in scan_text(index, sh[a : b - SHINGLE + 1], near[text_of == t] - a, b - a).items():
                base = int(offs[i + t] - offs[i])
                out.append((i + t, index.names[k], share, int(s[a + first]) - base, int(e[a + last]) - base, windows))
    return out


_OUT = ("licence", "containment", "start_byte", "end_byte", "windows")


def licence_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, licence, containment, start_byte, end_byte, windows)."""
    items = tuple((templates or TEMPLATES).items())
    if id_col.lower() in _OUT:
        raise ValueError(f"the id column may not be called {id_col}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = scan_texts(b.column(1), _index(items))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])],
            names=[id_col, *_OUT],
        )

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, licence string, containment double, start_byte long, end_byte long, windows long")
