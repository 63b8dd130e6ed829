"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Words are lower-case runs of letters and digits (inner dots, plus signs and hyphens stay). A region of a text is a line, a maximal
run of lines that hold template bigrams, the whole text, or a window: as many words as a template has, from one of its bigrams
on, wherever it stands (within a long line, or behind another licence). Its bigrams are a set. Dice is 2|A n B| / (|A| + |B|).

Dice t needs |A n B| >= t/(2-t) * |B| and t/(2-t) * |B| <= |A| <= (2-t)/t * |B|. So a template is looked at only where the text holds
at least t/(2-t) of its bigrams, and a line or run only if its own size lies within those bounds of a template and it holds at least as
many bigrams of templates as the smallest needs. These bounds are exact: they drop no region that reaches the threshold. Windows
of a template that start at a bigram of it are counted by sums over positions, and all that may reach it are compared in full,
however many a text has, so that a passage is found alike in a short and in a long text.

Every text is scanned whole. Returns one row per (doc_id, license): dice (the best), the region's first_line and last_line
(from 0, the first of equals), n_regions, regions that reach the threshold without overlapping a better one, and is_best, false
where another licence of the same place has a greater Dice (licences of one family are alike). Null, empty and
wordless texts give no row; ids pass through as they are, null or not; repeated rows give repeated results; extra columns are
ignored; an empty table gives no rows. Licences that have no text in ``_TEXTS`` (the Creative Commons, for one) are found by notice.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame

from brindle.llm.common import per_slice

THRESHOLD = 0.8
#: Windows are compared in batches of so many cells at most (or one window); the batch changes no result.
WINDOW_CELLS = 1 << 21
_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*|\n")

#: Names of licences for notices of one line: fixed values.
_NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    **{f"CC-{k}-{v}": [f"CC {k} {v}"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
}
#: Forms of notices: fixed values.
_FORMS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "Distributed under the terms of the {}."]
#: Texts and headers of licences: fixed values.
_TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

#: Header of the GNU licences, with places for the licence's name and version: fixed value.
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."""
_GNU_KINDS = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_TEXTS |= {f"{k}-{v}": _GNU.format(_GNU_KINDS[k], v.removesuffix(".0")) for k, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))}
#: The clause that the BSD licence of three clauses has more than that of two: fixed value.
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_TEXTS["BSD-3-Clause"] = _TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED BY", _THIRD + "THIS SOFTWARE IS PROVIDED BY", 1)


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates: notices by rule, then texts."""
    return [(k, f.format(n)) for k, names in _NAMES.items() for n in names for f in _FORMS] + list(_TEXTS.items())


def words_of(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w != "\n"]


class Scanner:
    """Templates as bigram sets over a small vocabulary."""

    def __init__(self, threshold: float = THRESHOLD, known=None):
        self.threshold = t = threshold
        self.vocab: dict[str, int] = {}
        sets = []
        for name, text in known or templates():
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            sets.append((name, frozenset(zip(ids, ids[1:])), len(ids)))
        sets.sort(key=lambda x: len(x[1]))
        self.sets = [x[:2] for x in sets]
        self.words = [x[2] for x in sets]
        self.sizes = np.array([len(s) for _, s in self.sets])
        self.need = np.ceil(t / (2 - t) * self.sizes - 1e-9).astype(np.int64)
        # bigram -> number, and for each number the templates that hold it
        number: dict[tuple[int, int], int] = {}
        for _, s in self.sets:
            for x in sorted(s):
                number.setdefault(x, len(number))
        self.table = np.full((len(self.vocab) + 1,) * 2, -1, dtype=np.int32)
        for (a, b), k in number.items():
            self.table[a, b] = k
        self.holds = np.zeros((len(number), len(self.sets)), dtype=bool)
        for j, (_, s) in enumerate(self.sets):
            self.holds[[number[x] for x in s], j] = True

    def best(self, words: list[str]) -> list[tuple[float, str]]:
        """(Dice, licence) of all licences that a region reaches."""
        bigrams = set(zip(words, words[1:]))
        get = self.vocab.get
        known = {(x, y) for a, b in bigrams if (x := get(a)) and (y := get(b))}
        n, t, found = len(bigrams), self.threshold, {}
        lo, hi = np.searchsorted(self.sizes, n * t / (2 - t) - 1e-9), np.searchsorted(self.sizes, n * (2 - t) / t + 1e-9, side="right")
        for name, s in self.sets[lo:hi]:
            dice = 2 * len(known & s) / (n + len(s)) if n + len(s) else 0.0
            if dice >= t and dice > found.get(name, 0):
                found[name] = dice
        return [(d, k) for k, d in found.items()]

    def windows(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ranges (starts, ends) of all windows that may reach the threshold, and the templates that the text may hold.
        bigrams: numbers of the text's bigrams, -1 outside templates."""
        at = np.flatnonzero(bigrams >= 0)
        present = np.flatnonzero(self.holds[np.unique(bigrams[at])].sum(axis=0) >= self.need)
        ranges = [np.zeros(0, dtype=np.int64)]
        width = len(bigrams) + 2
        for j in present:
            own = at[self.holds[bigrams[at], j]]
            size = self.words[j]
            inside = np.searchsorted(own, own + size - 1) - np.arange(len(own))  # positions of its bigrams in each window
            start = own[inside >= self.need[j]]
            ranges.append(start * width + np.minimum(start + size, width - 1))
        start, end = np.divmod(np.unique(np.concatenate(ranges)), width)
        return start, end, present

    def compare(self, bigrams: np.ndarray, words: list[str]) -> dict[str, list[np.ndarray]]:
        """licence -> (-Dice, start, end) of all windows that reach it, in arrays: what ``best`` finds, for all windows at once."""
        start, end, present = self.windows(bigrams)
        found: dict[str, list[np.ndarray]] = {}
        if not len(start):
            return found
        # the position where each bigram of the text was last: a window's distinct bigrams are those that were last before it
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        codes = ids[:-1] * len(numbers) + ids[1:]
        order = np.argsort(codes, kind="stable")
        last = np.full(len(codes), -1, dtype=np.int64)
        again = codes[order[1:]] == codes[order[:-1]]
        last[order[1:][again]] = order[:-1][again]
        here = np.unique(bigrams[bigrams >= 0])
        holds = self.holds[np.ix_(here, present)].astype(np.float32)  # counts are whole numbers below 2**24
        sizes = self.sizes[present]
        lengths = end - start - 1
        step = max(1, WINDOW_CELLS // max(len(here), int(lengths.max())))
        for k in range(0, len(start), step):
            first, n = start[k : k + step], lengths[k : k + step]
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            fresh = last[place] < first[row]
            distinct = np.bincount(row[fresh], minlength=len(n))
            fresh &= bigrams[place] >= 0
            own = np.zeros((len(n), len(here)), dtype=np.float32)
            own[row[fresh], np.searchsorted(here, bigrams[place[fresh]])] = 1
            dice = 2 * (own @ holds).astype(np.float64) / (distinct[:, None] + sizes)
            for j in np.flatnonzero((dice >= self.threshold).any(axis=0)):
                good = np.flatnonzero(dice[:, j] >= self.threshold)
                found.setdefault(self.sets[present[j]][0], []).append(np.stack([-dice[good, j], first[good], first[good] + n[good] + 1]))
        return found

    def scan(self, text: str) -> dict[str, tuple[float, int, int, int, bool]]:
        """licence -> (dice, first line, last line, regions, whether no other licence fits that place better)."""
        tokens = _WORD.findall(text.lower())
        words = [w for w in tokens if w != "\n"]
        if len(words) < 2:
            return {}
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
        bigrams = self.table[ids[:-1], ids[1:]]
        hits = bigrams >= 0
        if hits.sum() < self.need[0]:
            return {}
        feeds = np.flatnonzero(np.fromiter((w == "\n" for w in tokens), dtype=bool, count=len(tokens)))
        starts = np.concatenate([[0], feeds - np.arange(len(feeds))])  # the first word of each line
        ends = np.append(starts[1:], len(words))
        total = np.concatenate([[0], np.cumsum(hits)])
        per_line = np.where(ends - starts > 1, total[np.maximum(ends - 1, 0)] - total[np.minimum(starts, len(total) - 1)], 0)
        regions = {(int(starts[k]), int(ends[k])) for k in np.flatnonzero(per_line >= self.need[0])}
        run = (per_line > 0) | (ends - starts == 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], run.astype(np.int8), [0]])))
        regions |= {(int(starts[a]), int(ends[b - 1])) for a, b in zip(edges[::2], edges[1::2]) if b - a > 1 and per_line[a:b].sum() >= self.need[0]}
        regions.add((0, len(words)))
        found = self.compare(bigrams, words)
        for a, b in regions:
            near = int(hits[a : b - 1].sum())
            # a set of n bigrams of which near lie in templates reaches none but those that near suffices for
            if near >= self.need[0]:
                for dice, name in self.best(words[a:b]):
                    found.setdefault(name, []).append(np.array([[-dice], [a], [b]]))
        # the best first, equals by place; places are exact as doubles
        hits = {name: (h := np.concatenate(hit, axis=1))[:, np.lexsort(h[::-1])] for name, hit in found.items()}
        best = {name: (float(h[0, 0]), int(h[1, 0]), int(h[2, 0])) for name, h in hits.items()}
        out = {}
        for name, hit in hits.items():
            taken: list[int] = []  # starts and ends of the regions taken, in order; none overlap
            for a, b in zip(hit[1].astype(np.int64).tolist(), hit[2].astype(np.int64).tolist()):
                k = bisect_right(taken, a)
                if k % 2 == 0 and (k == len(taken) or taken[k] >= b):
                    taken[k:k] = [a, b]
            least, a, b = best[name]
            ahead = any(d < least and x < b and a < y for d, x, y in best.values())
            line = lambda at: int(np.searchsorted(starts, at, side="right")) - 1
            out[name] = (-least, line(a), line(b - 1), len(taken) // 2, not ahead)
        return out


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, known=None) -> DataFrame:
    def make():
        scanner = Scanner(threshold, known)

        def work(texts):
            rows = [(i, k, *v) for i, t in enumerate(texts) if t for k, v in sorted(scanner.scan(t).items())]
            names = ["license", "dice", "first_line", "last_line", "n_regions", "is_best"]
            return [r[0] for r in rows], {n: [r[k] for r in rows] for k, n in enumerate(names, 1)}

        return work

    return per_slice(docs, ["doc_id"], "text", make, "license string, dice double, first_line long, last_line long, n_regions long, is_best boolean")
