"""License scans by patience alignment.

Anchors are words that a stretch of text and the template both hold exactly once; the
longest increasing subsequence of their places is kept and the gaps between them are
aligned the same way, down to stretches of equal words.  Coverage is the share of the
template's words that are aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import WORD, in_frames

FOUND = re.compile(WORD)
EDGE = "\"'`.,;:!?()[]<>*#-/"

# Wording of public licence notices.  Short notices name a licence; "-header" is
# the notice that its files carry, "-text" its whole text.
TEMPLATES = {
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD": "Released under the BSD License",
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSL-1.0-text": (
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or "
        "organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-header": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."
    ),
}
#: A notice of fewer words has no word to spare but those that only lead in to it.
SHORT = 20
LEADING = {"a", "dedicated", "distributed", "in", "is", "licensed", "released", "the", "this", "to", "under", "work"}
#: In longer ones these tell a family or version, and have to be there if the template has them.
TELLING = {"affero", "lesser", "library", "2", "2.0", "2.1", "3", "apache", "mozilla", "mpl", "boost", "neither", "endorse", "promote"}


def norm(word: str) -> str:
    return word.strip(EDGE).casefold()


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        j = bisect_left(tails, v)
        if j:
            back[i] = at[j - 1]
        if j == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[j], at[j] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (of a, of b), increasing in both.

    Equal heads and tails are taken first, then the anchors; a gap without anchors is left.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        once_a = {w for w, n in Counter(a[a0:a1]).items() if n == 1}
        once_b = {w for w, n in Counter(b[b0:b1]).items() if n == 1}
        both = once_a & once_b
        if not both:
            continue
        in_b = {b[j]: j for j in range(b0, b1) if b[j] in both}
        places = [(i, in_b[a[i]]) for i in range(a0, a1) if a[i] in both]
        kept = [places[i] for i in increasing([j for _, j in places])]
        pairs += kept
        last = (a0 - 1, b0 - 1)
        for i, j in [*kept, (a1, b1)]:
            if i - last[0] > 1 and j - last[1] > 1:
                todo.append((last[0] + 1, i, last[1] + 1, j))
            last = (i, j)
    return sorted(pairs)


class Scanner:
    """Finds notices by the words of a template that are rarest in all templates.

    An alignment that covers ``least`` of a template misses fewer than its ``rare`` words, so
    it holds one of them, and windows are tried about where each of them says the template
    begins.  Words put in or left out before it move that place, so of much edited notices a
    few are missed.  Windows that hold too few of the template's words, however ordered, aren't
    aligned.  Of overlapping notices that are equally good the one that begins first counts, then
    the one that ends first, then the smaller name.
    """

    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.words = {name: [norm(w) for w in FOUND.findall(text)] for name, text in templates.items()}
        self.bags = {name: Counter(words) for name, words in self.words.items()}
        self.musts = {name: self.telling(words) for name, words in self.words.items()}
        common = Counter(w for words in self.words.values() for w in set(words))
        self.signs: dict[str, list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            spare = len(words) - self.enough(len(words))
            by_rarity = sorted(range(len(words)), key=lambda i: (common[words[i]], self.bags[name][words[i]], -len(words[i]), i))
            for i in by_rarity[: spare + 1]:
                self.signs.setdefault(words[i], []).append((name, i))

    def enough(self, n: int) -> int:
        """Least number of aligned words that cover ``least`` of ``n``."""
        return max(1, math.ceil(self.least * n - 1e-9))

    @staticmethod
    def telling(words: list[str]) -> list[int]:
        """Places of the words that must be aligned: they tell the licence's family and version."""
        if len(words) < SHORT:
            return [i for i, w in enumerate(words) if w not in LEADING]
        return [i for i, w in enumerate(words) if w in TELLING]

    def reach(self, n: int) -> int:
        """Words that a notice may have more than its template."""
        return 2 + n // 4

    def at(self, name: str, words: list[str], begin: int) -> tuple[float, int, int] | None:
        """Coverage, begin and end of the template where its first word is about ``begin``."""
        template, n = self.words[name], len(self.words[name])
        low = max(0, begin - self.reach(n))
        window = words[low : max(low, begin + n + self.reach(n))]
        bag = self.bags[name]
        if sum(min(c, bag[w]) for w, c in Counter(window).items() if w in bag) < self.enough(n):
            return None
        pairs = align(window, template)
        if len(pairs) < self.enough(n) or not set(self.musts[name]) <= {j for _, j in pairs}:
            return None
        if pairs[-1][0] + 1 - pairs[0][0] > n + self.reach(n):
            return None
        return len(pairs) / n, low + pairs[0][0], low + pairs[-1][0] + 1

    def begins(self, words: list[str]) -> dict[str, set[int]]:
        starts: dict[str, set[int]] = {}
        for i, w in enumerate(words):
            for name, offset in self.signs.get(w, ()):
                starts.setdefault(name, set()).add(i - offset)
        return starts

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, begin, end) of the notices: where several overlap, the best one.

        The best has the most words aligned, less those between them that aren't; then comes
        the coverage, and which begins first.
        """
        words = [norm(w) for w in FOUND.findall(text or "")]
        found = set()
        for name, places in self.begins(words).items():
            for begin in places:
                hit = self.at(name, words, begin)
                if hit:
                    found.add((name, *hit))
        return best(found, self.words)


def best(found: set[tuple[str, float, int, int]], words: dict[str, list[str]]) -> list[tuple[str, float, int, int]]:
    """Of overlapping notices the best, as ``scan`` says."""
    taken: list[tuple[str, float, int, int]] = []
    for name, coverage, a, b in sorted(found, key=lambda f: (f[3] - f[2] - 2 * round(f[1] * len(words[f[0]])), -f[1], f[2], f[3], f[0])):
        if all(b <= c or d <= a for _, _, c, d in taken):
            taken.append((name, coverage, a, b))
    return sorted(taken, key=lambda f: (f[2], f[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """License notices in every whole text.

    Result: doc_id, license, coverage (share of the template's words aligned, ``least`` or
    more, those that tell family and version among them), begin_word, end_word (of the text's
    words, end exclusive); one row per notice found, and none overlap.  Documents without one,
    null and empty texts give no rows; repeated rows repeat theirs; texts of any length are
    scanned whole.  An empty table gives an empty result; extra columns are ignored.
    """
    known = TEMPLATES if templates is None else templates
    columns = ["doc_id", "license", "coverage", "begin_word", "end_word"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scanner(known, least)
        for batch in batches:
            rows = [(None if pd.isna(d) else int(d), *f) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for f in own.scan(t)]
            yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(columns)}, dtype=object)

    return in_frames(docs.select("doc_id", "text"), run, "doc_id long, license string, coverage double, begin_word long, end_word long")
