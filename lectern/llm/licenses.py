"""Licence scans: Dice coefficient over word bigrams against templates, pruned by size bounds.

A text is compared as a whole, by paragraphs (parted by blank lines), by lines, and by runs of words. A unit is normalised (lower case, copyright
lines and markup marks dropped, words of letters and digits kept) and turned into its set of word bigrams A. For a template B
the Dice coefficient is 2|A and B| / (|A| + |B|); it can reach THRESHOLD only if |A| lies between |B| * t / (2 - t) and
|B| * (2 - t) / t, so most units are dropped on their number of words alone, and most templates on the unit's size; the rest
are counted through an index from bigrams to templates. Both prunings are exact.

Runs of words find what stands across paragraphs or within a sentence. All runs of any length count, but as neighbours overlap,
the best is taken first (ties: first licence by name, earlier, longer), and then others that overlap none taken, no unit of the
same licence, and no unit of another licence with as high a score. A template is looked for only if the words outside units of
its licence hold t / (2 - t) of its bigrams, which any match must; a run is worth trying only between two bigrams of the
template, the first of which doesn't occur in it again. A template of n bigrams thus takes at most n steps a word.

Defined cases: null counts as the empty text (no licence); ties go to the first licence by name, then to the earlier and
the longer unit; equal rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.85

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

# Fixed values: (licence, template), full texts and the one-line notices in use.
_LIBRARY = _GPL.replace("General Public", "Lesser General Public").replace("program", "library")
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
at https://www.eclipse.org/legal/epl-2.0"""
_CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to
the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain
Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""

#: Licences whose own text is short, and the notices that stand for long ones; read_templates() adds whole texts from files.
TEMPLATES = (
    ("AGPL-3.0", _GPL.replace("General Public", "Affero General Public")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", _CC0),
    ("EPL-2.0", _EPL),
    ("GPL-2.0", _GPL.replace("version 3", "version 2")),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", _MPL),
    ("LGPL-2.1", _LIBRARY.replace("version 3", "version 2.1")),
    ("LGPL-3.0", _LIBRARY),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
)

_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"(?im)^[ \t#*/;-]*(?:copyright|\(c\)|©)[^\n]*\b(?:19|20)\d\d\b[^\n]*$")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = _WORD.findall(_COPYRIGHT.sub(" ", text).lower())
    return frozenset(zip(words, words[1:], strict=False))


class Index:
    """Templates by bigram, with the sizes that can reach the threshold."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        self.sets = sets = [bigrams(t) for _, t in templates]
        self.sizes = [len(s) for s in sets]
        self.by: dict[tuple[str, str], list[int]] = {}
        for k, s in enumerate(sets):
            for b in s:
                self.by.setdefault(b, []).append(k)
        # A little wider than exact, as the quotients are rounded.
        self.bounds = [(n * threshold / (2 - threshold) - 1e-9, n * (2 - threshold) / threshold + 1e-9) for n in self.sizes]
        self.misses = [high - n for n, (_, high) in zip(self.sizes, self.bounds, strict=True)]  # bigrams of no use that a match can have
        self.least = min(a for a, _ in self.bounds)

    def best(self, text: str) -> tuple[float, str] | None:
        """Highest coefficient and its licence, if it reaches the threshold."""
        a = bigrams(text)
        fits = {k for k, (low, high) in enumerate(self.bounds) if low <= len(a) <= high}
        if not fits:
            return None
        common = dict.fromkeys(fits, 0)
        for b in a:
            for k in self.by.get(b, ()):
                if k in fits:
                    common[k] += 1
        found = [(-2 * n / (len(a) + self.sizes[k]), self.names[k]) for k, n in common.items()]
        score, name = min(found)
        return (-score, name) if -score >= self.threshold else None


def units(text: str) -> list[tuple[int, int]]:
    """Distinct spans to compare: the whole, its paragraphs, its lines."""
    out, at = {(0, len(text)): None}, 0
    for m in _PARAGRAPH.finditer(text):
        out[at, m.start()] = None
        at = m.end()
    out[at, len(text)] = None
    at = 0
    for line in text.split("\n"):
        out[at, at + len(line)] = None
        at += len(line) + 1
    return list(out)


def _best_run(grams: list[tuple[str, str]], at: int, stop: int, template: frozenset, misses: float) -> tuple[float, int]:
    """Highest coefficient of the runs of bigrams that start at `at` and end before `stop`, negative, and the longest such run's end, negative."""
    first, seen, common, best = grams[at], set(), 0, (0.0, 0)
    for i in range(at, stop):
        g = grams[i]
        if g in seen:
            if g == first:  # the run without its first bigram has the same set
                break
            if g in template and common and -2 * common / (len(seen) + len(template)) == best[0]:
                best = best[0], -i - 1
            continue
        seen.add(g)
        if len(seen) - common > misses + (g in template):
            break
        if g in template:
            common += 1
            best = min(best, (-2 * common / (len(seen) + len(template)), -i - 1))
    return best


class _Starts:
    """Spans (end, start), and the least start of those that end at a place or later (a tree of minima over the ends)."""

    NONE = 1 << 62

    def __init__(self, spans: list[tuple[int, int]], all_in: bool = False):
        self.ends = sorted({b for b, _ in spans})
        self.size = 1 << max(0, len(self.ends) - 1).bit_length()
        self.tree = [self.NONE] * (2 * self.size)
        for b, a in spans if all_in else ():
            self.add(b, a)

    def add(self, end: int, start: int) -> None:
        i = self.size + bisect.bisect_left(self.ends, end)
        while i and self.tree[i] > start:
            self.tree[i] = start
            i >>= 1

    def least(self, at: int) -> int:
        i, out = self.size + bisect.bisect_left(self.ends, at), self.NONE
        if i >= 2 * self.size:
            return out
        out = self.tree[i]
        while i > 1:
            if not i & 1:
                out = min(out, self.tree[i + 1])
            i >>= 1
        return out


def runs(text: str, index: Index, found: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
    """(score, licence, start, end) of the best runs of words, apart from each other and from what units have found."""
    plain = _COPYRIGHT.sub(lambda m: " " * len(m[0]), text)
    words = _WORD.findall(plain.lower())
    held = index.by.keys() & set(zip(words, words[1:], strict=False))
    counts: dict[int, int] = {}
    for g in held:
        for k in index.by[g]:
            counts[k] = counts.get(k, 0) + 1
    likely = [k for k, n in counts.items() if n >= index.bounds[k][0]]
    if not likely:
        return []
    places = [m.span() for m in _WORD.finditer(plain)]
    words = [plain[a:b].lower() for a, b in places]
    grams = list(zip(words, words[1:], strict=False))
    starts = [a for a, _ in places]
    spans = [(score, name, bisect.bisect_left(starts, a), bisect.bisect_left(starts, b) - 1) for score, name, a, b in found]  # in bigrams, ends exclusive
    heap: list[tuple[float, str, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # ascending, apart

    of_name: dict[str, list] = {}
    for _, name, a, b in spans:
        of_name.setdefault(name, []).append((b, a))
    of_name = {name: _Starts(own, all_in=True) for name, own in of_name.items()}
    strong = _Starts([(b, a) for _, _, a, b in spans])  # those of at least the score at hand, which only falls
    waiting = sorted((s, b, a) for s, _, a, b in spans)

    def stop_at(k: int, at: int, score: float) -> int:
        """Where a run of template k and this score, from `at` on, meets what is taken; `at` if it may not start."""
        # A run of bigrams [a, b) has words [a, b]; two runs are apart if they have no word in common.
        j = bisect.bisect_right(taken, (at, len(grams)))
        if j and at <= taken[j - 1][1]:
            return at
        stop = taken[j][0] - 1 if j < len(taken) else len(grams)
        while waiting and waiting[-1][0] >= score:
            strong.add(*waiting.pop()[1:])
        stop = min(stop, strong.least(at) - 1)
        if index.names[k] in of_name:
            stop = min(stop, of_name[index.names[k]].least(at) - 1)
        return max(stop, at)

    def offer(k: int, at: int, stop: int) -> None:
        score, end = _best_run(grams, at, stop, index.sets[k], index.misses[k])
        if -score >= index.threshold:
            heapq.heappush(heap, (score, index.names[k], at, end, k))

    for k in likely:
        free = bytearray(b"\1") * len(grams)
        for _, name, a, b in spans:
            if name == index.names[k]:
                a = max(a - 1, 0)
                free[a : b + 1] = bytes(len(free[a : b + 1]))
        hits = [i for i, g in enumerate(grams) if free[i] and g in index.sets[k]]
        if len({grams[i] for i in hits}) >= index.bounds[k][0]:
            stop = -1
            for i in hits:
                if stop < i:
                    stop = free.find(0, i)
                    stop = stop if stop >= 0 else len(grams)
                offer(k, i, stop)
    out = []
    while heap:
        score, name, at, end, k = heapq.heappop(heap)
        stop = stop_at(k, at, -score)
        if stop >= -end:
            same = index.sets[k] & set(grams[at:-end])
            while at and grams[at - 1] in same and stop_at(k, at - 1, -score) >= -end:
                at -= 1
            bisect.insort(taken, (at, -end))
            out.append((-score, name, places[at][0], places[-end][1]))
        elif stop > at:
            offer(k, at, stop)
    return sorted(out, key=lambda x: (x[2], x[3]))


def find(text: str, index: Index) -> list[tuple[float, str, int, int]]:
    """(score, licence, start, end) of every unit that matches, then of the runs of words."""
    out = []
    for a, b in units(text):
        if b - a < 2 * index.least:  # n bigrams take n + 1 words, so 2n + 1 characters at least
            continue
        got = index.best(text[a:b])
        if got:
            out.append((*got, a, b))
    return out + runs(text, index, out)


def read_templates(spark: SparkSession, path: str, most: int = 16 << 20) -> tuple[tuple[str, str], ...]:
    """Templates from a folder of whole licence texts, each named by its file without .txt; more than `most` characters are refused."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    size = files.agg(F.sum(F.length("value"))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} characters of templates at {path}; {most} are allowed")
    return tuple(sorted((r.file.rsplit("/", 1)[-1].removesuffix(".txt"), r.value) for r in files.collect()))


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, license (best, or null), score, n_matches and spans (licence:start:end, by start) of every row."""

    @F.pandas_udf("license string, score double, n_matches long, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(templates, threshold)
        for texts in batches:
            rows = []
            for t in texts:
                found = find(t, index) if t else []
                top = min(found, key=lambda x: (-x[0], x[1], x[2], -x[3]), default=(0.0, None))
                rows.append((top[1], top[0], len(found), ",".join(f"{name}:{a}:{b}" for _, name, a, b in sorted(found, key=lambda x: (x[2], x[3])))))
            yield pd.DataFrame(rows, columns=["license", "score", "n_matches", "spans"])

    return docs.select("doc_id", run(F.col(text)).alias("r")).select("doc_id", "r.*")
