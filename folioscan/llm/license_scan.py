"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text's segments are its lines, the whole, and for each template the windows of words that begin and end with one of its
bigrams, wherever lines end. With b bigrams in a template and threshold t, a segment of a bigrams can only reach t if
t / (2 - t) <= a / b <= (2 - t) / t: templates out of these bounds are never compared. So many of a template's bigrams must
also be in the text, and as close together as the longest window, before any window is counted. A short notice is mostly frame, so the words that name its licence and
version must all be there: a notice of another licence, or of another version, is none of this one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.llm.common import table

THRESHOLD = 0.8

#: Between the licences that share a text.
_OR = " OR "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Notices by which texts name their licence, heads of long licences, and short licences as a whole. A long licence's file is told by its head and by the notice that it says to use. Fixed values, public texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", f"{_ISC}"),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (f"BSD-2-Clause{_OR}BSD-3-Clause", _BSD),
    (f"BSD-2-Clause{_OR}BSD-3-Clause", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_END}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under Apache 2.0."),
]

#: Short and long names of the Creative Commons licences, and their versions with what they are called. Fixed values.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: GNU licences by name and version, and identifiers that have no templates of their own above. Fixed values.
_GNU = {"GPL": ("General Public License", "2 3"), "LGPL": ("Lesser General Public License", "2.1 3"), "AGPL": ("Affero General Public License", "3")}
_IDENTIFIERS = "MIT MIT-0 ISC Zlib Unlicense Apache-2.0 BSL-1.0 BSD-2-Clause BSD-3-Clause MPL-2.0 EPL-1.0 EPL-2.0 CC0-1.0"


def _notices() -> list[tuple[str, str]]:
    """Notices that differ in a name or a version only, and lines of identifiers, by rule."""
    out, ids = [], _IDENTIFIERS.split()
    for short, name in _CC.items():
        for version, called in _CC_VERSIONS.items():
            ids.append(f"CC-{short}-{version}")
            out += [(ids[-1], f"Licensed under CC {short} {version}."), (ids[-1], f"This work is licensed under a Creative Commons {name} {version} {called} License.")]
    for short, (name, versions) in _GNU.items():
        for version in versions.split():
            ids.append(f"{short}-{version if '.' in version else version + '.0'}")
            out += [(ids[-1], f"This work is licensed under the GNU {name}, version {version}."), (ids[-1], f"Licensed under the {short} v{version}."), (ids[-1], f"Licensed under the {short} version {version}."), (ids[-1], f"Licensed under the {short}-{version}.")]
    return out + [(i, f"SPDX-License-Identifier: {i}") for i in ids]


TEMPLATES += [t for t in _notices() if t not in TEMPLATES]

#: Words that name a licence; so does any with a digit. Fixed values.
NAMING = frozenset("apache mit isc zlib unlicense gnu gpl lgpl agpl lesser affero general public license version mozilla mpl epl bsl bsd clause cc cc0 creative commons attribution sharealike noncommercial noderivatives by sa nc nd identifier".split())
#: Templates of so many bigrams or fewer are mostly frame: what they share with a text must include all bigrams of naming words.
SHORT = 24

_WORD = re.compile(r"[^\W_]+")
Bigrams = frozenset[tuple[str, str]]


def words(text: str) -> list[str]:
    """Normalised: lower case, runs of letters and digits, "licence" as "license"."""
    return _WORD.findall(text.lower().replace("licence", "license"))


def bigrams(w: list[str]) -> Bigrams:
    return frozenset(zip(w, w[1:], strict=False))


def dice(a: Bigrams, b: Bigrams) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass
class Scanner:
    templates: list[tuple[str, str]]
    threshold: float = THRESHOLD

    @cached_property
    def known(self) -> list[tuple[str, Bigrams]]:
        return [(name, bigrams(words(text))) for name, text in self.templates]

    @cached_property
    def index(self) -> dict[tuple[str, str], list[int]]:
        """Templates by bigram."""
        found = defaultdict(list)
        for i, (_, b) in enumerate(self.known):
            for g in b:
                found[g].append(i)
        return dict(found)

    @cached_property
    def naming(self) -> list[Bigrams]:
        """What a segment must have of each template: of a short one, its bigrams of naming words."""
        names = lambda w: w in NAMING or any(c.isdigit() for c in w)
        return [frozenset(g for g in b if names(g[0]) and names(g[1])) if len(b) <= SHORT else frozenset() for _, b in self.known]

    @cached_property
    def lengths(self) -> list[int]:
        return [len(words(text)) - 1 for _, text in self.templates]

    def best(self, segment: Bigrams) -> tuple[float, str] | None:
        """(Dice, licence) of the most similar template at or over the threshold; of equals the first name."""
        shared: Counter[int] = Counter()
        for g in segment & self.index.keys():
            shared.update(self.index[g])
        a, t, found = len(segment), self.threshold, None
        for i, n in shared.items():
            b = len(self.known[i][1])
            if t * b <= (2 - t) * a and t * a <= (2 - t) * b and 2 * n >= t * (a + b) and self.naming[i] <= segment:
                one = (-2 * n / (a + b), self.known[i][0])
                found = one if found is None else min(found, one)
        return found and (-found[0], found[1])

    def windows(self, w: list[str]) -> list[tuple[float, str, int, int]]:
        """(Dice, licence, first word, end word) of the most similar windows of words.

        From each bigram of a template the window that is most like it counts, up to (2 - t) / t times as long as the
        template. Better ones go first (of equals the longer); a window of which half lies in those before it is left out."""
        pairs, index, t = list(zip(w, w[1:], strict=False)), self.index, self.threshold
        distinct: Counter[int] = Counter()
        for g in index.keys() & set(pairs):
            distinct.update(index[g])
        least = {i: ceil(t * len(self.known[i][1]) / (2 - t) - 1e-9) for i in distinct}
        held: dict[int, list[int]] = {i: [] for i, n in distinct.items() if n >= least[i]}
        if not held:
            return []
        for at, g in enumerate(pairs):
            for i in index.get(g, ()):
                if i in held:
                    held[i].append(at)
        found = []
        for i, hits in held.items():
            name, b = self.known[i][0], len(self.known[i][1])
            longest = int((2 - t) / t * self.lengths[i] + 1e-9)
            for k in range(len(hits) - least[i] + 1):
                start = last = hits[k]
                if hits[k + least[i] - 1] - start >= longest:
                    continue
                seen: set[tuple[str, str]] = set()
                shared, best, end = 0, 0.0, start
                for j in range(k, len(hits)):
                    at = hits[j]
                    seen.update(pairs[last:at])
                    if at - start >= longest or t * len(seen) > (2 - t) * b:
                        break
                    shared += pairs[at] not in seen
                    seen.add(pairs[at])
                    last = at + 1
                    if 2 * shared >= t * (len(seen) + b) and 2 * shared / (len(seen) + b) > best and self.naming[i] <= seen:
                        best, end = 2 * shared / (len(seen) + b), at + 2
                if best:
                    found.append((-best, start - end, name, start))
        out, taken = [], bytearray(len(w))
        for best, size, name, start in sorted(found):
            if 2 * taken.count(1, start, start - size) < -size:
                taken[start : start - size] = b"\x01" * -size
                out.append((-best, name, start, start - size))
        return out

    def scan(self, text: str | None) -> list[tuple[float, str, int, int]]:
        """(Dice, licence, first line, end line) of each segment that matches; one that says no more than its lines do is left out."""
        out, index = [], self.index
        lines = (text or "").split("\n")
        total: list[str] = []
        ends: list[int] = []
        for i, line in enumerate(lines):
            w = words(line)
            total += w
            ends.append(len(total))
            if any(g in index for g in zip(w, w[1:], strict=False)) and (hit := self.best(bigrams(w))):
                out.append((*hit, i, i + 1))
        for score, name, start, end in self.windows(total):
            first, after = bisect_right(ends, start), bisect_left(ends, end) + 1
            if not any(x[1] == name and x[0] >= score and first <= x[2] and x[3] <= after for x in out):
                out = [x for x in out if (x[1], x[2], x[3]) != (name, first, after) or after > first + 1]  # the line's own is less exact
                out.append((score, name, first, after))
        if len(lines) > 1:
            hit = self.best(bigrams(total))
            if hit and all(hit[1] != x[1] or hit[0] > x[0] for x in out):
                out.append((*hit, 0, len(lines)))
        told = [x for x in out if _OR not in x[1]]
        return sorted((x for x in out if _OR not in x[1] or not any(y[1] in x[1].split(_OR) and y[2] <= x[2] and x[3] <= y[3] for y in told)), key=lambda x: (x[2], x[3]))


_MATCH = "array<struct<dice:double,license:string,first_line:int,end_line:int>>"


def scan_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "matches", templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with their matches: array of (dice, license, first_line, end_line), lines from 0, by line.

    Null and empty texts match nothing. Every row and other column stays; repeated rows are each scanned. Of templates
    that are equally similar the first by name counts. An empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(list(templates), threshold))  # the templates, which are given

    @F.pandas_udf(_MATCH)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: [dict(zip(("dice", "license", "first_line", "end_line"), m, strict=True)) for m in sent.value.scan(x)], na_action=None)

    return docs.withColumn(out_col, run(F.col(text_col)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, and license, dice and line of the best match (null without one) of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    top = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"), m["first_line"].alias("line"))))
    return found.withColumn("top", top).select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.col("top.license").alias("license"), F.round(-F.col("top.d"), 6).alias("dice"), F.col("top.line").alias("line"))
