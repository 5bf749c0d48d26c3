"""Operator 7: licence scans.

A text is normalised (lower case, letters and digits alone, spelling variants joined) and compared to licence
templates by the Dice coefficient over sets of word bigrams. Templates are notices, names, identifier lines, opening passages and
whole texts of short licences; several may stand for one licence. Compared are the whole text, each of its lines and
sentences, and for each template the windows of words, across lines, sentences and comment marks, that begin and end with a
bigram of the template. Of overlapping matches the one with most bigrams of its template stays, a line or sentence before a window.
Two sets of sizes a and b reach a coefficient t only if min(a, b) * (2 - t) >= t * max(a, b), so most
templates, and most lines, are pruned by size before a bigram is counted; a window is only opened where enough of a
template's bigrams lie within its greatest length (its number of words over that ratio), and most texts hold too few of any.

Defined cases: null, empty and one-word texts have no bigrams and no licence; equal coefficients go to the
first template by name; repeated rows are scanned alike; other columns pass through, and on a clash an added
column gets a trailing underscore. Templates without bigrams are refused.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, map_text

#: Least Dice coefficient that counts as the licence.
THRESHOLD = 0.8

# Notices, opening passages, and whole texts of short licences; names of licences.
NOTICES = {
    "Apache-2.0/notice-short": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD-3-Clause/opening": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met',
    "MPL-2.0/notice": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    "ISC/grant": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC/text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-3-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0/opening": 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.',
    "BSD-2-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "EPL-2.0/notice": 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    "MPL-2.0/opening": 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    "BSL-1.0/notice": 'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)',
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense/text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense/opening": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "CC0-1.0/notice": 'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.',
    "0BSD/grant": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.',
    "Artistic-2.0/opening": 'The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.',
}
#: Identifiers and the names by which a licence is declared.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["The Unlicense"],
    "CC0-1.0": ["CC0 1.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    **{f"CC-BY{kind}-{version}": [f"CC BY{kind} {version}", f"Creative Commons Attribution{words} {version}"] for kind, words in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives")) for version in ("2.0", "3.0", "4.0")},
}
#: Identifier, what the notice calls the work, name, version, and what joins the notice's clauses.
GNU = [
    ("GPL-2.0", "program", "GNU General Public License", "2", ";"),
    ("GPL-3.0", "program", "GNU General Public License", "3", ":"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1", ";"),
    ("LGPL-3.0", "library", "GNU Lesser General Public License", "3", ":"),
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3", ":"),
]
GNU_DATES = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
VARIANTS = {"licence": "license", "licenced": "licensed", "licences": "licenses", "v": "version"}

_WORD = re.compile(r"(?<![a-z0-9])v(?=[0-9])|[a-z0-9]+")
_BREAK = re.compile(r"\n|(?<=[.!?])\s+(?=[A-Z])")


def _templates() -> dict[str, str]:
    """NOTICES and TEXTS, and the forms that every known licence has: identifier lines, names, and the notices and openings of the GNU family."""
    made = dict(NOTICES)
    for licence, names in NAMES.items():
        made[f"{licence}/identifier"] = f"SPDX-License-Identifier: {licence}"
        for k, name in enumerate(names):
            made[f"{licence}/name{k}"] = name
            name = name if name.startswith(("CC", "The")) else f"the {name}"
            made[f"{licence}/under{k}"] = f"Licensed under {name}."
            made[f"{licence}/released{k}"] = f"Released under {name}."
    for licence, thing, family, version, joint in GNU:
        made[f"{licence}-only/identifier"] = f"SPDX-License-Identifier: {licence}-only"
        made[f"{licence}-or-later/identifier"] = f"SPDX-License-Identifier: {licence}-or-later"
        made[f"{licence}/identifier"] = f"SPDX-License-Identifier: {licence}"
        made[f"{licence}/named"] = f"licensed under the {family}, version {version}."
        made[f"{licence}/family"] = f"{family} v{version}"
        made[f"{licence}/short"] = f"{licence.partition('-')[0]} v{version}"
        made[f"{licence}/gnu-short"] = f"GNU {licence.partition('-')[0]} v{version}"
        made[f"{licence}/notice"] = f"This {thing} is free software{joint} you can redistribute it and/or modify it under the terms of the {family} as published by the Free Software Foundation{joint.replace(':', ',')} either version {version} of the License, or (at your option) any later version."
        made[f"{licence}/notice-whole"] = made[f"{licence}/notice"] + f" This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {family} for more details."
        made[f"{licence}/opening"] = f"{family} Version {version} {GNU_DATES[licence]} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    return made


def normalised(text: str) -> list[str]:
    """The words that are compared."""
    return [VARIANTS.get(w, w) for w in _WORD.findall(text.lower())]


#: Templates by licence identifier and form.
TEMPLATES = _templates()


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each of its normalised words."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    back = [i for i, c in enumerate(text) for _ in c.lower()]  # a few characters grow in lower case
    return [(back[a], back[b - 1] + 1) for a, b in spans]


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    """The set of word pairs."""
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    """Dice coefficient of two sets, 0 if both are empty."""
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    """Finds the best template for a text and its parts."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        made = sorted((len(g), name, g) for name, g in ((k, bigrams(normalised(v))) for k, v in templates.items()))
        if made and not made[0][0]:
            raise ValueError("a template needs two words")
        self.made, self.sizes = made, [m[0] for m in made]
        ratio = threshold / (2 - threshold)
        self.low, self.ratio = (self.sizes[0] * ratio if made else 0), ratio
        self.high = self.sizes[-1] / ratio if made else 0
        #: Of each bigram, the templates that have it; of each template, the bigrams that a window must share and its longest span.
        self.known: dict[tuple[str, str], list[int]] = {}
        for k, m in enumerate(made):
            for g in m[2]:
                self.known.setdefault(g, []).append(k)
        self.need = [max(1, ceil(m[0] * ratio - 1e-9)) for m in made]
        self.span = [int((len(normalised(templates[m[1]])) - 1) / ratio + 1e-9) for m in made]

    def best(self, segment: str) -> tuple[float, str] | None:
        """(coefficient, name) of the best template at or over the threshold."""
        if len(segment) < 2 * self.low:  # a bigram adds two characters at least
            return None
        words = normalised(segment)
        if not self.made or len(words) - 1 < self.low:
            return None
        grams = bigrams(words)
        n = len(grams)
        if not self.low <= n <= self.high:
            return None
        found = None
        for _, name, g in self.made[bisect_left(self.sizes, n * self.ratio - 1e-9) : bisect_right(self.sizes, n / self.ratio + 1e-9)]:
            value = 2 * len(grams & g) / (n + len(g))
            if value >= self.threshold and (found is None or (-value, name) < (-found[0], found[1])):
                found = (value, name)
        return found

    def windows(self, grams: list[tuple[str, str]], places: dict[int, list[int]]) -> list[tuple[int, int, int, float, str]]:
        """(shared bigrams, first word, last word, coefficient, name) of the best window from each start that reaches the threshold; ``places``: where each template's bigrams stand.

        A bigram counts once in a window, where the one before it lies outside. A start is passed over if its longest window holds too few
        different bigrams of the template, which a sliding count tells.
        """
        out, seen, before = [], {}, np.empty(len(grams), dtype=np.int64)
        for i, g in enumerate(grams):
            before[i] = seen.get(g, -1)
            seen[g] = i
        for k, stand in places.items():
            size, name, _ = self.made[k]
            need, span = self.need[k], self.span[k]
            at, inside = np.array(stand), np.zeros(len(grams), dtype=bool)
            inside[at] = True
            held, end = Counter(), 0
            for x, first in enumerate(stand):
                while end < len(stand) and stand[end] < first + span:
                    held[grams[stand[end]]] += 1
                    end += 1
                if len(held) >= need:
                    ends = at[x:end] - first
                    new = before[first : first + ends[-1] + 1] < first
                    shared = np.cumsum(new & inside[first : first + ends[-1] + 1])[ends]
                    values = 2 * shared / (np.cumsum(new)[ends] + size)
                    best = int(values.argmax())
                    if values[best] >= self.threshold:
                        out.append((int(shared[best]), first, int(ends[best]) + first + 1, float(values[best]), name))
                held[grams[first]] -= 1
                if not held[grams[first]]:
                    del held[grams[first]]
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, coefficient) of the parts and windows that match a template; of the whole text if none does."""
        text = text or ""
        words = normalised(text) if self.made else []
        grams = list(zip(words, words[1:]))
        # A match shares enough of its template's bigrams; most texts share too few of any.
        places: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            if g in self.known:
                for k in self.known[g]:
                    places.setdefault(k, []).append(i)
        places = {k: at for k, at in places.items() if len(at) >= self.need[k]}
        if not places:
            return []
        found, at = [], 0
        cuts = [(m.start(), m.end()) for m in _BREAK.finditer(text)]
        for start, end in [*cuts, (len(text), len(text))]:
            if at < start and (best := self.best(text[at:start])):
                shared = len(bigrams(normalised(text[at:start])) & next(m[2] for m in self.made if m[1] == best[1]))
                found.append((-shared, 0, -best[0], at, start, best[1]))
            at = end
        near = self.windows(grams, places)
        if near:
            spans = word_spans(text)
            found += [(-shared, 1, -value, spans[i][0], spans[j][1], name) for shared, i, j, value, name in near]
        out: list[tuple[int, int, str, float]] = []
        for _, _, value, start, end, name in sorted(found, key=lambda f: (*f[:4], f[5])):
            k = bisect_left(out, (start,))
            if (not k or out[k - 1][1] <= start) and (k == len(out) or out[k][0] >= end):
                out.insert(k, (start, end, name.partition("/")[0], round(-value, 6)))
        whole = self.best(text) if not out and text else None
        return [(0, len(text), whole[1].partition("/")[0], round(whole[0], 6))] if whole else out


MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType())]))


def scan_licences(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text_col: str = "text", out_col: str = "licence_matches", keep: list[str] | None = None) -> DataFrame:
    """Add ``out_col``: array of (start, end, licence, dice) in text order; code points, end exclusive."""
    templates = dict(TEMPLATES if templates is None else templates)

    def make():
        scanner = Scanner(templates, threshold)

        def work(texts):
            return [[[dict(zip(("start", "end", "licence", "dice"), m)) for m in scanner.scan(t)] for t in texts]]

        return work

    return map_text(df, text_col, {free_name(df, out_col, keep): MATCHES}, make, keep)
