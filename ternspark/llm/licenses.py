"""Operator 9: license notices by patience alignment with templates."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the "
    "warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or "
    "copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or "
    "otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization."
)
_BSD_DISCLAIMER = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, "
    "including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, "
    "special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or "
    "services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, "
    "whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use "
    "of this software, even if advised of the possibility of such damage."
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License."
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License "
    "as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. The software is provided "
    "\"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential "
    "damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, "
    "negligence or other tortious action, arising out of or in connection with the use or performance of this software."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
    "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
    "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
    "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
    "works are solely in the form of machine-executable object code generated by a source language processor. The software is "
    "provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
    "merchantability, fitness for a particular purpose, title and non-infringement. In no event shall the copyright holders or "
    "anyone distributing the software be liable for any damages or other liability, whether in contract, tort or otherwise, "
    "arising from, out of or in connection with the software or the use or other dealings in the software."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
    "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
    "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
    "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. The "
    "software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the "
    "warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors be "
    "liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out "
    "of or in connection with the software or the use or other dealings in the software."
)
_CC = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
_GNU = {
    "GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3"),
}

#: Public license notices. Fixed values. The clauses without their disclaimer count as notices of their own.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    **{f"CC-{x}-4.0": f"Licensed under CC {x} 4.0." for x in _CC},
    **{name: f"This work is licensed under the GNU {kind} Public License, version {v}." for name, (kind, v) in _GNU.items()},
    "Apache-2.0-header": _APACHE_HEADER,
    **{f"{name}-header": _GNU_HEADER.format(kind=kind, v=v) for name, (kind, v) in _GNU.items()},
    "MPL-2.0-header": _MPL_HEADER,
    "ISC": _ISC,
    "Zlib": _ZLIB,
    "BSL-1.0": _BOOST,
    "Unlicense": _UNLICENSE,
    "MIT-grant": _MIT_GRANT,
    "MIT-text": f"{_MIT_GRANT} {_MIT_DISCLAIMER}",
    "BSD-2-Clause-conditions": _BSD_TWO,
    "BSD-2-Clause": f"{_BSD_TWO} {_BSD_DISCLAIMER}",
    "BSD-3-Clause-conditions": f"{_BSD_TWO} 3. {_BSD_NAMES}",
    "BSD-3-Clause": f"{_BSD_TWO} 3. {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "BSD-4-Clause": f"{_BSD_TWO} {_BSD_ADVERTISING} 4. {_BSD_NAMES} {_BSD_DISCLAIMER}",
}
_MIT_PHRASES = ["permission is hereby granted|to any person obtaining|to deal in the software|permit persons to whom", "above copyright notice and this permission|this permission notice shall"]
_BSD_PHRASES = ["redistribution and use in|redistributions of source code|redistributions in binary form", "binary form must"]
#: What tells a template from its relatives: of each entry ("a|b"), a phrase must stand in the notice word for
#: word. The phrases of the first entry occur once in the template; a notice is looked for at each of them.
REQUIRED = {
    "Apache-2.0": ["apache", "version 2|license 2"],
    "MIT": ["mit"],
    "BSD": ["bsd"],
    "BSD-2-Clause-notice": ["2-clause"],
    "BSD-3-Clause-notice": ["3-clause"],
    **{f"CC-{x}-4.0": [x.lower(), f"{x.lower()} 4"] for x in _CC},
    **{name: [f"gnu {kind.lower()} public license", f"version {v}|license {v}"] for name, (kind, v) in _GNU.items()},
    "Apache-2.0-header": ["you may not use this file|unless required by applicable law", "apache license"],
    **{f"{name}-header": ["redistribute it and/or modify it|in the hope that it will be useful", f"gnu {kind.lower()} public license", f"version {v}"] for name, (kind, v) in _GNU.items()},
    "MPL-2.0-header": ["mozilla public license", "v 2|version 2|license 2"],
    "ISC": ["purpose with or without fee|permission notice appear in all copies"],
    "Zlib": ["origin of this software must not|altered source versions must be|this notice may not be removed"],
    "BSL-1.0": ["person or organization obtaining|reproduce display distribute execute|machine-executable object code"],
    "Unlicense": ["free and unencumbered software|jurisdictions that recognize copyright|overt act of relinquishment"],
    "MIT-grant": _MIT_PHRASES,
    "MIT-text": _MIT_PHRASES,
    "BSD-2-Clause-conditions": _BSD_PHRASES,
    "BSD-2-Clause": _BSD_PHRASES,
    "BSD-3-Clause-conditions": [*_BSD_PHRASES, "endorse or promote|promote products"],
    "BSD-3-Clause": [*_BSD_PHRASES, "endorse or promote|promote products"],
    "BSD-4-Clause": [*_BSD_PHRASES, "all advertising materials|advertising materials mentioning"],
}
#: Share of a template's words that must be aligned, and how far apart neighbours may stand in the text.
COVERAGE, GAP = 0.8, 50
_DIGITS, _VERSION = "0123456789", re.compile(r"^v?([0-9]+(?:\.[1-9][0-9]*)?)(?:\.0)?$")
_STRIP = ".,;:!?\"'()[]{}*#%&$"


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends; v3 and 3.0 are 3."""
    return [_VERSION.sub(r"\1", w) if w[-1] in _DIGITS else w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of aligned words, ascending in both.

    Anchors are words that occur once in both; the longest increasing subsequence of their places stays, and
    the gaps between anchors are aligned the same way. A gap without such words aligns equal beginnings and
    ends only.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_template = Counter(template[b0:b1])
        place = {w: b0 + k for k, w in enumerate(template[b0:b1]) if in_template[w] == 1}
        seen: dict[str, int] = {}
        for k in range(a0, a1):
            if text[k] in place:
                seen[text[k]] = -1 if text[k] in seen else k
        anchors = _increasing([(k, place[w]) for w, k in seen.items() if k >= 0])
        if not anchors:
            continue
        out += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that ascends in both places (pairs ascend in the first already)."""
    pairs = sorted(pairs)
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        j = bisect.bisect_left(tails, y)
        back[k] = at[j - 1] if j else -1
        if j == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[j], at[j] = y, k
    k, out = at[-1] if at else -1, []
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _windows(text: list[str], template: list[str], vocabulary: set[str], least: int) -> list[tuple[int, int]]:
    """Stretches of the text that hold words of the template at most `GAP` apart, enough of them for a match."""
    places = [k for k, w in enumerate(text) if w in vocabulary]
    out: list[tuple[int, int]] = []
    start = 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] - places[k - 1] > GAP:
            if k - start >= least:
                out.append((places[start], places[k - 1] + 1))
            start = k
    return out


def _places(words: list[str], phrase: list[str]) -> list[int]:
    return [k for k in range(len(words) - len(phrase) + 1) if words[k] == phrase[0] and words[k : k + len(phrase)] == phrase]


class Scanner:
    """Finds notices in one text; holds the templates' words and what is required of their notices."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, required: dict[str, list[str]] = REQUIRED):
        self.templates = {name: words_of(t) for name, t in sorted(templates.items())}
        self.counts = {name: Counter(w) for name, w in self.templates.items()}
        self.coverage = coverage
        self.vocabulary = {w for t in self.templates.values() for w in t}
        self.required: dict[str, list[list[list[str]]]] = {}
        self.keys: dict[str, list[tuple[list[str], int]]] = {}
        for name, template in self.templates.items():
            phrases = required.get(name, []) if templates.get(name) == TEMPLATES.get(name) else []
            self.required[name] = [[x.split() for x in entry.split("|")] for entry in phrases]
            keys = self.required[name][0] if phrases else [[w] for w, n in self.counts[name].items() if n == 1]
            self.keys[name] = [(key, places[0]) for key in keys if len(places := _places(template, key)) == 1]

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word + 1) of every notice, in the order of their places.

        A template is aligned around each place of each of its phrases, up to the next place of the same
        phrase, so that every copy is aligned alone. Templates without required phrases are looked for at each
        of their single words, and also where their words stand closest. Of notices that align the same
        phrase, the one with most words aligned stays.
        """
        words = words_of(text)
        if not self.vocabulary.intersection(words):
            return []
        at: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.vocabulary:
                at.setdefault(w, []).append(k)
        own = Counter({w: len(x) for w, x in at.items()})
        found = []  # (aligned words, license, coverage, aligned places, place of the phrase)
        for name, template in self.templates.items():
            if not all(any(all(w in at for w in phrase) for phrase in entry) for entry in self.required[name]):
                continue
            least = max(1, -int(-self.coverage * len(template) // 1))
            if not template or sum(min(n, own[w]) for w, n in self.counts[name].items()) < least:
                continue
            for key, y in self.keys[name]:
                places = [k for k in at.get(key[0], []) if words[k : k + len(key)] == key]
                for k, x in enumerate(places):
                    before = places[k - 1] + len(key) if k else 0
                    after = places[k + 1] if k + 1 < len(places) else len(words)
                    for low, high in [(before, after), (0, len(words))][: 1 + (len(places) > 1)]:
                        pairs = self._around(words, template, x, y, len(key), low, high)
                        if len(pairs) >= least and self._tells(words[pairs[0] : pairs[-1] + 1], name):
                            found.append((len(pairs), name, len(pairs) / len(template), pairs, x))
                            break
            if not self.required[name]:
                for a, b in _windows(words, template, set(template), least):
                    for start, end in self._spots(words, a, b, name, least):
                        pairs = [start + x for x, _ in patience(words[start:end], template)]
                        if len(pairs) >= least:
                            found.append((len(pairs), name, len(pairs) / len(template), pairs, pairs[0]))
        found.sort(key=lambda f: (-f[0], -f[2], f[3][-1] - f[3][0], f[1], f[4]))
        taken: set[int] = set()
        kept = []
        for _, name, share, pairs, x in found:
            if x not in taken:
                taken.update(pairs)
                kept.append((name, share, pairs[0], pairs[-1] + 1))
        return sorted(kept, key=lambda f: (f[2], f[3], f[0]))

    @staticmethod
    def _around(words: list[str], template: list[str], x: int, y: int, size: int, low: int, high: int) -> list[int]:
        """Places of the words aligned with the template, given that ``size`` words at x are those at y of it."""
        n = len(template)
        a, b = max(low, x - y - n - 8), min(high, x + n - y + n + 8)
        left = patience(words[a:x], template[:y])
        right = patience(words[x + size : b], template[y + size :])
        return [a + k for k, _ in left] + list(range(x, x + size)) + [x + size + k for k, _ in right]

    def _tells(self, words: list[str], name: str) -> bool:
        return all(any(_places(words, phrase) for phrase in entry) for entry in self.required[name])

    def _spots(self, words: list[str], a: int, b: int, name: str, least: int) -> Iterator[tuple[int, int]]:
        """Windows of twice the template's length around each place where its rarest words begin a match."""
        n, want = len(self.templates[name]), self.counts[name]
        width = 2 * n + 8
        if b - a <= width:
            yield a, b
            return
        have: Counter = Counter()
        score, done = 0, a - 1
        for k in range(a, b):
            w = words[k]
            if w in want:
                have[w] += 1
                score += have[w] <= want[w]
            if k - width >= a and (old := words[k - width]) in want:
                score -= have[old] <= want[old]
                have[old] -= 1
            if score >= least and k > done:
                yield max(a, k - width + 1), min(b, k + n)
                done = k + n // 2


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """``docs`` (without its text) with ``license``, ``coverage``, ``first_word``, ``last_word``, ``n_licenses`` and ``notices``.

    ``notices`` holds every notice of the text in the order of their places, copies included: license,
    coverage, first word, last word + 1. The other columns state the one with most coverage, among equals the
    alphabetically first, then the first, and the number of different licenses. Coverage is the share of the
    template's words aligned. Around a phrase, a template of n words is aligned with the words up to n + 8 beyond where
    the phrase puts its ends, so up to about as many words as the template has may be inserted. Texts without a notice,
    empty and null ones have null, 0 and an empty array. Columns of those names are replaced; bytes that aren't UTF-8 are
    words of their own. Rows are independent: no shuffle.
    """
    names = ["license", "coverage", "first_word", "last_word", "n_licenses", "notices"]
    columns = [c for c in docs.columns if c not in (text, *names)]
    rows = docs.select(*columns, F.col(text).cast("binary").alias("__text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            got = [scanner.find(x.decode("utf-8", "replace")) if x else [] for x in batch.column(len(columns)).to_pylist()]
            top = [min(g, key=lambda x: (-x[1], x[0], x[2])) if g else (None, 0.0, None, None) for g in got]
            every = [[dict(zip(("license", "coverage", "first_word", "last_word"), x, strict=True)) for x in g] for g in got]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array([x[0] for x in top], type=pa.string()), pa.array([float(x[1]) for x in top]),
                 pa.array([x[2] for x in top], type=pa.int64()), pa.array([x[3] for x in top], type=pa.int64()),
                 pa.array([len({x[0] for x in g}) for g in got], type=pa.int64()), pa.array(every, type=kind)],
                names=[*columns, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, (schema + ", " if schema else "") + "license string, coverage double, first_word long, last_word long, n_licenses long, "
                           "notices array<struct<license: string, coverage: double, first_word: long, last_word: long>>")
