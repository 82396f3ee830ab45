"""License scans by patience alignment.

A text is compared with each license text in windows half as long again as it.  Words that occur once in
the window and once in the template are anchors; the longest increasing subsequence of them is kept, and
the gaps between anchors are aligned in the same way.  ``coverage`` is the share of template words matched.

A template can only reach the threshold where the window holds enough of its different words, so others
are passed over without alignment; that loses nothing.  Defined results: null and empty texts have no
match; of several templates that share a span the one with most matched words counts, and of several
licenses the one with the largest coverage, then the longer, then the name comes first.

In a notice the words that tell licenses and versions apart (numbers, NC, SA, Lesser and so on) must all match,
and none may stand between matched words.  Notices and whole texts are both templates.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmill.llm.common import text_udf

THRESHOLD = 0.85

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"),
        "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
#: Notices of public licenses (fixed values).
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "under the Apache 2.0 license", "under the Apache License 2.0",
    ],
    "MIT": ["Released under the MIT License.", "under the MIT License"],
    "ISC": ["Released under the ISC License.", "under the ISC License"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is licensed under a Creative Commons CC0 1.0 Universal License."],
    **{
        name: [
            f"This work is licensed under the GNU {kind} Public License, version {version}.",
            f"you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by "
            f"the Free Software Foundation, either version {version} of the License",
        ]
        for name, (kind, version) in _GNU.items()
    },
    **{
        f"CC-{short}-{version}": [
            f"Licensed under CC {short} {version}.",
            f"This work is licensed under a Creative Commons {long} {version} {port} License.",
        ]
        for version, port in (("4.0", "International"), ("3.0", "Unported")) for short, long in _CC.items()
    },
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Short licenses as a whole; the texts of the long ones are files in ``license_texts``.
SHORT: dict[str, str] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. "
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
        "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
#: Words that relatives of a whole text have more often.
_STRANGE = tuple(b"affero lesser library advertising".split())
#: Words of a whole text that tell it from its relatives.
TELLING = {"MIT": "included portions", "BSD-3-Clause": "neither endorse promote"}


def _whole() -> dict[str, str]:
    """Whole texts by license."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return SHORT | {f.stem: f.read_text() for f in files}


#: Notices by license, with the short licenses as a whole.
TEMPLATES: dict[str, list[str]] = {
    name: [*NOTICES.get(name, []), f"SPDX-License-Identifier: {name}", *([SHORT[name]] if name in SHORT else [])]
    for name in sorted({*NOTICES, *SHORT})
}
#: Words that tell licenses and versions apart, besides numbers.
_CRITICAL = frozenset(
    b"mit isc apache bsd mozilla gnu affero lesser library cc0 by nc sa nd attribution noncommercial sharealike noderivatives noderivs".split()
)
_NOTICE_WORDS = 60  #: a longer template is a whole text, in which numbers may differ
_GAP = 4  #: foreign words between matched ones, of which none may tell licenses apart

_BLANK = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, ASCII letters in lower case."""
    return (text or "").encode("utf-8", "replace").lower().translate(_BLANK).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs`` (in order of the first) that increases in the second."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[pile], piles[pile] = j, k
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched positions (text, template), both increasing."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {text[i]: i for i in range(a, b) if here[text[i]] == 1}
        anchors = _increasing(sorted(
            (at[w], j) for j in range(c, d) if there[w := template[j]] == 1 and w in at
        ))
        if anchors:
            matched += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(matched)


@dataclass
class Template:
    name: str
    words: list[bytes]
    different: frozenset[bytes]
    must: frozenset[int]  # places that have to match
    notice: bool


def _tells(word: bytes) -> bool:
    return word in _CRITICAL or (word.isdigit() and len(word) < 3)


def _template(name: str, text: str) -> Template:
    words = words_of(text)
    notice = len(words) <= _NOTICE_WORDS
    telling = set(words_of(TELLING.get(name)))
    must = frozenset(i for i, w in enumerate(words) if (_tells(w) if notice else w in telling))
    return Template(name, words, frozenset(words), must, notice)


def templates(texts: dict[str, list[str]]) -> list[Template]:
    made = [_template(name, text) for name, all_texts in texts.items() for text in all_texts]
    return sorted(made, key=lambda t: (-len(t.words), t.name))


def all_templates() -> list[Template]:
    """Notices and whole texts of the licenses known here."""
    whole = _whole()
    return templates({n: list(dict.fromkeys([*TEMPLATES.get(n, []), *([whole[n]] if n in whole else [])])) for n in {*TEMPLATES, *whole}})


def _agrees(t: Template, window: list[bytes], pairs: list[tuple[int, int]]) -> bool:
    """Whether the words that tell licenses apart are the same in text and template."""
    if not t.must <= {j for _, j in pairs}:
        return False
    if not t.notice:
        span = window[pairs[0][0] : pairs[-1][0] + 1]
        return all(span.count(w) <= t.words.count(w) for w in _STRANGE)
    return not any(
        _tells(w) for (i, _), (k, _) in zip(pairs, pairs[1:], strict=False) if k - i <= _GAP + 1 for w in window[i + 1 : k]
    )


def scan(text: str | None, known: list[Template], threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, first word, last word)``, one for each license found, best first."""
    words = words_of(text)
    present = set(words)
    found: list[tuple[int, float, str, int, int]] = []
    for t in known:
        m = len(t.words)
        # Each missing different word costs at least one match.
        most_missing = m - threshold * m
        if len(t.different) - min(len(present), len(t.different)) > most_missing:
            continue
        if len(t.different) - len(t.different & present) > most_missing:
            continue
        step = max(1, m // 2)
        hits = {i // step for i, w in enumerate(words) if w in t.different}
        for k in sorted({h - x for h in hits for x in (0, 1, 2) if h >= x}):
            window = words[k * step : k * step + m + 2 * step]
            if len(t.different) - len(t.different.intersection(window)) > most_missing:
                continue
            pairs = align(window, t.words)
            coverage = len(pairs) / m
            if coverage >= threshold and _agrees(t, window, pairs):
                found.append((len(pairs), coverage, t.name, k * step + pairs[0][0], k * step + pairs[-1][0]))
    # Of templates that share a span the one with most matched words counts.
    taken: list[tuple[int, int, str]] = []
    best: dict[str, tuple] = {}
    for _, coverage, name, first, last in sorted(found, key=lambda x: (-x[0], -x[1], x[4] - x[3], x[2], x[3])):
        if any(first <= e and b <= last and name != other for b, e, other in taken):
            continue
        taken.append((first, last, name))
        if coverage > best.get(name, (0, 0.0))[1]:
            best[name] = (name, coverage, first, last)
    return sorted(best.values(), key=lambda x: (-x[1], x[2] - x[3], x[0]))


def with_licenses(docs: DataFrame, text: str = "text", into: str = "licenses", *, texts: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add an array ``into`` of the licenses found in each text with coverage and word positions."""
    known = templates(texts) if texts else all_templates()
    find = text_udf(
        lambda: lambda value: [
            dict(zip(("license", "coverage", "first_word", "last_word"), x, strict=True)) for x in scan(value, known, threshold)
        ],
        "array<struct<license:string,coverage:double,first_word:long,last_word:long>>",
    )
    return docs.withColumn(into, find(F.col(text)))


def matches(docs: DataFrame) -> DataFrame:
    """One row per document: the best license or null, its coverage and place, and how many were found."""
    found = with_licenses(docs.select("doc_id", "text"))
    best = F.get(F.col("licenses"), 0)
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        best["first_word"].alias("first_word"),
        best["last_word"].alias("last_word"),
        F.size("licenses").alias("n_licenses"),
    )
