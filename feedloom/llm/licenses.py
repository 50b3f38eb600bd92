"""Licence scan: passages compared with licence templates by Dice coefficient over word bigrams.

A passage is any run of words in a row, lower-cased, without punctuation; it may begin and
end inside a line or a sentence.  With A and B the bigram multisets of passage and
template, Dice is ``2 |A & B| / (|A| + |B|)``.  (``scan`` is the search over runs of
whole segments alone, lines and sentences; the query does not use it.)

Pruning, none of which loses a match:

* size bounds: Dice of at least t needs ``|A|`` between ``t / (2 - t)`` and
  ``(2 - t) / t`` times ``|B|``, so a passage meets only templates of about its size;
* an inverted index of template bigrams: the best passage starts and ends with one
  (cutting another off would raise Dice) or with a mark;
* counting: a start with too few positions of the template's bigrams within the largest
  size cannot reach t; from others a window grows with running counts.

A passage takes a template's name only if both have the same marks: version numbers and
the words that tell a family's licences apart (Lesser, ShareAlike, or later).

Of overlapping matches the one with the highest Dice stays (ties: the larger
template, then the earlier, then the shorter passage, then the licence's name).

Each document is scanned alone, in the task that reads it; templates are a fixed list.
Defined results: null and empty texts have no matches, and a document without a match
has no row.  Repeated rows have repeated matches; null doc_ids stay null.  Empty
tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices and short licences, by SPDX name (several may share one).
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]


def _families() -> list[tuple[str, str]]:
    """Notices of every Creative Commons licence and of the GNU licences, by version."""
    out = []
    for version, kind in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic")):
        for short, long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
            name = f"CC-{short}-{version}"
            out.append((name, f"Licensed under CC {short} {version}."))
            out.append((name, f"This work is licensed under a Creative Commons Attribution{long} {version} {kind} License."))
    for short, long, versions in (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("LGPL", "Library General", ("2",)), ("AGPL", "Affero General", ("3",))):
        for version in versions:
            name = f"{short}-{version if '.' in version else version + '.0'}"
            out.append((name, f"This work is licensed under the GNU {long} Public License, version {version}."))
            out.append((f"{name}-or-later", f"This work is licensed under the GNU {long} Public License, version {version} or later."))
            for thing in ("program", "library"):
                for end, term in (("", f"version {version} of the License."), ("-or-later", f"either version {version} of the License, or (at your option) any later version.")):
                    out.append((
                        name + end,
                        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {long} Public License as published by the "
                        f"Free Software Foundation, {term} This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {long} Public License for more details.",
                    ))
    clauses = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
    )
    third = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    return [*out, ("BSD-2-Clause", clauses), ("BSD-3-Clause", clauses + third)]


TEMPLATES += [x for x in _families() if x not in TEMPLATES]

#: Words that tell licences of one family apart.
_MARKS = {"lesser", "affero", "sharealike", "noderivatives", "noderivs", "noncommercial", "sa", "nd", "nc", "later", "endorse", "advertising"}
#: Words that a number behind them makes a version.
_BEFORE_VERSION = {"version", "v", "license", "licence", "by", "nc", "sa", "nd", "attribution", "sharealike", "noderivatives", "noncommercial", "gpl", "lgpl", "agpl", "bsd"}
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)?\Z")
_LATER = re.compile(r"(of the licen[sc]e )?or (at your option )?(any )?(later|newer)\b|of the licen[sc]e or at your option")

_SEGMENT = re.compile(r"[^\n]+?(?:[.!?;:](?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_OUT = "doc_id string, license string, dice double, start int, end int, template_bigrams int"


def words(text: str) -> list[str]:
    """Normalised words: lower case, no punctuation, version numbers whole."""
    return _WORD.findall(text.lower())


def mark(before: str, word: str) -> str | None:
    """What a word says about which licence of a family is meant: a version or a distinguishing word."""
    if word in _MARKS or (word == "library" and before == "gnu"):
        return word
    found = _VERSION.match(word) if before in _BEFORE_VERSION else None
    return found[1] if found else None


def marks(w: list[str]) -> dict[int, str]:
    """Place and value of the marks among words."""
    return {k: m for k, (a, b) in enumerate(zip(["", *w], w)) if (m := mark(a, b))}


def agrees(template: Template, w: list[str], told: dict[int, str], i: int, j: int) -> bool:
    """Whether words i to j, with "or later" behind the last mark, carry the marks of the template and no others."""
    own = [k for k in told if i <= k <= j]
    if {told[k] for k in own} != template.marks:
        return False
    return not own or "later" in template.marks or not _LATER.match(" ".join(w[own[-1] + 1 : own[-1] + 10]))


@dataclass
class Template:
    """A licence notice and its bigram counts."""

    name: str
    bigrams: Counter
    size: int
    marks: set


def prepare(templates: list[tuple[str, str]]) -> tuple[list[Template], dict[tuple, list[int]]]:
    """Templates with at least one bigram, and for each bigram the templates that hold it."""
    out, index = [], {}
    for name, text in templates:
        w = words(text)
        bigrams = Counter(zip(w, w[1:]))
        if bigrams:
            for b in bigrams:
                index.setdefault(b, []).append(len(out))
            out.append(Template(name, bigrams, len(w) - 1, set(marks(w).values())))
    return out, index


def size_bounds(size: int, threshold: float) -> tuple[float, float]:
    """Bigram counts between which a passage can reach the threshold with a template of ``size``."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def scan(text: str, templates: list[Template], index: dict[tuple, list[int]], threshold: float) -> list[tuple]:
    """(licence, dice, start, end, template size) of the chosen matches, by position."""
    spans, held, hits = [], [], []
    for m in _SEGMENT.finditer(text):
        w = words(m[0])
        if w:
            spans.append(m.span())
            held.append(w)
    # bigrams of each segment, the one that leads into it from the segment before apart
    inner = [list(zip(w, w[1:])) for w in held]
    into = [None, *((a[-1], b[0]) for a, b in zip(held, held[1:]))]
    starts: dict[int, list[int]] = {}
    for i, (link, own) in enumerate(zip([*into[1:], None], inner)):
        for t in {t for b in (*own, link) if b in index for t in index[b]}:
            starts.setdefault(t, []).append(i)
    for t, places in starts.items():
        template = templates[t]
        low, high = size_bounds(template.size, threshold)
        for i in places:
            size, seen, passage = 0, 0, []
            for j in range(i, len(held)):
                more = inner[j] if j == i else [into[j], *inner[j]]
                size += len(more)
                if size > high + 1e-9:
                    break
                passage += more
                seen += sum(b in template.bigrams for b in more)
                if size < low - 1e-9 or 2 * seen < threshold * (size + template.size) - 1e-9:
                    continue
                counts = Counter(passage)
                dice = 2 * sum(min(c, counts[b]) for b, c in template.bigrams.items() if b in counts) / (size + template.size)
                if dice >= threshold:
                    hits.append((dice, t, i, j))
    return choose(hits, templates, spans)


def choose(hits: list[tuple], templates: list[Template], spans: list[tuple]) -> list[tuple]:
    """Non-overlapping matches, best first; sorted by position at the end."""
    taken, out = set(), []
    for dice, t, i, j in sorted(hits, key=lambda h: (-h[0], -templates[h[1]].size, h[2], h[3], templates[h[1]].name)):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((templates[t].name, dice, spans[i][0], spans[j][1], templates[t].size))
    return sorted(out, key=lambda m: m[2])


def find_passages(text: str, templates: list[Template], index: dict[tuple, list[int]], threshold: float) -> list[tuple]:
    """(licence, dice, start, end, template size) of the chosen matches among all runs of words, by position."""
    folded = text.lower()
    if len(folded) != len(text):  # a letter that grows when lowered would move the positions
        folded = "".join(low if len(low := c.lower()) == 1 else c for c in text)
    w = _WORD.findall(folded)
    places: dict[int, list[int]] = {}
    for k, b in enumerate(zip(w, w[1:])):
        for t in index.get(b, ()):
            places.setdefault(t, []).append(k)
    hits, told = [], None
    for t, at in places.items():
        template = templates[t]
        low, high = size_bounds(template.size, threshold)
        need = max(1, math.ceil(low - 1e-9))  # so many bigrams of the template among ``high``
        if not any(at[x + need - 1] < at[x] + high + 1e-9 for x in range(len(at) - need + 1)):
            continue
        told = marks(w) if told is None else told
        # a mark may also stand at the edge of a passage without a bigram of the template
        points = sorted({*at, *(k for k in told if k < len(w) - 1), *(k - 1 for k in told if k)})
        for a, start in enumerate(points):
            if bisect_left(at, start + high + 1e-9) - bisect_left(at, start) < need:
                continue
            counts, shared = Counter(), 0
            for k in points[a:]:
                size = k - start + 1
                if size > high + 1e-9:
                    break
                pair = (w[k], w[k + 1])
                counts[pair] += 1
                shared += counts[pair] <= template.bigrams[pair]
                dice = 2 * shared / (size + template.size)
                if dice >= threshold and agrees(template, w, told, start, k + 1):
                    hits.append((dice, t, start, k + 1))
    if not hits:
        return []
    spans = [m.span() for m in _WORD.finditer(folded)]
    taken, out = bytearray(len(w)), []
    for dice, t, i, j in sorted(hits, key=lambda h: (-h[0], -templates[h[1]].size, h[2], h[3], templates[h[1]].name)):
        if taken.find(1, i, j + 1) < 0:
            taken[i : j + 1] = b"\1" * (j + 1 - i)
            out.append((templates[t].name, dice, spans[i][0], spans[j][1], templates[t].size))
    return sorted(out, key=lambda m: m[2])


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, start, end, template_bigrams) of every match; start and end are code points."""
    prepared, index = prepare(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc_id, *match) for doc_id, text in zip(batch["id"], batch["text"]) if text for match in find_passages(text, prepared, index, threshold)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "dice", "start", "end", "template_bigrams"])

    found = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, _OUT)
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op3_licenses(documents: DataFrame) -> DataFrame:
    """Every licence passage of every whole text."""
    return license_scan(documents)
