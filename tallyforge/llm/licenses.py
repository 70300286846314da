"""License scan by conditional compression.

A candidate block is compressed with Zstandard once plainly and once with each license's wording as a raw dictionary.
The license whose wording makes the block smallest is ranked first; only wordings that share words in a row with the
block are tried, as no other can be confirmed. The winners are confirmed by their exact wording: words of block and
template are compared one by one, where a placeholder stands for a version, year or holder; a block is a match if at
most a tenth of the template's words differ.

Candidate blocks are runs of words wherever they lie in a text, over line feeds and comment marks too: three words in a
row that a template has as well (all words of a shorter template) place the template in the text, and the run of words
nearest to the template there is a candidate. Every text is looked at so. Of an SPDX expression each further identifier
is a statement of its own.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import col, small_batches

# Notices in public use, with <v> for a version, <y> for years and <h> for a holder (one or more words).
TEMPLATES = {
    "MIT": ("Released under the MIT License.",
            "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
            "The MIT License (MIT)",
            "MIT License",
            "SPDX-License-Identifier: MIT"),
    "Apache": ("Licensed under the Apache License, Version <v>.",
               "Licensed under the Apache License, Version <v> (the \"License\"); you may not use this file except in compliance with the License.",
               "Licensed under the Apache License, Version <v> (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-<v> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
               "Licensed under the Apache License <v>.",
               "Licensed under the Apache <v> License.",
               "Apache License Version <v>, January 2004",
               "SPDX-License-Identifier: Apache-<v>"),
    "GPL": ("This work is licensed under the GNU General Public License, version <v>.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <v> of the License, or (at your option) any later version.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <v> of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "Licensed under the GNU General Public License.",
            "GNU GENERAL PUBLIC LICENSE Version <v>",
            "SPDX-License-Identifier: GPL-<v>-only",
            "SPDX-License-Identifier: GPL-<v>-or-later"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version <v>.",
             "GNU LESSER GENERAL PUBLIC LICENSE Version <v>",
             "SPDX-License-Identifier: LGPL-<v>-only",
             "SPDX-License-Identifier: LGPL-<v>-or-later"),
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version <v>.",
             "GNU AFFERO GENERAL PUBLIC LICENSE Version <v>",
             "SPDX-License-Identifier: AGPL-<v>-only",
             "SPDX-License-Identifier: AGPL-<v>-or-later"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Licensed under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
            "SPDX-License-Identifier: BSD-2-Clause",
            "SPDX-License-Identifier: BSD-3-Clause"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
            "SPDX-License-Identifier: ISC"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. <v>.",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. <v>. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/<v>/.",
            "Mozilla Public License Version <v>",
            "SPDX-License-Identifier: MPL-<v>"),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License <v>",
            "Licensed under the Eclipse Public License, version <v>.",
            "Eclipse Public License - v <v>",
            "SPDX-License-Identifier: EPL-<v>"),
    "BSL": ("Distributed under the Boost Software License, Version <v>.",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
            "SPDX-License-Identifier: BSL-<v>"),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
             "SPDX-License-Identifier: Zlib"),
    "CC-BY": ("Licensed under CC BY <v>.", "This work is licensed under a Creative Commons Attribution <v> International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA <v>.", "This work is licensed under a Creative Commons Attribution-ShareAlike <v> International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC <v>.", "This work is licensed under a Creative Commons Attribution-NonCommercial <v> International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND <v>.",),
    "CC0": ("Released under CC0 <v> Universal.", "SPDX-License-Identifier: CC0-<v>"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Proprietary": ("Copyright <y> <h>. All rights reserved.", "Copyright (c) <y> <h>. All rights reserved.", "Copyright © <y> <h>. All rights reserved.", "(c) <y> <h>. All rights reserved.", "© <y> <h>. All rights reserved."),
}
_token = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W_0-9]+|<[vyh]>|©")
_version = re.compile(r"v?[0-9]+(?:\.[0-9]+)*$")
#: An SPDX tag, its expression, and the parts of that.
_spdx = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)")
_spdx_part = re.compile(r"[ \t]*(?:[()]|([A-Za-z0-9.+-]+))")
#: A line feed with the comment marks after it.
_wrap = re.compile(r"\n[\s#*/;%!>|-]*")
_year = re.compile("[0-9]{4}")


def _words(text: str) -> list[str]:
    return _token.findall(text.lower())


@lru_cache(1)
def _templates() -> list[tuple[str, str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, text, _words(text), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False)))
    return out


@lru_cache(1)
def _phrases() -> tuple[dict[tuple[str, ...], list[tuple[int, int]]], list[int]]:
    """Where three words in a row, or all of a shorter template, stand in templates (number, place), and the least of them that a match of each keeps."""
    places: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    least = []
    for k, (_, _, words, _) in enumerate(_templates()):
        n, slack = 0, len(words) // 10
        for at in range(max(1, len(words) - 2)):
            three = tuple(words[at : at + 3])
            if not any(w[0] == "<" for w in three):
                places.setdefault(three, []).append((k, at))
                n += 1
        least.append(max(1, -(-(n - 3 * slack) // (slack + 1))))
    return places, least


@lru_cache(1)
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False)


def differences(block: list[str], template: list[str]) -> int:
    """Words to change, add or leave out to make the block the template; placeholders take what they stand for."""
    shown, k = [], 0
    for w in template:
        if w == "<v>" and k < len(block) and _version.match(block[k]):
            shown.append(block[k])
        elif w == "<y>" and k < len(block) and re.fullmatch("[0-9]{4}", block[k]):
            shown.append(block[k])
            while k + 1 < len(block) and re.fullmatch("[0-9]{4}", block[k + 1]):
                k += 1
                shown.append(block[k])
        elif w == "<h>":
            after = template[template.index(w) + 1] if template.index(w) + 1 < len(template) else None
            while k < len(block) and block[k] != after:
                shown.append(block[k])
                k += 1
            continue
        else:
            shown.append(w)
        k += 1
    if shown == block:
        return 0
    least = abs(len(shown) - len(block))
    if 10 * least > len(template):  # no match whatever the words are
        return least
    same = difflib.SequenceMatcher(None, block, shown, autojunk=False)
    return sum(max(b - a, d - c) for tag, a, b, c, d in same.get_opcodes() if tag != "equal")


def _hits(words: list[str]) -> list[tuple[int, tuple[str, ...]]]:
    """Where words in a row stand that a template has as well."""
    places = _phrases()[0]
    out = []
    for n in {len(p) for p in places}:
        rows = list(zip(*(words[k:] for k in range(n))))
        out += [(at, rows[at]) for at in compress(range(len(rows)), map(places.__contains__, rows))]
    return out


@lru_cache(4096)
def match(block: str) -> tuple[tuple[str, int, int, int], ...]:
    """Licenses that a block states, best first: name, bytes saved, plain bytes, differing words."""
    raw = _wrap.sub(" ", block).encode(errors="replace")
    plain, words, places = len(_plain().compress(raw)), _words(block), _phrases()[0]
    tried = [_templates()[k] for k in sorted({k for _, phrase in _hits(words) for k, _ in places[phrase]})]
    ranks = sorted(((plain - len(c.compress(raw)), name, template) for name, _, template, c in tried), key=lambda x: (-x[0], x[1]))
    out: list[tuple[str, int, int, int]] = []
    for saved, name, template in ranks:
        if saved <= 0 or out and saved < out[0][1]:
            break
        n = differences(words, template)
        if 10 * n <= len(template) and (not out or n < out[0][3]):
            out.insert(0, (name, saved, plain, n))
    return tuple(out[:1])


def nearest(words: list[str], template: list[str]) -> tuple[int, int]:
    """The run of words that takes the fewest changes to become the template."""
    cost, begin = [0] * (len(words) + 1), list(range(len(words) + 1))
    for w in template:
        last, came, cost, begin = cost, begin, [cost[0] + 1], [begin[0]]
        for k, x in enumerate(words):
            same = x == w or w == "<v>" and _version.match(x) is not None
            cost_, begin_ = min((last[k] + (not same), -came[k]), (last[k + 1] + 1, -came[k + 1]), (cost[k] + 1, -begin[k]))
            cost.append(cost_)
            begin.append(-begin_)
    end = min(range(len(cost)), key=cost.__getitem__)
    return begin[end], end


def runs(text: str, lower: str) -> set[tuple[int, int]]:
    """Candidate blocks that are runs of words of about a template's length; a copyright notice reaches back to its year."""
    words = _token.findall(lower)
    hits = _hits(words)
    if not hits:
        return set()
    found = list(_token.finditer(lower))
    (places, least), templates = _phrases(), _templates()
    longest = max(len(t) for _, _, t, _ in templates)
    votes: Counter[tuple[int, int]] = Counter()
    out: set[tuple[int, int, int]] = set()
    for at, phrase in hits:
        for k, place in places[phrase]:
            template = templates[k][2]
            if "<h>" not in template:
                votes[k, at - place] += 1
                continue
            head = template[: template.index("<y>")]
            for start in range(at - 1, max(-1, at + 3 - longest), -1):
                if words[start : start + len(head)] == head and start + len(head) < at and _year.fullmatch(words[start + len(head)]):
                    if not re.search(r"\n\s*\n", text[found[start].start() : found[at].start()]):
                        out.add((start, at + 3, k))
                    break
    for (k, start), n in votes.items():
        template = templates[k][2]
        slack = len(template) // 10
        if n < least[k] or any(votes.get((k, start + d), 0) > n for d in range(-slack, slack + 1)):
            continue
        low, begin, end = max(0, start), 0, len(template)
        part = words[low : low + end]
        if differences(part, template):
            low = max(0, start - slack)
            part = words[low : start + len(template) + slack]
            begin, end = nearest(part, template)
        if begin < end and 10 * differences(part[begin:end], template) <= len(template):
            out.add((low + begin, low + end, k))
    spans = set()
    for begin, end, k in out:
        stop, tail = found[end - 1].end(), re.search(r"[^\w>]*$", templates[k][1])[0]
        while tail and text.startswith(tail[0], stop):
            stop, tail = stop + 1, tail[1:]
        lead = re.match(r"[^\w<©]*", templates[k][1])[0]
        start = found[begin].start()
        spans.add((start - len(lead) if lead and text.endswith(lead, 0, start) else start, stop))
    return spans


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks of a text."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer: look at it letter by letter
        lower = "".join(c.lower()[0] for c in text)
    return sorted(runs(text, lower))


def expressions(text: str) -> list[tuple[int, int, str]]:
    """Identifiers after the first in SPDX expressions: start, end, and the statement that each stands for."""
    out = []
    for tag in _spdx.finditer(text):
        at, last, joined = tag.start(1), None, True
        while m := _spdx_part.match(text, at, tag.end(1)):
            at = m.end()
            if m[1] is None:
                continue
            if m[1].upper() in ("OR", "AND", "WITH"):
                last, joined = m[1].upper(), True
                continue
            if not joined:  # no part of the expression
                break
            if last in ("OR", "AND"):
                out.append((m.start(1), m.end(1), f"SPDX-License-Identifier: {m[1]}"))
            joined = False
    return out


def scan_text(text: str) -> list[tuple[int, int, str, int, int, int]]:
    """Matches that do not overlap, by start: start, end, license, bytes saved, plain bytes, differing words."""
    found = []
    for start, end in blocks(text):
        found += [(start, end, *m) for m in match(text[start:end])]
    found.sort(key=lambda x: (x[5], x[0] - x[1], x[0]))
    found += [(start, end, *m) for start, end, said in expressions(text) for m in match(said)]
    kept: list[tuple] = []  # by start
    for x in found:
        k = bisect.bisect_left(kept, x[1], key=lambda y: y[0])
        if k == 0 or kept[k - 1][1] <= x[0]:
            kept.insert(k, x)
    return kept


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each license statement: doc_id, start, end (code points), license, saved, plain, differing.

    Defined results: null, empty and clean texts give no rows; repeated rows give repeated rows; of templates that
    save as many bytes the one with fewer differing words, then the first by name, wins; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "license", "saved", "plain", "differing"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in scan_text(t)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start int, end int, license string, saved int, plain int, differing int")
