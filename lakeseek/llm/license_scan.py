"""License scan by conditional compression.

Lines that speak of licensing, with the lines around them to a blank line or
over the length of the longest template, are candidate blocks. A block, and each
of its lines with such a word, is compressed alone and with every template as a raw
zstandard dictionary; the templates that save the largest shares are the winners. Winners are
confirmed by the words that differ: a template's words must stand in the block
in order, nearly all and nearly without others between; one of few words may
lack one that doesn't name the license. The best confirmed one is cut out, and
the rest of the block is ranked again, until no winner is confirmed. The share
of bytes saved on the lines of a find is reported.

Edge cases: a null or empty text has no block; a line that occurs in many
documents is judged once a task and reported for each; repeated rows are
reported each; of equally good templates, that of least name is taken; texts
are read whole, however long; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import Match, SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

#: Short public notices and headers, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "MIT-title": "MIT License",
    "Apache-2.0-title": "Apache License Version 2.0",
    "BSD-2-Clause-title": "BSD 2-Clause License",
    "BSD-3-Clause-title": "BSD 3-Clause License",
    "GPL-3.0-title": "GNU General Public License version 3",
    "GPL-2.0-title": "GNU General Public License version 2",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    **{f"{k}-spdx": f"SPDX-License-Identifier: {k}" for k in ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense")},
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}
#: Words that may be missing from a template of one sentence; the others name the license.
LOOSE = frozenset("this the work library software program is are a an licensed released distributed available under license".split())
CUE = r"licen[sc]|copyright|permission (?:is|to)|redistribut|rights reserved|public domain|free software|waived all|warrant|sublicen|source code|altered|spdx"
_CUE = re.compile(CUE, re.I)
_WORD = re.compile(r"[^\W_]+(?:[.\-+'][^\W_]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str, near: int = max(len(words(t)) for t in TEMPLATES.values())) -> list[tuple[int, str]]:
    """Candidate blocks with their places: lines with a cue and those around them, to a blank line or over ``near`` words a side."""
    lines = text.split("\n")
    cues = [k for k, line in enumerate(lines) if _CUE.search(line)]
    if not cues:
        return []
    at, size = [0], {}
    for line in lines:
        at.append(at[-1] + len(line) + 1)

    def reach(k: int, step: int) -> int:
        n, k = 0, k + step
        while 0 <= k < len(lines) and n < near and lines[k].strip():
            if k not in size:
                size[k] = len(words(lines[k]))
            n += size[k]
            k += step
        return k - step

    found: list[list[int]] = []
    for k in cues:
        if found and k <= found[-1][1]:
            found[-1][1] = max(found[-1][1], reach(k, 1))
            continue
        first = reach(k, -1)
        if found and first <= found[-1][1]:
            found[-1][1] = reach(k, 1)
        else:
            found.append([first, reach(k, 1)])
    return [(at[i], text[at[i] : at[j + 1] - 1]) for i, j in found]


class Scanner:
    """Compressors of all templates, and the judgement of a block."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, cover: float = 0.9, excess: float = 0.25, best: int = 4):
        import zstandard as zstd

        self.templates = {k: words(t) for k, t in templates.items()}
        self.alone = zstd.ZstdCompressor(level=3)
        self.given = {k: zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(t.encode() if len(t) >= 8 else t.encode().ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}
        self.cover, self.excess, self.best = cover, excess, best

    def rank(self, block: str) -> list[tuple[float, str]]:
        """Templates by the share of the compressed block that they save."""
        return sorted((-self.saved(block, k), k) for k in self.given)

    def saved(self, block: str, name: str) -> float:
        raw = block.encode()
        alone = len(self.alone.compress(raw))
        return (alone - len(self.given[name].compress(raw))) / alone

    def need(self, t: list[str]) -> float:
        """Words of a template that must be there; short ones may lack one."""
        return min(self.cover * len(t), len(t) - 1) if len(t) > 3 else len(t)

    def differences(self, template: str, block_words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """First word, words in the span, those missing and those added; None if the wording is another."""
        t = self.templates[template]
        m = SequenceMatcher(None, t, block_words, autojunk=False)
        core = m.find_longest_match()
        # words far from the longest run are of another text
        room = int(self.excess * len(t))
        first = max(0, core.b - core.a - room)
        m.set_seq2(block_words[first : core.b + len(t) - core.a + room])
        runs = [Match(r.a, r.b + first, r.size) for r in m.get_matching_blocks() if r.size]
        hit = sum(r.size for r in runs)
        if hit < self.need(t):
            return None
        a, b = runs[0].b, runs[-1].b + runs[-1].size
        added = [w for x, y in zip(runs, runs[1:]) for w in block_words[x.b + x.size : y.b]]
        missing, at = [], 0
        for r in runs:
            missing += t[at : r.a]
            at = r.a + r.size
        missing += t[at:]
        if len(t) - hit > (1 - self.cover) * len(t) and not LOOSE.issuperset(missing):
            return None
        return None if len(added) > self.excess * len(t) else (a, b - a, missing, added)

    def winners(self, block: str) -> list[str]:
        """Templates among the ``best`` by share saved, of the whole block or of one of its lines with a cue."""
        units = dict.fromkeys([block, *(line for line in block.split("\n") if _CUE.search(line))])
        return list(dict.fromkeys(name for u in units if u.strip() for share, name in self.rank(u)[: self.best] if share < 0))

    def scan(self, block: str) -> list[dict]:
        """Licenses of a block in order, each with the lines that hold it.

        Templates are ranked by what they save, the first are confirmed by
        wording, and the best of these is cut out; what is left is ranked again,
        until no winner is confirmed.
        """
        places = [m.span() for m in _WORD.finditer(block)]
        left = [block[a:b].lower() for a, b in places]
        text, out = block, []
        while True:
            claims = []
            for name in self.winners(text):
                if (d := self.differences(name, left)) is not None:
                    claims.append((2 * len(d[2]) + len(d[3]) - len(self.templates[name]), name, d))
            if not claims:
                return sorted(out, key=lambda o: o["word"])
            _, name, (at, n, missing, added) = min(claims)
            left[at : at + n] = [""] * n
            a, b = places[at][0], places[at + n - 1][1]
            text = text[:a] + " " * (b - a) + text[b:]
            start = block.rfind("\n", 0, a) + 1
            end = block.find("\n", b)
            lines = block[start : end if end >= 0 else len(block)]
            out.append({"license": name, "start": start, "saved": self.saved(lines, name), "word": at, "n_words": n, "missing": missing, "added": added})


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row a license found: id, ``license``, ``start`` (code point of its first line), ``saved``, ``n_words``, ``missing``, ``added``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id), F.col(text)).where(F.col(text).rlike(f"(?i){CUE}"))
    kind = docs.schema[0].dataType.simpleString()
    out = f"{doc_id} {kind}, license string, start long, saved double, n_words int, missing array<string>, added array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, memo = Scanner(templates), {}
        near = max((len(t) for t in scanner.templates.values()), default=0)
        for batch in batches:
            rows = []
            at: list[int] = []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for start, block in blocks(t or "", near):
                    found = memo.get(block)
                    if found is None:
                        found = scanner.scan(block)
                        if len(memo) < 20_000 and len(block) < 2000:
                            memo[block] = found
                    for f in found:
                        rows.append((f["license"], start + f["start"], f["saved"], f["n_words"], f["missing"], f["added"]))
                        at.append(k)
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[doc_id, "license", "start", "saved", "n_words", "missing", "added"])

    return docs.mapInArrow(run, out)
