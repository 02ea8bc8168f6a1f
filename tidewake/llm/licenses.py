"""Licence scan: passages against licence templates by the Dice coefficient over word bigrams.

A passage is a line, a sentence of a line, or a span of consecutive paragraphs (between blank lines) that isn't
much longer than the longest template: of its words divided by t / (2 - t) at most. It is normalised to lower-case words of ASCII letters and digits. With s = |A & B| for the sets of bigrams A and
B the coefficient is 2 s / (|A| + |B|), so a template reaches t only if its size lies between
t / (2 - t) and (2 - t) / t of the passage's; templates are ordered by size and no other is looked at. For
the same reason a span holds a template only if s is t / (2 - t) |A| at least: a span whose
paragraphs have too few bigrams of any template for its largest paragraph is left without being put together.

A window is a stretch of the text's words, whatever lines and paragraphs end inside, as long as a template and placed where
the template would begin by at least half of t / (2 - t) of its bigrams: so notices that stand in the middle of a line, or between other lines, are
found. Windows are counted apart from passages.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import small_batches, texts_of

#: Names of licences as notices write them.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "MIT": ["the MIT License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["the Unlicense"],
}
NOTICES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This file is distributed under the terms of {}.")
#: Short licence texts, as their authors publish them.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "LGPL-2.1": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}

WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c == 10 else 32 for c in range(256))
SENTENCE = re.compile(rb"(?<=[.!?;]) ")


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every notice and short text."""
    return [(k, notice.format(name)) for k, names in NAMES.items() for name in names for notice in NOTICES] + list(TEXTS.items())


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


class Scanner:
    """Finds the templates whose coefficient with a passage is ``threshold`` or more."""

    def __init__(self, known: list[tuple[str, str]], threshold: float):
        self.threshold, self.share = threshold, threshold / (2 - threshold)
        self.grams = sorted(((k, bigrams(t.encode().translate(WORDS).split())) for k, t in known), key=lambda x: len(x[1]))
        self.sizes = [len(g) for _, g in self.grams]
        self.by_gram: dict[tuple[bytes, bytes], list[int]] = {}  # templates from small to large
        for i, (_, g) in enumerate(self.grams):
            for x in g:
                self.by_gram.setdefault(x, []).append(i)
        self.least, self.most = min(self.sizes, default=0) * self.share, max(self.sizes, default=0) / self.share
        self.firsts = {x for x, _ in self.by_gram}
        self.words = int(max((len(t.encode().translate(WORDS).split()) for _, t in known), default=0) / self.share)
        self.placed: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}  # where templates have a bigram
        self.long: list[tuple[str, int, set]] = []
        for name, text in known:
            words = text.encode().translate(WORDS).split()
            for k, g in enumerate(zip(words, words[1:])):
                self.placed.setdefault(g, []).append((len(self.long), k))
            self.long.append((name, len(words), bigrams(words)))

    def passage(self, words: list[bytes]) -> dict[str, float]:
        """Best coefficient of each licence that reaches the threshold."""
        # a passage of n words has n - 1 bigrams at most, and may have far fewer
        if len(words) - 1 < self.least or self.firsts.isdisjoint(words):
            return {}
        mine = bigrams(words)
        low, high = bisect_left(self.sizes, self.share * len(mine) - 1e-9), bisect_right(self.sizes, len(mine) / self.share + 1e-9)
        shared = mine & self.by_gram.keys()
        if low >= high or len(shared) < self.share * len(mine) - 1e-9:
            return {}
        common: dict[int, int] = {}
        for x in shared:
            held = self.by_gram[x]
            for i in held[bisect_left(held, low) : bisect_left(held, high)]:
                common[i] = common.get(i, 0) + 1
        out: dict[str, float] = {}
        for i, s in common.items():
            dice = 2 * s / (len(mine) + self.sizes[i])
            if dice >= self.threshold:
                out[self.grams[i][0]] = max(out.get(self.grams[i][0], 0.0), dice)
        return out

    def spans(self, blocks: list[list[bytes]], lone: set[int]) -> Iterator[list[bytes]]:
        """The words of each run of consecutive paragraphs that can hold a template; paragraphs ``lone`` aren't runs by themselves."""
        held = []
        for words in blocks:
            mine = bigrams(words)
            held.append((len(mine), len(mine & self.by_gram.keys())))
        for i in range(len(blocks)):
            largest = shared = n = 0
            for j in range(i, len(blocks)):
                size, known = held[j]
                largest, shared, n = max(largest, size), shared + known + (j > i), n + len(blocks[j])
                if largest > self.most or n > self.words:
                    break
                if shared >= self.share * largest - 1e-9 and shared >= self.least * self.share - 1e-9 and (j > i or i not in lone):
                    yield [w for words in blocks[i : j + 1] for w in words]

    def windows(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """Per licence the best coefficient of a window and the number of places of windows that reach the threshold."""
        votes: dict[tuple[int, int], int] = {}
        placed = self.placed
        for i, g in enumerate(zip(words, words[1:])):
            if g in placed:
                for t, k in placed[g]:
                    votes[t, i - k] = votes.get((t, i - k), 0) + 1
        best: dict[str, float] = {}
        at: dict[str, set[int]] = {}
        for (t, start), n in votes.items():
            name, size, grams = self.long[t]
            if 2 * n < self.share * (size - 1) - 1e-9:
                continue
            mine = bigrams(words[max(0, start) : start + size])
            dice = 2 * len(mine & grams) / (len(mine) + len(grams))
            if dice >= self.threshold:
                best[name] = max(best.get(name, 0.0), dice)
                at.setdefault(name, set()).add(start)
        return {name: (best[name], len(at[name])) for name in best}

    def text(self, text: bytes) -> dict[str, tuple[float, int, int]]:
        """Per licence the best coefficient over all passages and windows, and the numbers of either that reach the threshold."""
        out: dict[str, tuple[float, int]] = {}
        blocks: list[list[list[bytes]]] = [[]]
        passages = []
        for line in text.split(b"\n"):
            if words := line.translate(WORDS).split():
                blocks[-1].append(words)
                passages.append(words)
                if len(parts := SENTENCE.split(line)) > 1:
                    passages += [w for p in parts if (w := p.translate(WORDS).split())]
            elif blocks[-1]:
                blocks.append([])
        blocks = [b for b in blocks if b]
        lone = {i for i, b in enumerate(blocks) if len(b) == 1}  # a paragraph of one line is that line
        flat = [[w for line in b for w in line] for b in blocks]
        passages += self.spans(flat, lone)
        for words in passages:
            for name, dice in self.passage(words).items():
                best, n = out.get(name, (0.0, 0))
                out[name] = (max(best, dice), n + 1)
        found = self.windows(text.translate(WORDS).split())
        return {name: (max(out.get(name, (0.0, 0))[0], found.get(name, (0.0, 0))[0]), out.get(name, (0.0, 0))[1], found.get(name, (0.0, 0))[1]) for name in out.keys() | found.keys()}


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, threshold: float = 0.85) -> DataFrame:
    """(doc_id, license, dice, n_passages, n_windows): a row for each licence found in each row of ``docs``.

    ``dice`` is the best over the text's passages and windows, ``n_passages`` and ``n_windows`` how many reach ``threshold`` for the
    licence; a line, its sentences and a span of paragraphs count each, windows by their place. Null and empty texts and texts
    of one word hold none. A text of any length is scanned whole. Ties don't arise: licences are rows
    of their own. Repeated rows give their own results; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    known = templates() if known is None else known
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, threshold)
        for batch in small_batches(batches, "text"):
            rows, found = [], []
            for i, text in enumerate(texts_of(batch, "text")):
                for name, hit in sorted(scanner.text(text).items()):
                    rows.append(i)
                    found.append((name, *hit))
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "license", "dice", "n_passages", "n_windows"])

    return docs.select(F.col("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, license string, dice double, n_passages long, n_windows long")
