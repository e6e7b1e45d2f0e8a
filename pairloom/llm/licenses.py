"""License scans by conditional compression.

Templates are whole license texts, their paragraphs of ``PART_WORDS`` words or more, and one-line notices. Candidate blocks are the runs of words, at any
place of a text, that lie within the permitted change of some template. They are found without a word list: a template of which ``most`` words may change
is cut into ``most + 1`` runs, so that any such block holds one of them unchanged; around each run that occurs, the text is aligned with the template
(exact word edit distance, free ends), and the nearest run of words is a block. Each block is compressed plainly and with each template as a zstandard
raw dictionary; templates are ranked by how much smaller the block becomes. The best-ranked template whose wording differs from the block by at most
``MAX_CHANGED`` of its words (exact word edit distance; case, line ends, comment signs and punctuation apart) wins; blocks that no template wins are
no license. Of overlapping finds in one text the longest stays, then the one with the fewest differences, then the first.

Texts without the longest word of any run are passed over by one search of the batch. Blocks that were judged before are remembered (``CACHE`` of them), as
license lines repeat across a corpus.

Edge cases: null and empty texts hold nothing; very long texts cost in proportion to their words and to the runs of templates in them; repeated rows are
reported once each; null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHANGED, MIN_REDUCTION, CACHE, PART_WORDS = 0.15, 0.2, 1 << 16, 25

# Names and wordings of public licenses and license notices.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_GPL = (
    "This {2} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation{4} either version {1} of the License, "
    "or (at your option) any later version.\n\n"
)
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": _GPL.format("", "3", "program", ":", ",") + _GPL_END.format("") + "\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-or-later": (
        _GPL.format("", "2", "program", ";", ";") + _GPL_END.format("") + "\n\nYou should have received a copy of the GNU General Public License along with this program; if not, write to the "
        "Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "AGPL-3.0-or-later": _GPL.format("Affero ", "3", "program", ":", ",") + _GPL_END.format("Affero ") + "\n\nYou should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1-or-later": (
        _GPL.format("Lesser ", "2.1", "library", ";", ";") + _GPL_END.format("Lesser ").replace("This program", "This library") + "\n\nYou should have received a copy of the GNU Lesser General Public License along with this library; "
        "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    ),
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": (
        _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
        "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law.\n\n"
        + _AS_IS + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>"
    ),
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def with_parts(templates: dict[str, str]) -> dict[str, str]:
    """The templates and their paragraphs of ``PART_WORDS`` words or more, as ``name-part1`` and so on; a paragraph of several templates has the first's name."""
    out, seen = dict(templates), set()
    for name, text in templates.items():
        parts = text.split("\n\n")
        for k, part in enumerate(parts, 1):
            key = " ".join(w for w, _, _ in plain_words(part))
            if len(parts) > 1 and len(key.split(" ")) >= PART_WORDS and key not in seen:
                seen.add(key)
                out[f"{name}-part{k}"] = part
    return out


def plain_words(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case without punctuation and comment signs at their ends, with their place in the text; words of such signs only are left out."""
    return [(w, m.start(), m.end()) for m in _WORD.finditer(text) if (w := m.group().lower().strip(".,;:()[]<>\"'*#/!-|%`=_"))]


def differences(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, or more than ``most`` as soon as it can't be less."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def ends_within(words: list[str], template: list[str], most: int) -> list[tuple[int, int, int]]:
    """Word edit distance, start and end of the nearest run of ``words`` for each end at which that is at most ``most`` from the template."""
    out = []
    row = [(i, 0) for i in range(len(template) + 1)]
    for j, x in enumerate(words, 1):
        before, row[0] = row[0], (0, j)
        for i, y in enumerate(template, 1):
            (n, at), (left, left_at), (up, up_at) = before, row[i - 1], row[i]
            before = row[i]
            n += x != y
            if left + 1 < n:
                n, at = left + 1, left_at
            if up + 1 < n:
                n, at = up + 1, up_at
            row[i] = (n, at)
        if row[-1][0] <= most and row[-1][1] < j:
            out.append((row[-1][0], row[-1][1], j))
    return out


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (in order of their starts) with those that overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, max_changed: float = MAX_CHANGED) -> None:
        self.max_changed = max_changed
        templates = with_parts(TEMPLATES if templates is None else templates)
        self.words = {k: w for k, t in templates.items() if (w := [w for w, _, _ in plain_words(t)])}
        self.with_template = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=3)
        self.judge, self.aligned = lru_cache(maxsize=CACHE)(self._judge), lru_cache(maxsize=CACHE)(self._aligned)
        # by first word: the runs of which a block within the permitted change holds at least one unchanged, their template and place in it
        self.runs: dict[str, list[tuple[list[str], str, int]]] = defaultdict(list)
        for name, w in self.words.items():
            n = int(max_changed * len(w)) + 1
            for k in range(n):
                a, b = k * len(w) // n, (k + 1) * len(w) // n
                self.runs[w[a]].append((w[a:b], name, a))
        needles = sorted({max(run, key=len) for runs in self.runs.values() for run, _, _ in runs})
        self.pattern = "(?i)" + "|".join(map(re.escape, needles)) if needles else "(?-i:[^\\s\\S])"

    def ranked(self, block: bytes) -> list[tuple[float, str]]:
        """Templates by the share of the block's compressed size that they save, most first."""
        full = len(self.plain.compress(block))
        return sorted(((1 - len(z.compress(block)) / full, k) for k, z in self.with_template.items()), key=lambda x: (-x[0], x[1]))

    def most(self, name: str) -> int:
        return int(self.max_changed * len(self.words[name]))

    def _judge(self, block: str) -> tuple[str, int, float] | None:
        words = block.split(" ")
        for saved, name in self.ranked(block.encode("utf-8", "surrogatepass")):
            if saved < MIN_REDUCTION:
                return None
            if (n := differences(words, self.words[name], self.most(name))) <= self.most(name):
                return name, n, saved
        return None

    def _aligned(self, words: tuple[str, ...], name: str) -> list[tuple[int, int, int]]:
        return ends_within(list(words), self.words[name], self.most(name))

    def blocks(self, words: list[str]) -> set[tuple[int, int]]:
        """Bounds of the runs of words that are within the permitted change of a template: of those that overlap for one template the nearest."""
        starts: dict[str, set[int]] = defaultdict(set)
        runs = self.runs
        for i, w in enumerate(words):
            if w in runs:
                for run, name, at in runs[w]:
                    if words[i : i + len(run)] == run:
                        starts[name].add(i - at)
        out = set()
        for name, at in starts.items():
            template, most = self.words[name], self.most(name)
            n = len(template)
            exact = sorted(s for s in at if s >= 0 and words[s : s + n] == template)
            found = [(0, 0, s, s + n) for s in exact]
            near = sorted(s for s in at if not ((k := bisect_left(exact, s - most)) < len(exact) and exact[k] <= s + most))
            for a, b in _joined([(max(0, s - most), min(len(words), s + n + most)) for s in near]):
                found += [(d, abs(end - start - n), start + a, end + a) for d, start, end in self.aligned(tuple(words[a:b]), name)]
            kept: list[tuple[int, int]] = []
            for _, _, start, end in sorted(found):
                k = bisect_left(kept, (start, end))
                if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or end <= kept[k][0]):
                    kept.insert(k, (start, end))
            out.update(kept)
        return out

    def scan(self, text: str) -> list[dict]:
        words = plain_words(text)
        plain = [w for w, _, _ in words]
        finds = []
        for i, end in sorted(self.blocks(plain)):
            if won := self.judge(" ".join(plain[i:end])):
                finds.append({"license": won[0], "first_char": words[i][1], "n_chars": words[end - 1][2] - words[i][1], "n_words": end - i, "changed": won[1], "saved": won[2]})
        kept: list[dict] = []
        for f in sorted(finds, key=lambda f: (-f["n_words"], f["changed"], f["first_char"])):
            if all(f["first_char"] >= k["first_char"] + k["n_chars"] or k["first_char"] >= f["first_char"] + f["n_chars"] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f["first_char"])


_FOUND = "license string, first_char int, n_chars int, n_words int, changed int, saved double"


def _scan(templates: dict[str, str] | None, max_changed: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, max_changed)
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), scanner.pattern), False))
            rows = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for f in scanner.scan(text.as_py()):
                    rows["doc_id"].append(doc_id)
                    for k, v in f.items():
                        rows[k].append(v)
            if rows:
                types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    return scan


def find_licenses(documents: DataFrame, templates: dict[str, str] | None = None, max_changed: float = MAX_CHANGED) -> DataFrame:
    """``doc_id, license, first_char, n_chars, n_words, changed, saved`` of each license notice in ``documents`` (``doc_id, text``)."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(templates, max_changed), f"doc_id long, {_FOUND}")
