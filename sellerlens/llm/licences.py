"""Licence notices in documents, by likeness with templates.

Lines, and the sentences of lines, are normalised and compared with templates by the Dice
coefficient of their sets of word bigrams. With ``a`` bigrams against ``b``, the coefficient is at most
2 min(a, b) / (a + b), so that only templates with a size in reach of the threshold are compared; a
segment that is out of reach of all templates isn't even cut into bigrams.

Bodies and headers of licences, and notices that are wrapped, are found in runs of sentences joined over
line breaks. A run at the threshold holds at least dice / (2 - dice) of a template's bigrams, so that a
document with fewer of them has no run of that template; in the others all runs in reach by size are
compared that begin with one of its bigrams (without such a beginning a run is only better).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.shared import by_batches

DICE = 0.8

# Names and the wording of common notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
    "in all copies or substantial portions of the Software. "
)
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def _gnu(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public "
        f"License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. "
        f"You should have received a copy of the GNU {kind}General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    )


# The wording of licence bodies and of the headers of licences too long for a file.
BODIES = [
    ("MIT", _MIT_GRANT + _MIT_END),
    ("MIT", _MIT_GRANT),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
            "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
            "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
            "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
            "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("GPL-2.0", _gnu("", "2")),
    ("GPL-3.0", _gnu("", "3")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1")),
    ("LGPL-3.0", _gnu("Lesser ", "3")),
    ("AGPL-3.0", _gnu("Affero ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý\"(])")
_OWNER = re.compile(r"copyright\s*(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-,]\s*\d{4})*)?[^.\n]{0,60}?(?=licen[sc]|released|all rights|$)")


def words(text: str) -> list[str]:
    """Lower case, without signs, copyright holders and years of copyright; licence and license are one."""
    low = text.lower()
    if "copyright" in low:
        low = _OWNER.sub(" ", low)
    return _WORD.findall(low.replace("licence", "license"))


def plain_words(text: str) -> list[str]:
    """As ``words``, with names and years left in: where lines break must not matter."""
    return _WORD.findall(text.lower().replace("licence", "license"))


def bigrams(found: list[str]) -> frozenset:
    return frozenset(zip(found, found[1:], strict=False))


def within(a: int, b: int, dice: float) -> bool:
    return 2 * min(a, b) >= dice * (a + b)


class Templates:
    def __init__(self, templates: list[tuple[str, str]], dice: float) -> None:
        self.dice = dice
        self.sets = sorted(((len(b), name, b) for name, text in templates if (b := bigrams(words(text)))), key=lambda t: (t[0], t[1]))
        sizes = {n for n, _, _ in self.sets}
        top = max(sizes, default=0)
        self.reach = {a: [t for t in self.sets if within(a, t[0], dice)] for a in range(1, int(top * 2 / dice) + 2)}

    def best(self, segment: str) -> tuple[float, str] | None:
        found = words(segment)
        b = bigrams(found)
        scored = [(2 * len(b & t) / (len(b) + n), name) for n, name, t in self.reach.get(len(b), ())]
        top = max(scored, key=lambda s: (s[0], [-ord(c) for c in s[1]]), default=None)
        return top if top and top[0] >= self.dice else None

    def lines(self, text: str | None) -> Iterator[tuple[int, str, float]]:
        for k, line in enumerate((text or "").split("\n")):
            segments = [line]
            if "." in line or "!" in line or "?" in line:
                sentences = _SENTENCE.split(line)
                segments += sentences if len(sentences) > 1 else []
            found = [b for s in segments if (b := self.best(s))]
            if found:
                dice, name = max(found, key=lambda s: (s[0], [-ord(c) for c in s[1]]))
                yield k, name, dice


class Runs:
    """Templates that are compared with runs of sentences; ``notices`` with runs over more than one line only."""

    def __init__(self, notices: list[tuple[str, str]], bodies: list[tuple[str, str]], dice: float) -> None:
        self.dice = dice
        every = [(*t, False) for t in notices] + [(*t, True) for t in bodies]
        self.sets = [(name, b, within_line) for name, text, within_line in every if (b := bigrams(plain_words(text)))]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, b, _) in enumerate(self.sets):
            for pair in b:
                self.holders.setdefault(pair, []).append(k)

    def found(self, text: str | None) -> list[tuple[float, str, int, int]]:
        """``dice, name, first line, last line`` of the best runs that don't overlap."""
        if not self.sets:
            return []
        pieces = []  # line and words of each sentence, or part of one
        for k, line in enumerate((text or "").split("\n")):
            for s in _SENTENCE.split(line) if "." in line or "!" in line or "?" in line else [line]:
                if w := plain_words(s):
                    pieces.append((k, w))
        flat = [w for _, ws in pieces for w in ws]
        held: dict[int, set] = {}
        for pair in self.holders.keys() & set(zip(flat, flat[1:], strict=False)):
            for k in self.holders[pair]:
                held.setdefault(k, set()).add(pair)
        runs = []
        for k, pairs in held.items():
            if len(pairs) >= self.dice / (2 - self.dice) * len(self.sets[k][1]) - 1e-9:
                runs += self._runs(pieces, k)
        chosen = []
        for dice, name, i, j in sorted(runs, key=lambda r: (-r[0], r[3] - r[2], r[1], r[2])):
            if all(j < a or i > b for _, _, a, b in chosen):
                chosen.append((dice, name, i, j))
        return [(dice, name, pieces[i][0], pieces[j][0]) for dice, name, i, j in chosen]

    def _runs(self, pieces: list[tuple[int, list[str]]], k: int) -> Iterator[tuple[float, str, int, int]]:
        name, b, within_line = self.sets[k]
        most = len(b) * (2 - self.dice) / self.dice + 1e-9
        for i, (line, first) in enumerate(pieces):
            after = pieces[i + 1][1][:1] if i + 1 < len(pieces) else []
            if not any(p in b for p in zip(first, first[1:] + after, strict=False)):
                continue
            seen, both, last = set(), 0, None
            for j in range(i, len(pieces)):
                w = pieces[j][1] if last is None else [last, *pieces[j][1]]
                new = set(zip(w, w[1:], strict=False)) - seen
                seen |= new
                both += len(new & b)
                last = w[-1]
                if len(seen) > most:
                    break
                dice = 2 * both / (len(seen) + len(b))
                if dice >= self.dice and (within_line or pieces[j][0] > line):
                    yield dice, name, i, j


def hits(known: Templates, runs: Runs, text: str | None) -> list[tuple[int, str, float]]:
    """Lines with a notice of their own, and the first lines of runs that are more like a template than those in them."""
    lines = {k: (dice, name) for k, name, dice in known.lines(text)}
    out = dict(lines)
    for dice, name, first, last in runs.found(text):
        inside = [lines[k] for k in range(first, last + 1) if k in lines]
        if all(other < dice or name_of != name for other, name_of in inside) and (first not in out or out[first][0] < dice):
            out[first] = (dice, name)
    return [(k, name, dice) for k, (dice, name) in sorted(out.items())]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE, bodies: list[tuple[str, str]] = BODIES) -> DataFrame:
    """``doc_id, line_no, licence, dice`` for every line with a notice; lines count from 0.

    A line has the licence of its best segment, ties going to the name that sorts first. A body, a header
    or a notice over several lines stands on its first line, unless one of its lines alone is as much
    like a notice of that licence. Null and empty texts have no notices, null ids stay null, repeated
    rows are scanned each, no rows give none, and without templates and bodies nothing is found. Other columns are not looked at.
    """
    by_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, runs = Templates(templates, dice), Runs(templates, bodies, dice)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch["id"].astype("Int64"), batch["text"], strict=True) for hit in hits(known, runs, t)]
            out = pd.DataFrame(rows, columns=["doc_id", "line_no", "licence", "dice"])
            yield out.astype({"doc_id": "Int64"})

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInPandas(run, "doc_id long, line_no long, licence string, dice double")
