r"""License scans by template markup.

A template is a license text in the public template markup of license lists.  ``<<beginOptional>>...<<endOptional>>``
may be left out; ``<<var;name="...";original="...";match="...">>`` stands for any text that the regular expression
``match`` accepts as a whole; everything else is mandatory wording.  Tags take their parameters in any order, an
optional region may have a name, and any other tag, a missing or broken ``match`` and an open region are errors.

A template compiles into a token automaton (word, skip and var steps) that runs over the words of a text from every
place where the template's first mandatory words stand, and accepts where all mandatory wording was met exactly.  The
text of a var is what lies between the words before and after it, white space collapsed, with or without the signs at its
ends; it is compared without regard to case, as the words are.  Variable or optional text at either end of a template decides nothing and is dropped.
Places are found for a whole slice of texts at once by comparing word codes.

Three base phrases are found in the same way and keep their labels; the automata add theirs.  The score is the share
of a text's words that a label covers.

Defined results: a null or empty text has no words, no labels and score 0; a template that stands several
times counts once as a label; repeated rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from grainworks.llm.frames import map_slices
from grainworks.llm.text import ALNUM_WORD, Words, bytes_of, lower, span_hashes

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: parts that several public license texts share (fixed values)
_BULLET = '<<var;name="bullet";original="";match=".{0,20}">>'
_WHO = '<<var;name="copyrightHolder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">>'
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so"""
_MIT_NOTICE = """, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = f"""THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: {_BULLET} Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. {_BULLET} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = f"""{_BULLET} Neither the name of {_WHO} nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_WARRANTY = f"""THIS SOFTWARE IS PROVIDED BY {_WHO} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, <<var;name="and";original="and/or";match="and(/or)?">> distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="author2";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL_NOTICE = """under the terms of the GNU {0}General Public License as published by the Free Software Foundation<<var;name="punctuation";original="";match="[,;:]?">>
either <<beginOptional>>version {1} of the License, or (at your option) any later version<<endOptional>>"""

#: label -> templates: short licenses in full, of long ones the notices that files carry (fixed values)
TEMPLATES = {
    "0bsd": [f"{_ISC_GRANT}. {_ISC_WARRANTY}"],
    "agpl-3.0": ["GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3"],
    "apache-2.0": [
        "licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2.0",
        "Apache License Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at <<var;name="url";original="http://www.apache.org/licenses/LICENSE-2.0";match="https?://www\\.apache\\.org/licenses/LICENSE-2\\.0">> Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "bsd-2-clause": [f"{_BSD_GRANT} {_BSD_WARRANTY}"],
    "bsd-3-clause": [f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}"],
    "bsl-1.0": [
        f"""Boost Software License - Version 1.0 <<beginOptional>>- August 17th, 2003<<endOptional>> Permission is hereby granted, free of charge, to any person or organization
        obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
        copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all
        copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.""",
    ],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License"],
    "cc-by-nc-4.0": ["CC BY NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International <<beginOptional>>Public<<endOptional>> License"],
    "cc-by-sa-4.0": ["CC BY SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International <<beginOptional>>Public<<endOptional>> License"],
    "gpl-2.0": ["GNU General Public License <<beginOptional>>as published by the Free Software Foundation either<<endOptional>> version 2"],
    "gpl-3.0": ["GNU General Public License <<beginOptional>>as published by the Free Software Foundation either<<endOptional>> version 3"],
    "isc": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"],
    "lgpl-2.1": ["GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation either<<endOptional>> version 2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation either<<endOptional>> version 3"],
    "mit": [
        "<<beginOptional>>this software is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License",
        f"{_MIT_GRANT}{_MIT_NOTICE} {_MIT_WARRANTY}",
    ],
    "mit-0": [f"{_MIT_GRANT}. {_MIT_WARRANTY}"],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        <<var;name="url";original="http://mozilla.org/MPL/2.0/";match="https?://(www\\.)?mozilla\\.org/MPL/2\\.0/?\\.?">>""",
        "Mozilla Public License <<beginOptional>>Version<<endOptional>> 2.0",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "zlib": [
        f"""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions: {_BULLET} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. {_BULLET} Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. {_BULLET} This notice may not be removed or altered from any source distribution.""",
    ],
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TAG = re.compile(r"(<<(?:[^>\"]|\"(?:[^\"\\]|\\.)*\"|>(?!>))*>>)", re.DOTALL)
_PARAMETER = re.compile(r'\s*;\s*([A-Za-z]+)\s*=\s*"((?:[^"\\]|\\.)*)"', re.DOTALL)
_SPACES = re.compile(rb"\s+")
#: ASCII signs and the space: those at either end of a variable's text may belong to the wording around it
_SIGNS = bytes(x for x in range(32, 127) if not chr(x).isalnum())


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def tag(text: str) -> tuple[str, dict[str, str]]:
    """(kind, parameters) of one ``<<...>>``; an error if it is not of the markup."""
    inside = text[2:-2]
    name = re.match(r"\s*([A-Za-z]+)", inside)
    if name is None or name[1] not in ("beginOptional", "endOptional", "var"):
        raise ValueError(f"unknown tag {text}")
    at, found = name.end(), {}
    while m := _PARAMETER.match(inside, at):
        found[m[1]], at = m[2], m.end()
    if inside[at:].strip(" ;\n\t"):
        raise ValueError(f"a tag that cannot be read: {text}")
    if name[1] == "var" and "match" not in found:
        raise ValueError(f"a variable without a match: {text}")
    return name[1], found


class Automaton:
    """``steps``: ("word", w), ("skip", to) at the start of an optional region, ("var", pattern, most characters)."""

    def __init__(self, template: str):
        steps: list[tuple] = []
        opened: list[int] = []
        for i, piece in enumerate(_TAG.split(template)):
            if i % 2 == 0:
                if "<<" in piece or ">>" in piece:
                    raise ValueError("a tag is not closed")
                steps += [("word", w) for w in words_of(piece)]
                continue
            kind, found = tag(piece)
            if kind == "beginOptional":
                opened.append(len(steps))
                steps.append(("skip", -1))
            elif kind == "endOptional":
                if not opened:
                    raise ValueError("an optional region ends that has not begun")
                steps[opened.pop()] = ("skip", len(steps))
            else:
                try:
                    pattern = re.compile(found["match"].encode(), re.IGNORECASE | re.DOTALL)
                except re.error as e:
                    raise ValueError(f"a variable's match is no regular expression: {e}") from None
                steps.append(("var", pattern, _most(found["match"])))
        if opened:
            raise ValueError("an optional region is not closed")
        while steps and steps[0][0] != "word":  # what decides nothing, at the start and at the end
            drop = steps[0][1] if steps[0][0] == "skip" else 1
            steps = [("skip", s[1] - drop) if s[0] == "skip" else s for s in steps[drop:]]
        while steps and (last := max((i for i, s in enumerate(steps) if s[0] == "skip" and s[1] == len(steps)), default=len(steps) if steps[-1][0] == "word" else len(steps) - 1)) < len(steps):
            steps = [("skip", min(s[1], last)) if s[0] == "skip" else s for s in steps[:last]]
        self.steps = steps
        self.lead = []
        for s in steps:
            if s[0] != "word" or len(self.lead) == 4:
                break
            self.lead.append(s[1])
        if len(self.lead) < 2:
            raise ValueError("a template must begin with two mandatory words")

    def _closure(self, states: set, at: int) -> set:
        """What can be reached before word ``at`` is read: optional regions left out, variables begun."""
        todo, out = list(states), set()
        while todo:
            pc, began = s = todo.pop()
            if s in out:
                continue
            out.add(s)
            if pc < len(self.steps):
                step = self.steps[pc]
                if step[0] == "skip":
                    todo += [(pc + 1, -1), (step[1], -1)]
                elif step[0] == "var" and began < 0:
                    out.discard(s)
                    todo.append((pc, at))
        return out

    def match(self, words: list[bytes], between) -> int:
        """How many of ``words`` the longest match from their start takes; 0 if there is none.

        ``between(i, j)``: the text after word ``i`` - 1 and before word ``j``.
        """
        states, best = self._closure({(0, -1)}, 0), 0
        for i in range(len(words) + 1):
            # a variable may end before word i, and so may the next one that begins there
            todo = [x for x in states if self._is_var(x[0])]
            while todo:
                pc, began = todo.pop()
                _, pattern, most = self.steps[pc]
                follows = self._next(pc + 1, words[i] if i < len(words) else None)
                if not follows and most == float("inf"):
                    continue
                if pattern.pattern in (b".*", b".+") and i > began:
                    fits = True
                else:
                    held = _SPACES.sub(b" ", between(began, i)).strip()
                    bare = held.strip(_SIGNS)
                    if len(bare) > most:
                        states.discard((pc, began))
                        continue
                    fits = follows and (pattern.fullmatch(held) or pattern.fullmatch(bare))
                if fits:
                    more = self._closure({(pc + 1, -1)}, i) - states
                    states |= more
                    todo += [x for x in more if self._is_var(x[0])]
            if any(pc == len(self.steps) for pc, _ in states):
                best = i
            if i == len(words):
                break
            after = set()
            for pc, began in states:
                if pc < len(self.steps):
                    step = self.steps[pc]
                    if step[0] == "word" and step[1] == words[i]:
                        after.add((pc + 1, -1))
                    elif step[0] == "var":
                        after.add((pc, began))
            if not after:
                break
            states = self._closure(after, i + 1)
        return best

    def _is_var(self, pc: int) -> bool:
        return pc < len(self.steps) and self.steps[pc][0] == "var"

    def _next(self, pc: int, word: bytes | None) -> bool:
        """Whether ``word`` may follow: the cheap test before a variable's pattern is tried."""
        for p, _ in self._closure({(pc, -1)}, 0):
            if p == len(self.steps) or self.steps[p][0] == "var" or (self.steps[p][0] == "word" and self.steps[p][1] == word):
                return True
        return False


def _most(pattern: str) -> float:
    """The most bytes that a match of ``pattern`` can have."""
    from re import _parser

    width = _parser.parse(pattern).getwidth()[1]
    return float("inf") if width >= 1 << 31 else 4 * width


def compiled(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, ts in sorted(templates.items()) for t in ts]


def _codes(wanted: list[bytes]) -> dict[bytes, np.uint64]:
    data = np.frombuffer(b" ".join(wanted), np.uint8)
    end = np.cumsum([len(w) + 1 for w in wanted]) - 1
    return dict(zip(wanted, span_hashes(data, end - [len(w) for w in wanted], end)))


def _places(hashes: np.ndarray, doc: np.ndarray, codes: list[np.uint64]) -> np.ndarray:
    """Words at which the coded words stand one after the other in one row."""
    n = len(hashes) - len(codes) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashes[:n] == codes[0])
    for i, c in enumerate(codes[1:], 1):
        at = at[hashes[at + i] == c]
    return at[doc[at] == doc[at + len(codes) - 1]]


class _Run:
    """The words of one text from a place on, as bytes when they are asked for."""

    def __init__(self, words: Words, data: np.ndarray, at: int, stop: int):
        self.words, self.data, self.at, self.stop = words, data, at, stop

    def __len__(self) -> int:
        return self.stop - self.at

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.words.start[self.at + i] : self.words.end[self.at + i]].tobytes()


def _between(words: Words, data: np.ndarray, i: int, j: int, stop: int, end: int) -> bytes:
    """The text after word i - 1 and before word j; to the text's end if there is no word j."""
    return data[words.end[i - 1] : words.start[j] if j < stop else end].tobytes()


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def digests(data: np.ndarray, off: np.ndarray, automata: list, codes: dict) -> list:
    data = lower(data)
    words = Words(data, off, ALNUM_WORD)
    hashes, rows = words.hashes(), words.rows
    n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    cover = np.zeros(len(words) + 1, np.int64)
    base: list[set] = [set() for _ in range(rows)]
    every: list[set] = [set() for _ in range(rows)]
    for phrase, label in BASE.items():
        own = [codes[w] for w in words_of(phrase)]
        at = _places(hashes, words.doc, own)
        row = words.doc[at]
        n_base += np.bincount(row, minlength=rows)
        np.minimum.at(first, row, at - words.first[row])
        np.maximum.at(last, row, at - words.first[row])
        np.add.at(cover, at, 1)
        np.add.at(cover, at + len(own), -1)
        for r in np.unique(row).tolist():
            base[r].add(label)
    for label, a in automata:
        for at in _places(hashes, words.doc, [codes[w] for w in a.lead]).tolist():
            r = int(words.doc[at])
            took = a.match(_Run(words, data, at, int(words.first[r + 1])), lambda i, j: _between(words, data, at + i, at + j, int(words.first[r + 1]), int(off[r + 1])))  # noqa: B023  used at once
            if took:
                every[r].add(label)
                cover[at] += 1
                cover[at + took] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    score = (inside[words.first[1:]] - inside[words.first[:-1]]) / np.maximum(words.count, 1)
    some = n_base > 0
    name = lambda s: ",".join(sorted(s))
    return [words.count, n_base, [int(x) if y else None for x, y in zip(first, some)], [int(x) if y else None for x, y in zip(last, some)], [name(b) for b in base], [name(b | e) for b, e in zip(base, every)], score]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``key`` and the columns of SCHEMA for every row of ``docs``."""
    automata = compiled(templates)
    codes = _codes(sorted({w for p in BASE for w in words_of(p)} | {w for _, a in automata for w in a.lead}))

    def run(part):
        return [part.column(0), *digests(*bytes_of(part.column(1)), automata, codes)]

    slim = docs.select(docs[key].cast("long").alias(key), docs[text].alias(text))
    return map_slices(slim, text, run, f"`{key}` long, {SCHEMA}")
