"""License scans by template-markup matching.

A template is license wording with two kinds of markup, as SPDX templates have
it: ``<<beginOptional>> ... <<endOptional>>`` encloses wording that may be
absent, and ``<<var;match="a-b">>`` stands for any a to b words. A template
compiles into an automaton over words; a text is accepted where some run of its
words takes the automaton from its start to its end, so all mandatory wording
must be there, exactly and in order. Templates are whole license texts and file
headers, and the names and identifiers by which notices refer to a license.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text, plain_words, text_chunks


class Template(NamedTuple):
    """``unless``: a character that, as the word behind, makes the wording another license's."""

    label: str
    markup: str
    base: bool = False
    unless: str = ""


def _optional(*wordings: str) -> str:
    return "".join(f" <<beginOptional>>{x}<<endOptional>> " for x in wordings)


def _var(least: int, most: int) -> str:
    return f' <<var;match="{least}-{most}">> '


#: What may stand in a notice between the name of a GNU license and its version.
_GNU = _optional("(\"GPL\")", "as published by", "the Free Software Foundation;", "either", "v") + _optional("version")


def _gnu(label: str, name: str, short: str, version: str, only: str = "") -> list[Template]:
    """Notices of a GNU license: its full or short name and the version (a version 2 that goes on with .1 is another's), or its identifiers."""
    unless = "1" if version == "2" else ""
    named = [Template(label, f"{start}{_GNU} {v}", unless=unless) for start in (f"GNU {name} General Public License", f"GNU {short}") for v in (version, f"v{version}")]
    named += [Template(label, f"{short}v{version}", unless=unless)]
    return named + [Template(label, f"SPDX-License-Identifier: {only}{tail}") for tail in ("", "-only", "-or-later") if only]


def _creative_commons(label: str, terms: str, short: str, versions: tuple[str, ...] = ("1.0", "2.0", "2.5", "3.0", "4.0")) -> list[Template]:
    """A license by its full name (any version, ported or not), and by its short name."""
    ported = _optional(*versions) + _optional("International", "Unported", "Generic", "Public")
    names = [Template(label, f"{terms} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'}") for v in versions]
    starts = [f"Creative Commons {terms}", *((f"CC {short}", f"creativecommons.org/licenses/{short}") if short else ())]
    return [Template(label, f"Creative Commons {terms}{ported} License"), *names, *(Template(label, f"{start} {v}") for v in versions for start in starts)]


#: The whole wording of licenses, with what holders may put in or leave out.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"

MIT = (
    "Permission is hereby granted" + _optional(", free of charge,") + "to any person obtaining a copy of" + _var(1, 12) + "to deal in" + _var(1, 4)
    + "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of" + _var(1, 4)
    + ", and to permit persons to whom" + _var(1, 4) + "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
    + _optional("(including the next paragraph)") + "shall be included in all copies or substantial portions of" + _var(1, 4) + "." + _AS_IS
    + " AND" + _optional("NON-INFRINGEMENT", "NONINFRINGEMENT") + "IN NO EVENT SHALL" + _var(1, 12) + "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,"
    " TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH" + _var(1, 4) + "OR THE USE OR OTHER DEALINGS IN" + _var(1, 4) + "."
)

_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    + _optional("1") + "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    + _optional("2") + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)

_BSD_NAME = (
    _optional("3") + "Neither the name of" + _var(1, 12) + "nor the names of" + _optional("its") + "contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)

_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY" + _var(1, 12) + "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR"
    " A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL" + _var(1, 12) + "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT"
    " LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
    " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

ISC = (
    "Permission to use, copy, modify, and" + _optional("/or") + "distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"
    " and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND" + _var(1, 8) + "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL" + _var(1, 8) + "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING"
    " FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the" + _var(1, 4) + "be held liable for any damages arising from the use of this software."
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    + _optional("1") + "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an"
    + _optional("acknowledgment") + _optional("acknowledgement") + "in the product documentation would be appreciated but is not required."
    + _optional("2") + "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."
    + _optional("3") + "This notice may not be removed or altered from any source distribution."
)

UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form"
    " or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any"
    " and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend"
    " this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT"
    " SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE"
    " USE OR OTHER DEALINGS IN THE SOFTWARE."
)

BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use,"
    " reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so,"
    " all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be"
    " included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable"
    " object code generated by a source language processor. " + _AS_IS + ", TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR"
    " ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    " http" + _optional("s") + "://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
    " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)

MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
    " http" + _optional("s") + "://mozilla.org/MPL/2.0/"
)

WTFPL = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."

#: The base phrases with their labels; whole texts and headers; the names and identifiers by which notices refer to a license.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", MIT),
    Template("bsd-2-clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    Template("bsd-3-clause", _BSD_CONDITIONS + _BSD_NAME + _BSD_DISCLAIMER),
    Template("isc", ISC),
    Template("zlib", ZLIB),
    Template("unlicense", UNLICENSE),
    Template("boost", BOOST),
    Template("wtfpl", WTFPL),
    Template("apache-2", APACHE_HEADER),
    Template("mpl-2", MPL_HEADER),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template("apache-2", "Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0"),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    Template("bsd-2-clause", "BSD 2-Clause<<beginOptional>>\"Simplified\"<<endOptional>> License"),
    Template("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    Template("bsd-3-clause", "BSD 3-Clause<<beginOptional>>\"New\" or \"Revised\"<<endOptional>> License"),
    Template("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    Template("isc", "SPDX-License-Identifier: ISC"),
    *_gnu("gpl-2", "", "GPL", "2", "GPL-2.0"),
    *_gnu("gpl-3", "", "GPL", "3", "GPL-3.0"),
    *_gnu("lgpl-2", "Library", "LGPL", "2", "LGPL-2.0"),
    *_gnu("lgpl-2.1", "Lesser", "LGPL", "2.1", "LGPL-2.1"),
    *_gnu("lgpl-3", "Lesser", "LGPL", "3", "LGPL-3.0"),
    *_gnu("agpl-3", "Affero", "AGPL", "3", "AGPL-3.0"),
    *(Template("mpl-2", f"Mozilla Public License{_optional('Version', 'v')} {v}.0") for v in ("2", "v2")),
    Template("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    *(Template("epl-2", f"Eclipse Public License{_optional('version', 'v')} {v}.0") for v in ("2", "v2")),
    Template("epl-2", "SPDX-License-Identifier: EPL-2.0"),
    *_creative_commons("cc-by", "Attribution", "BY"),
    *_creative_commons("cc-by-sa", "Attribution-ShareAlike", "BY-SA"),
    *_creative_commons("cc-by-nd", "Attribution-NoDerivatives", "BY-ND"),
    *_creative_commons("cc-by-nd", "Attribution-NoDerivs", "", ("1.0", "2.0", "2.5", "3.0")),
    *_creative_commons("cc-by-nc", "Attribution-NonCommercial", "BY-NC"),
    *_creative_commons("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    *_creative_commons("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    *_creative_commons("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivs", "", ("2.0", "2.5", "3.0")),
    Template("cc0", "CC0 1.0 Universal"),
    Template("cc0", "creativecommons.org/publicdomain/zero/1.0"),
    Template("boost", "Boost Software License<<beginOptional>> - Version<<endOptional>> 1.0"),
    Template("wtfpl", "under the Do What The Fuck You Want To Public License"),
    Template("proprietary", "All rights reserved<<var;match=\"0-20\">> without the prior written permission of <<var;match=\"1-8\">>"),
)

#: Words of a template's mandatory wording at which its evidence counts as half.
HALF = 3

ANY = object()


def parsed(markup: str) -> list:
    """Words, ("opt", [...]) for optional regions and ("var", a, b) for replaceable ones."""
    levels: list[list] = [[]]
    for piece in re.split(r"(<<.*?>>)", markup):
        if piece == "<<beginOptional>>":
            levels.append([])
        elif piece == "<<endOptional>>":
            inner = levels.pop()
            levels[-1] += [("opt", inner)] if inner else []
        elif piece.startswith("<<var"):
            least, most = re.search(r'match="(\d+)-(\d+)"', piece).groups()
            levels[-1].append(("var", int(least), int(most)))
        else:
            levels[-1] += plain_words(piece.encode())
    if len(levels) != 1:
        raise ValueError(f"unbalanced markup: {markup}")
    return levels[0]


def mandatory(parts: list) -> list[bytes]:
    return [x for x in parts if isinstance(x, bytes)]


class Automaton:
    """States 0 to ``end``; ``moves[s]`` maps a word, or ANY, to next states, ``skips[s]`` needs no word."""

    def __init__(self, parts: list, unless: str = ""):
        self.unless = unless.encode()
        self.moves: list[dict] = [{}]
        self.skips: list[set] = [set()]
        self.end = self._grow(0, parts)
        closed = [self._closure({s}) for s in range(len(self.moves))]
        self.start = closed[0]
        self.moves = [{w: frozenset().union(*(closed[t] for t in to)) for w, to in m.items()} for m in self.moves]
        self.needed = mandatory(parts)
        self.first = {w for s in self.start for w in self.moves[s]}

    def _state(self) -> int:
        self.moves.append({})
        self.skips.append(set())
        return len(self.moves) - 1

    def _step(self, at: int, word) -> int:
        self.moves[at].setdefault(word, set()).add(to := self._state())
        return to

    def _grow(self, at: int, parts: list) -> int:
        for part in parts:
            if isinstance(part, bytes):
                at = self._step(at, part)
            elif part[0] == "opt":
                done = self._grow(at, part[1])
                self.skips[at].add(done)
                at = done
            else:
                for _ in range(part[1]):
                    at = self._step(at, ANY)
                short = [at]
                for _ in range(part[2] - part[1]):
                    short.append(at := self._step(at, ANY))
                for s in short[:-1]:
                    self.skips[s].add(at)
        return at

    def _closure(self, states: set) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            new = self.skips[todo.pop()] - found
            found |= new
            todo += new
        return frozenset(found)

    def length(self, words: list[bytes], at: int) -> int:
        """Words of the shortest accepted run that starts at ``at``; 0 if there is none."""
        states = self.start
        for i in range(at, len(words)):
            states = frozenset().union(*(m[w] for s in states for m in [self.moves[s]] for w in (words[i], ANY) if w in m))
            if not states:
                return 0
            if self.end in states and (i + 1 == len(words) or words[i + 1] != self.unless):
                return i - at + 1
        return 0

    def places(self, words: list[bytes]) -> list[int]:
        anywhere = ANY in self.first
        return [i for i, w in enumerate(words) if (anywhere or w in self.first) and self.length(words, i)]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: words, base places, base labels, labels and a score.

    Null texts count as empty. ``score`` is m / (m + 3) for the largest number m
    of mandatory words among the accepted templates, 0 without any. Labels are
    distinct, sorted and comma-joined; ids may repeat, and other columns are
    ignored. Of texts of any length all words count; an empty table gives none.
    """

    def of(batches):
        compiled = [(t, Automaton(parsed(t.markup), t.unless)) for t in templates]
        # The longest mandatory word must be among the bytes of the text: a quick way to rule a template out.
        probes: dict[bytes, list] = {}
        for t, a in compiled:
            probes.setdefault(max(a.needed, key=len), []).append((t, a))
        for batch, texts in text_chunks(batches):
            out = []
            for text in texts:
                words = plain_words(text)
                low, held, base, labels, most, places = text.lower(), None, set(), set(), 0, []
                for probe, group in probes.items():
                    if probe not in low:
                        continue
                    held = held or set(words)
                    for t, a in group:
                        if not held.issuperset(a.needed) or not (found := a.places(words)):
                            continue
                        labels.add(t.label)
                        most = max(most, len(a.needed))
                        if t.base:
                            base.add(t.label)
                            places += found
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), most / (most + HALF)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return doc_text(docs).mapInArrow(of, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def pattern(parts: list) -> str:
    """The parts as a regular expression over words that each end with a space."""
    return "".join(x.decode() + " " if isinstance(x, bytes) else f"(?:{pattern(x[1])})?" if x[0] == "opt" else f"(?:[^ ]+ ){{{x[1]},{x[2]}}}" for x in parts)


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan``: list arithmetic for the base phrases, regular expressions for the labels."""
    base = [(t, mandatory(parsed(t.markup))) for t in templates if t.base]
    starts = " || ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p) - 1}] = [{', '.join(repr(x.decode()) for x in p)}])" for _, p in base)
    not_behind = {t: f"(?:$|[^{t.unless} ]|{t.unless}[^ ])" if t.unless else "" for t in templates}
    hit = {t: f"regexp_matches(s, ' {pattern(parsed(t.markup))}{not_behind[t]}')" for t in templates}

    def joined(some) -> str:
        names = sorted({t.label for t in some})
        return "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(hit[t] for t in some if t.label == n)} THEN '{n}' END" for n in names) + ")"

    most = "greatest(0, " + ", ".join(f"CASE WHEN {hit[t]} THEN {len(mandatory(parsed(t.markup)))} ELSE 0 END" for t in templates) + ")"
    return f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS (SELECT doc_id, w, {starts} AS b, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t),
q AS (SELECT doc_id, w, b, {joined([t for t in templates if t.base])} AS base_labels, {joined(templates)} AS labels, {most} AS m FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, CAST(list_min(b) - 1 AS BIGINT) AS first_word,
  CAST(list_max(b) - 1 AS BIGINT) AS last_word, base_labels, labels, CAST(m AS DOUBLE) / (m + {HALF}) AS score FROM q
"""


SQL = sql()
