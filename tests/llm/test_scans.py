import random

import pytest
from checks import DATA, same_rows

from cortexa.llm import decontaminate, license_scan, merkle, queries
from cortexa.llm.common import plain_words
from cortexa.llm.license_scan import Automaton, Template, parsed


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_plain_words():
    assert plain_words("The MIT-License, v2.0 É\x7fz".encode()) == [b"the", b"mit", b"license", b"v2", b"0", "É".encode(), b"z"]


@pytest.mark.parametrize(
    "markup, text, places",
    [
        ("a b", "a b a b", [0, 2]),
        ("a <<beginOptional>>x y<<endOptional>> b", "a b a x y b a x b", [0, 2]),
        ('a <<var;match="0-2">> b', "a b a q b a q q b a q q q b", [0, 2, 5]),
        ('a <<var;match="2-3">> b', "a q b a q q b", [3]),
        ("<<beginOptional>>z<<endOptional>> a", "z a a", [0, 1, 2]),
        ("a <<beginOptional>>x <<beginOptional>>y<<endOptional>> z<<endOptional>> b", "a x z b a x y z b a y b", [0, 4]),
    ],
)
def test_automaton(markup, text, places):
    assert Automaton(parsed(markup)).places(text.encode().split()) == places


def test_markup_must_balance():
    with pytest.raises(ValueError):
        parsed("a <<beginOptional>> b")


def test_license_scan_odd_rows(docs_of):
    long = "x " * 50_000 + "Licensed under the Apache License, Version 2.0." + " y" * 50_000
    pairs = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "under the MIT license under the mit license"), (4, long), (None, "CC BY-NC 4.0"), (5, "under the mit\nlicenses")]
    got = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(docs_of(pairs)).collect()}
    assert got == {
        (1, 0): (0, None, None, "", ""),
        (2, 0): (0, None, None, "", ""),
        (3, 5): (1, 1, 1, "mit", "mit"),
        (3, 8): (2, 0, 4, "mit", "mit"),
        (4, 100_008): (1, 50_003, 50_003, "apache-2", "apache-2"),
        (None, 5): (1, 0, 0, "cc-by-nc", "cc-by-nc"),
        (5, 4): (0, None, None, "", ""),
    }
    assert rows(license_scan.scan(docs_of([]))) == []


def test_template_of_ones_own(docs_of):
    template = Template("own", 'Copyright <<var;match="1-3">> Acme <<beginOptional>>Corporation<<endOptional>> all rights reserved')
    got = license_scan.scan(docs_of([(1, "copyright 2020 acme all rights reserved"), (2, "Copyright (c) 2020 Acme Corporation. All rights reserved"), (3, "Copyright Acme all rights reserved")]), (template,))
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "own", 2: "own", 3: ""}


#: Notices as projects print them, typed from the licenses and not from the templates, with the labels that they must get.
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE"""

MIT_TEXT = f"""Copyright (c) 2019 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""

BSD_3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""

BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

NOTICES = [
    ("mit", MIT_TEXT),
    ("mit", MIT_TEXT.replace("the Software", "the Materials").replace("THE SOFTWARE OR", "THE MATERIALS OR").replace("IN THE\nSOFTWARE", "IN THE\nMATERIALS")),
    ("", MIT_TEXT.replace("without restriction,", "without restriction except for commercial use,")),
    ("", MIT_TEXT[:400]),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    ("bsd-2-clause", BSD_2 + BSD_END),
    ("bsd-3-clause", BSD_2 + BSD_3 + BSD_END),
    ("bsd-3-clause", (BSD_2 + BSD_3 + BSD_END).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("the copyright holder nor", "Acme Widgets, Inc. nor")),
    ("", BSD_2 + BSD_3),
    ("bsd-2-clause", "This project is under the BSD 2-Clause License."),
    ("bsd-3-clause", 'The BSD 3-Clause "New" or "Revised" License'),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""),
    ("gpl-2", "This file may be used under the terms of the GNU General Public License version 2 only."),
    ("gpl-2", "licensed under the GPLv2"),
    ("", "GNU General Public License, version 2.1"),
    ("gpl-3", """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-3", "Released under the GNU General Public License v3.0"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-3", "GNU General Public License (GPL) version 3"),
    ("gpl-3", "GNU GPL version 3"),
    ("lgpl-2", """it under the terms of the GNU Library General Public License version 2 as
published by the Free Software Foundation"""),
    ("lgpl-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("lgpl-2.1", "GNU LGPL v2.1"),
    ("lgpl-3", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("mpl-2", "Mozilla Public License Version 2.0"),
    ("mpl-2", "Mozilla Public License v2.0"),
    ("epl-2", "which accompanies this distribution, and is made available under the terms of the Eclipse Public License v2.0"),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "This work is licensed under CC BY 4.0. To view a copy, visit https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by", "Creative Commons Attribution 3.0 Unported License"),
    ("cc-by", "Except where noted, under the Creative Commons Attribution License"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 International Public License; additional terms may apply."),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike International License"),
    ("cc-by-nd", "Attribution-NoDerivatives 4.0 International"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivs 2.5 Generic License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("cc-by-nc,cc-by-nc-sa", "released under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "http://creativecommons.org/licenses/by-nc-nd/3.0/"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivs 3.0 Unported"),
    ("cc0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("cc0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("unlicense", f"""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

{WARRANTY} AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""),
    ("zlib", """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"),
    ("boost", f"""Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

{WARRANTY}, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("wtfpl", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

 0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
    ("", "The general public was licensed to enter; creative commons are attributed to no one."),
    ("", "GNU General Public License texts number 7. Version 2 of this page is out."),
    ("", "Permission is hereby granted to nobody."),
]


def test_real_notices_get_their_labels(docs_of, duck):
    docs = docs_of([(k, t) for k, (_, t) in enumerate(NOTICES)])
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert [(got[k], t) for k, (_, t) in enumerate(NOTICES)] == NOTICES
    assert {t.label for t in license_scan.TEMPLATES} == {x for labels, _ in NOTICES for x in labels.split(",") if x} | {"wtfpl"}


def test_license_scan_matches_sql(spark, duck):
    same_rows(queries.QUERIES["op1_license_scan"](spark, DATA), queries.SQL["op1_license_scan"], duck)


def brute_contained(docs, items, share=0.8):
    out = {}
    for i, t in docs:
        words = plain_words((t or "").encode())
        for k, u in items:
            item = plain_words((u or "").encode())
            size = min(5, len(item))
            own, whole = ({tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set() for x in (words, item))
            if k is not None and whole and len(own & whole) >= share * len(whole):
                best = (len(own & whole) / len(whole), len(own & whole), len(whole))
                out[i, k] = max(out.get((i, k), best), best)
    return sorted(((i, k, n, q, c) for (i, k), (c, n, q) in out.items()), key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_matches_brute_force(spark, docs_of, limit):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(k, words(rng.randrange(1, 60))) for k in range(30)]
    docs = [(1, None), (2, ""), (None, " ".join(items[3][1]))]
    for k in range(60):
        _, passage = rng.choice(items)
        passage = passage.copy()
        for _ in range(rng.randrange(0, 3)):
            passage[rng.randrange(len(passage))] = "changed"
        docs.append((10 + k, ", ".join(words(rng.randrange(0, 300)) + [w.upper() for w in passage] + words(20))))
    docs += docs[-3:]
    table = [(k, " ".join(w), "extra") for k, w in items] + [(None, docs[5][1], "extra"), (40, None, "extra"), (41, "?!", "extra"), (3, "one two", "extra"), (42, "w7", "extra"), (43, "Changed W3", "extra")]
    docs += [(90, "one, TWO"), (91, "two one"), (92, "w7")]
    items_df = spark.createDataFrame(table, "item_id long, text string, doc_id string")
    got = rows(decontaminate.contained(docs_of(docs), items_df, broadcast_words=limit))
    assert got == brute_contained(docs, [(k, t) for k, t, _ in table])
    assert len(got) > 20 and {(90, 3), (92, 42)} <= {r[:2] for r in got} and 91 not in {r[0] for r in got}
    assert rows(decontaminate.contained(docs_of([]), items_df, broadcast_words=limit)) == []
    assert rows(decontaminate.contained(docs_of(docs), items_df.limit(0), broadcast_words=limit)) == []


def test_sketches_hold_enough(docs_of):
    for q in range(1, 600):
        most = decontaminate.size_class(q)
        assert most >= q
        need = -(-4 * q // 5)
        assert most - -(-4 * most // 5) + 1 >= q - need + 1


def test_decontamination_matches_sql(spark, duck):
    same_rows(queries.QUERIES["op10_decontamination"](spark, DATA), queries.SQL["op10_decontamination"], duck)


PAGES = [(k, f"http://h/{k}", f"<p>é {k}</p>" * (k % 5)) for k in range(300)]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, hash string, part string")


def test_audit_finds_what_differs(spark):
    other = [r for r in PAGES if r[0] != 77]
    other[5] = (5, "http://h/5", "changed")
    other.append((900, "http://h/900", "new"))
    a, b = (merkle.manifest(pages_of(spark, x), per_file=20) for x in (PAGES, other))
    assert sorted((r.page_id, r.status) for r in merkle.audit(a, b).collect()) == [(5, "changed"), (77, "missing"), (900, "added")]
    assert merkle.audit(a, a).collect() == []


def test_audit_of_odd_pages(spark):
    odd = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "p"), (None, None, None), (-5, "u", "long " * 50_000)]
    empty = pages_of(spark, [])
    whole = merkle.manifest(pages_of(spark, odd))
    assert whole.count() == len(odd)
    gone = merkle.audit(whole, merkle.manifest(empty)).collect()
    assert sorted((r.page_id for r in gone), key=repr) == sorted([1, 2, None, None, -5], key=repr)
    assert {r.status for r in gone} == {"missing"}
    less = merkle.manifest(pages_of(spark, odd[1:]))  # one of two equal records is lost
    assert [(r.page_id, r.status) for r in merkle.audit(whole, less).collect()] == [(1, "changed")]
    assert merkle.fixity_audit(empty).collect() == []


def test_fixity_matches_sql(spark, duck):
    same_rows(queries.QUERIES["op8_merkle_fixity"](spark, DATA), queries.SQL["op8_merkle_fixity"], duck)


def test_warc_round_trip(spark, tmp_path):
    pages = pages_of(spark, [*PAGES, (None, "u", "a\r\n\r\nWARC/1.1 inside"), (2000, None, None)])
    merkle.write_warc(pages, str(tmp_path / "w"), per_file=50)
    back = merkle.read_warc(spark, str(tmp_path / "w"))
    want = [(r[0], r[1] or "", r[2] or "") for r in [*PAGES, (None, "u", "a\r\n\r\nWARC/1.1 inside"), (2000, None, None)]]
    assert rows(back) == sorted(want, key=repr)
