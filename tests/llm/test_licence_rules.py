import re

import pytest

from houselights.llm import licence_rules as l

MIT = """// Copyright 2011 Someone
//
// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights
// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
// copies of the Software, and to permit persons to whom the Software is
// furnished to do so, subject to the following conditions:
//
// The above copyright notice and this permission notice shall be included in all
// copies or substantial portions of the Software.
//
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
// IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
// FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
// AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
// LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
// OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
// SOFTWARE.
int main() {}
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def sentences(*names):
    first = {}
    for text, name in l.SENTENCES.items():
        first.setdefault(name, text)
    return ". ".join(first[x].capitalize() for x in names) + "."


CASES = [
    (MIT, "MIT"), (APACHE, "Apache-2.0"), ("# SPDX-License-Identifier: Apache-2.0\nx = 1", "Apache-2.0"),
    ("Some prose.\nReleased under the MIT License.\nMore prose", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("All rights reserved.\nLicensed under the MIT License!", "MIT,all-rights-reserved"),
    (sentences("BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdWarranty"), "BSD-3-Clause"),
    (sentences("BsdGrant", "BsdSource", "BsdBinary", "BsdWarranty"), "BSD-2-Clause"),
    (sentences("BsdSource", "BsdGrant", "BsdBinary", "BsdWarranty"), ""),
    (sentences("GplGrant", "Gpl2Later", "GplHope", "GplImplied", "GplSee", "GplReceived"), "GPL-2.0-or-later"),
    ("We talk about the MIT License at length.", ""), ("licence and copyright and warranty", ""), (None, ""), ("", ""),
]


def test_cases(documents):
    rows = l.scan(documents([(n, text) for n, (text, _) in enumerate(CASES)])).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == [x for _, x in CASES]
    assert rows[0].sentence_ids == "MitGrant,MitNotice,MitWarranty,MitLiability"


def test_long_wrapped_capitals(documents):
    assert l.scan(documents([(1, MIT.replace("// ", "").replace("//", ""))])).first().licences == "MIT"


def test_every_known_sentence_shows_a_sign():
    assert all(any(sign in text for sign in l.SIGNS) for text in l.SENTENCES)
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", x) for x in l.SENTENCES)
    assert {x for _, ids in l.RULES for x in ids} >= {"MitLine", "Reserved"}


def test_longer_rules_come_before_their_parts():
    for n, (_, ids) in enumerate(l.RULES):
        text = ",".join(ids)
        assert not any(",".join(before) in text for _, before in l.RULES[:n])


def test_edges(edge, nothing):
    rows = l.scan(edge).collect()
    assert len(rows) == edge.count() and all(r.n_licences == 0 and r.licences == "" for r in rows)
    assert l.scan(nothing).count() == 0


def test_plan_has_neither_python_nor_exchange(documents, capsys):
    l.scan(documents([(1, "a")])).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))
