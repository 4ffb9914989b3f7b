import pytest

from houselights.llm import licence_rules as l
from test_licence_rules import APACHE, MIT, sentences

GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
OFFICIAL = [
    (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"), (MPL, "MPL-2.0"),
    (BSD.format(""), "BSD-2-Clause"), (BSD.format(NAMES), "BSD-3-Clause"), (ISC, "ISC"), (MIT, "MIT"), (APACHE, "Apache-2.0"),
    ("Licensed under the Apache\nLicense, Version 2.0", "Apache-2.0"),
    ("This is free and unencumbered software released into the\nPublic Domain.", "Unlicense"),
    ("This work is licensed under a Creative\nCommons Attribution 4.0\nInternational License.", "CC-BY-4.0"),
    ("All Rights\nReserved", "all-rights-reserved"),
]


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# "])
def test_official_wraps(documents, mark):
    rows = [(n, "".join(mark + x for x in text.splitlines(True)) if "//" not in text or not mark else text)
            for n, (text, _) in enumerate(OFFICIAL)]
    got = l.scan(documents(rows)).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [x for _, x in OFFICIAL]


def test_every_known_sentence_at_every_break(documents):
    rows, want = [], []
    for text, name in l.SENTENCES.items():
        words = text.title().split()
        for at in range(1, len(words)):
            rows.append((len(rows), " ".join(words[:at]) + "\n" + " ".join(words[at:])))
            want.append(name)
    got = l.scan(documents(rows)).orderBy("doc_id").collect()
    wrong = [(rows[r.doc_id][1], r.sentence_ids) for r, name in zip(got, want) if r.sentence_ids != name]
    # A known sentence may begin with another one on a line of its own, but the whole is longer.
    assert not wrong


def test_lines_and_paragraphs_of_their_own(documents):
    texts = ["A heading\nAll rights reserved\nLicensed under the MIT License\nThe end", "All rights\n\nreserved",
             "All rights. Reserved", "We say: all rights reserved to nobody", "x\n-\n-\nAll\n-\nRights Reserved"]
    got = l.scan(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.licences for r in got] == ["MIT,all-rights-reserved", "", "", "", "all-rights-reserved"]
    assert sentences("Reserved") == "All rights reserved."
