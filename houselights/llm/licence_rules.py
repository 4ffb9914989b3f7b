"""Licence scan by sentence rules, with DataFrame functions only.

A text is unwrapped (comment marks off) and normalised to small ASCII letters, digits and single blanks, with marks where
sentences and lines end. A known licence sentence may go on over any ends of lines and semicolons inside a paragraph, and it
must begin and end at a mark. Known sentences get their identifiers, other text vanishes, and the ordered rules are matched against the identifier sequence: each rule takes its matches out before the next
one looks. Everything happens inside the row: no exchange, no join, and a document with many sentences stays one row.

Texts without any word that all known sentences share a choice of (`SIGNS`) are not cut at all; this changes no result.

Defined results: null and empty texts have no identifiers and no licences; repeated documents get one row each; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licences and notices, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheLine",
    "licensed under the apache license version 2 0 the license": "ApacheGrant",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopyUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
    "an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitLine",
    "licensed under the mit license": "MitLine",
    "this project is licensed under the mit license": "MitLine",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software": "MitLiability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission": "BsdNames",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed": "BsdWarranty",
    "this work is licensed under the gnu general public license version 3": "Gpl3Line",
    "this work is licensed under the gnu general public license version 2": "Gpl2Line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "Gpl3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "GplGrant",
    "either version 2 of the license or at your option any later version": "Gpl2Later",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplHope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GplImplied",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "this source code form is subject to the terms of the mozilla public license v": "MplTerms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MplCopy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this is free and unencumbered software released into the public domain": "Unencumbered",
    "licensed under cc by 4 0": "CcByLine",
    "licensed under cc by sa 4 0": "CcBySaLine",
    "licensed under cc by nc 4 0": "CcByNcLine",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcByLine",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySaLine",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNcLine",
    "spdx license identifier mit": "MitLine",
    "spdx license identifier apache 2 0": "ApacheLine",
    "spdx license identifier gpl 3 0 only": "Gpl3Line",
    "spdx license identifier gpl 2 0 only": "Gpl2Line",
    "spdx license identifier bsd 3 clause": "Bsd3Line",
    "spdx license identifier mpl 2 0": "MplLine",
    "all rights reserved": "Reserved",
}

#: Licences and the identifier sequences that stand for them; the first match takes its identifiers.
RULES = (
    ("Apache-2.0", ("ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheUrl", "ApacheWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheGrant", "ApacheUse", "ApacheCopyUrl", "ApacheWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheGrant", "ApacheUse")),
    ("Apache-2.0", ("ApacheLine",)),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty", "MitLiability")),
    ("MIT", ("MitLine",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdWarranty")),
    ("BSD-3-Clause", ("Bsd3Line",)),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdWarranty")),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplHope", "GplImplied", "GplSee", "GplReceived")),
    ("GPL-3.0-or-later", ("Gpl3Grant",)),
    ("GPL-2.0-or-later", ("GplGrant", "Gpl2Later", "GplHope", "GplImplied", "GplSee", "GplReceived")),
    ("GPL-2.0-or-later", ("GplGrant", "Gpl2Later")),
    ("GPL-3.0-only", ("Gpl3Line",)),
    ("GPL-2.0-only", ("Gpl2Line",)),
    ("MPL-2.0", ("MplTerms", "MplCopy")),
    ("MPL-2.0", ("MplLine",)),
    ("ISC", ("IscGrant", "MitWarranty")),
    ("ISC", ("IscGrant",)),
    ("Unlicense", ("Unencumbered",)),
    ("CC-BY-NC-4.0", ("CcByNcLine",)),
    ("CC-BY-SA-4.0", ("CcBySaLine",)),
    ("CC-BY-4.0", ("CcByLine",)),
    ("all-rights-reserved", ("Reserved",)),
)

#: Each known sentence holds one of these.
SIGNS = ("licen", "copyright", "warrant", "permission", "redistribut", "reserved", "unencumbered", "mpl")

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (pattern, replacement), one after the other. The SQL statement cuts sentences by all of them and then at line feeds, so it
# misses those that go on over other ends of lines.
_UNWRAP = (
    (r"\r\n?", "\n"),
    (r"(^|\n)[ \t]*(//+|#+|[*]+|--+|;+)[ \t]*", "\n"),
    (r"(SPDX-License-Identifier:[^\n]*)", "$1."),
    (r"([^.;!?\n])[ \t]*\n[ \t]*([a-z])", "$1 $2"),
    (r"([A-Z][A-Z],?)[ \t]*\n[ \t]*([A-Z][A-Z])", "$1 $2"),
    (r"([.;!?])[ \t\n]+", "$1\n"),
)


# Marks in a normalised text: a blank line or a full stop ends a sentence; a sentence may go on over other ends of lines.
_END, _BREAK = "\x01", "\x02"
_GAP = f"[ {_BREAK}]+"
#: Any known sentence that fills the space between two marks, the longest first.
_KNOWN = f"(?<=[{_END}{_BREAK}])(?:" + "|".join(
    x.replace(" ", _GAP) for x in sorted(SENTENCES, key=len, reverse=True)) + f")(?=[{_END}{_BREAK}])"


def marked(text: Column) -> Column:
    """A text in small ASCII letters, digits, single blanks and marks."""
    text = F.translate(text, _END + _BREAK, "  ")
    for pattern, replacement in _UNWRAP[:-1]:
        text = F.regexp_replace(text, pattern, replacement)
    text = F.regexp_replace(text, r"[.!?][ \t\n]+|\n[ \t]*(?=\n)", _END)
    text = F.translate(F.regexp_replace(text, r";[ \t\n]+|\n", _BREAK), _CAPITALS, _SMALL)
    text = F.concat(F.lit(_END), F.regexp_replace(text, f"[^a-z0-9{_END}{_BREAK}]+", " "), F.lit(_END))
    return F.regexp_replace(text, f" ?([{_END}{_BREAK}]) ?", "$1")


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    signs = F.lit(False)
    for sign in SIGNS:
        signs = signs | F.translate(text, _CAPITALS, _SMALL).contains(sign)
    found = F.transform(F.regexp_extract_all(marked(text), F.lit(_KNOWN), F.lit(0)),
                        lambda x: F.try_element_at(known, F.regexp_replace(x, _GAP, " ")))
    return F.coalesce(F.when(signs, found), F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids (comma-joined, in order), n_licences and licences (comma-joined, sorted)."""
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), identifiers(F.col("text")).alias("ids"))
    out = out.withColumn("rest", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    taken = []
    for n, (licence, sequence) in enumerate(RULES):
        own = "".join(f"<{x}>" for x in sequence)
        taken.append(f"rule{n}")
        out = out.withColumns({
            f"rule{n}": F.when(F.col("rest").contains(own), F.lit(licence)),
            "rest": F.replace(F.col("rest"), F.lit(own), F.lit(""))})
    licences = F.array_sort(F.array_distinct(F.array_compact(F.array(*taken))))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_known"),
                      F.array_join("ids", ",").alias("sentence_ids"), F.size(licences).cast("bigint").alias("n_licences"),
                      F.array_join(licences, ",").alias("licences"))


def _oracle() -> str:
    quoted = [f"'{k}': '{v}'" for k, v in SENTENCES.items()]
    text = "text"
    for pattern, replacement in _UNWRAP:
        escaped = (pattern.replace("\n", "\\n"), replacement.replace("\n", "' || chr(10) || '").replace("$", "\\"))
        text = f"regexp_replace({text}, '{escaped[0]}', '{escaped[1]}', 'g')"
    steps, last = [], "marked"
    for n, (_, sequence) in enumerate(RULES):
        own = "".join(f"<{x}>" for x in sequence)
        steps.append(f"r{n} AS (SELECT * EXCLUDE (rest), contains(rest, '{own}') AS rule{n}, replace(rest, '{own}', '') AS rest "
                     f"FROM {last})")
        last = f"r{n}"
    licences = "list_sort(list_distinct(list_filter([" + ", ".join(
        f"CASE WHEN rule{n} THEN '{licence}' END" for n, (licence, _) in enumerate(RULES)) + "], lambda x: x IS NOT NULL)))"
    return f"""
WITH known AS (SELECT MAP {{{', '.join(quoted)}}} AS m),
cut AS (
  SELECT doc_id, list_transform(string_split(translate({text}, '{_CAPITALS}', '{_SMALL}'), chr(10)),
    lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS s FROM documents
), named AS (
  SELECT doc_id, coalesce(list_filter(list_transform(s, lambda x: m[x]), lambda x: x IS NOT NULL), []) AS ids FROM cut, known
), marked AS (
  SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS rest FROM named
), {', '.join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids,
  len({licences})::BIGINT AS n_licences, array_to_string({licences}, ',') AS licences
FROM {last}
"""


ORACLE_SQL = _oracle()
