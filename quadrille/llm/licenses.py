"""Licence scans by canonical digests, in DataFrame functions alone.

Lines that state a copyright are taken out, texts are brought to a canonical form (case, punctuation, equivalent spellings) and
hashed; the digests of known licences, made in the same way, are hash-joined to them. What is looked up
is always an entire text: the whole document, each of its paragraphs (between empty lines) and each of its lines.
Texts whose first two words begin no known licence are left out before their digest is made, by a hash join too.

Defined results: null and empty texts match nothing; a text that is nothing but copyright lines has an empty
canonical form and matches nothing; equal canonical forms of several known licences all match; known rows whose id
or text is null, or whose canonical form is empty, are left out; repeated rows give repeated rows; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching guidelines treat as equal, as whole words after lower-casing.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]


def _no_word_of(words: list[str], first: str) -> str:
    """A pattern, without look-ahead (RE2 has none), for the start of a word with a letter of the class `first` that is none of `words`."""

    def beyond(prefix: str) -> str:
        following = sorted({w[len(prefix)] for w in words if w.startswith(prefix) and w != prefix})
        either = lambda c: f"[{c}{c.upper()}]"
        longer = [either(c) + beyond(prefix + c) for c in following]
        letters = "".join(c + c.upper() for c in following)
        if prefix in words:  # the word itself is out, a longer one isn't
            other = "[" + "".join(c for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in letters) + "]"
        else:
            other = rf"[^{letters}\n]"
        return "(" + "|".join([other, *longer]) + ")"

    starts = sorted({w[0] for w in words})
    others = "".join(c for c in first if c.lower() not in starts)
    return "(" + "|".join([rf"[{others}]|[^\x00-\x7F©“”‘’–—…«»]", *(c.upper() + beyond(c) for c in starts)]) + ")"


#: Words after "copyright" or "(c)" by which a licence speaks of copyrights, or lists conditions, rather than names a holder.
_NOT_HOLDERS = "notice notices holder holders owner owners law laws license licenses licence licences statement statements interest interests infringement protection rights and or in to of for on is are as if any all each this you your we under with from by".split()
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[ \t,:;.*–—-]*"
_SIGN = r"(\([cC]\)|©|&[cC][oO][pP][yY];)"
_YEAR = r"([0-9]|[\[<{]|19yy|YEAR)"
_HOLDER = _no_word_of(_NOT_HOLDERS, _CAPITALS)
#: A line that states a copyright (with the sign, a year or a holder), or that all rights are reserved, with the line break before it.
COPYRIGHT = (
    r"(^|\n)[^0-9a-zA-Z\n©]*("
    rf"[cC][oO][pP][yY][rR][iI][gG][hH][tT]{_GAP}({_SIGN}|{_YEAR}|[bB][yY][ \t])"
    rf"|[cC]opyright[ \t,:]+{_HOLDER}"
    rf"|COPYRIGHT[ \t,:]+{_no_word_of([*_NOT_HOLDERS, 'the'], _CAPITALS)}"
    rf"|©|\([cC]\){_GAP}([cC][oO][pP][yY][rR][iI][gG][hH][tT]|{_YEAR}|{_HOLDER})"
    r"|[aA][lL][lL] [rR][iI][gG][hH][tT][sS] [rR][eE][sS][eE][rR][vV][eE][dD])[^\n]*"
)
#: Characters between words, and the first two words of a text (the second may be missing).
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F©“”‘’–—…«»"
HEAD = rf"^[{BETWEEN}]*+([^{BETWEEN}]++)[{BETWEEN}]*+([^{BETWEEN}]*+)"
#: Digests of known licences are broadcast up to so many rows; a longer list is joined by a shuffle.
BROADCAST_ROWS = 100_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """

3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _entire(name: str) -> str:
    return (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")


def _bsd() -> list[tuple[str, str]]:
    """The texts with two and three conditions, numbered or not, with the usual titles and fillings."""
    out = []
    for kind, names in (("BSD-2-Clause", [None]), ("BSD-3-Clause", ["the copyright holder", "the University", "the author", "the organization", "<organization>", "the <organization>"])):
        n, word = kind[4], "Simplified" if kind == "BSD-2-Clause" else "New"
        titles = ["", "BSD License", "The BSD License", f"BSD {n}-Clause License", f"The BSD {n}-Clause License", f"BSD {n}-Clause ({word}) License", f"{n}-Clause BSD License", f"The {n}-Clause BSD License"]
        for name in names:
            for holder in ("HOLDER", "OWNER"):
                text = _BSD_2 + (_BSD_3.format(name) if name else "") + _BSD_WARRANTY.format(holder)
                for body in (text, re.sub(r"(?m)^[0-9]\. ", "* ", text)):
                    out += [(kind, f"{title}\n\n{body}") for title in titles]
    return [*out, ("BSD-3-Clause", _entire("BSD"))]


def _entire_texts() -> list[tuple[str, str]]:
    """Licences as published, with and without their appendix, with links as http and https; one text may stand for two ids."""
    out = []
    for ids, name, end in [
        (["Apache-2.0"], "Apache-2.0", "END OF TERMS AND CONDITIONS"),
        (["GPL-2.0-only", "GPL-2.0-or-later"], "GPL-2", "END OF TERMS AND CONDITIONS"),
        (["GPL-3.0-only", "GPL-3.0-or-later"], "GPL-3", "END OF TERMS AND CONDITIONS"),
        (["LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-2.1", "END OF TERMS AND CONDITIONS"),
        (["LGPL-3.0-only", "LGPL-3.0-or-later"], "LGPL-3", None),
        (["MPL-2.0"], "MPL-2.0", "Exhibit A - Source Code Form License Notice"),
        (["CC0-1.0"], "CC0-1.0", None),
        (["Unlicense"], "Unlicense", "For more information, please refer to"),
    ]:
        text = _entire(name)
        texts = [text, text.replace("https://", "http://"), text.replace("http://", "https://"), text.replace("https://", "http://").replace("licenses/why-not-lgpl", "philosophy/why-not-lgpl")]
        if end:
            terms = text[: text.index(end)].rstrip(" \n-")
            texts += [terms, f"{terms}\n\n{end}"] if end.startswith("END") else [terms]
        if name == "CC0-1.0":
            texts += [text.partition("\n")[2]]
        out += [(i, t) for t in dict.fromkeys(texts) for i in ids]
    return out


def _gnu_notices() -> list[tuple[str, str]]:
    """The first paragraph of the notices that the GNU licences propose for source files."""
    out = []
    for short, name, versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
        for what in ("program", "library", "software", "file"):
            for v in versions:
                for comma in (":", ";"):
                    start = f"This {what} is free software{comma} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
                    spdx = f"{short}-{v if '.' in v else v + '.0'}"
                    out += [(f"{spdx}-or-later", f"{start}{sep} either version {v} of the License, or (at your option) any later version.") for sep in (",", ";")]
                    out += [(f"{spdx}-only", f"{start}, version {v} of the License."), (f"{spdx}-only", f"{start}, version {v}."), (f"{spdx}-only", f"{start}; version {v} of the License.")]
    return list(dict.fromkeys(out))


#: Fixed values: (licence id, entire text of the licence or of a notice that names it).
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    *((x, f"SPDX-License-Identifier: {x}") for x in "GPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later".split()),
    *_bsd(),
    *_entire_texts(),
    *_gnu_notices(),
]


def without_copyright(text: Column) -> Column:
    return F.regexp_replace(text, COPYRIGHT, "")


def canonical(text: Column) -> Column:
    """Lower case, words of letters and digits with one space between, one spelling each."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), f"[{BETWEEN}]+", "  "), F.lit(" "))
    text = reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, text)
    return F.trim(F.regexp_replace(text, " +", " "))


def digest(text: Column) -> Column:
    """Hex SHA-256 of the canonical form. Never null: a join on it then needs no filter, which would be made of all texts."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def _variants(word: Column) -> Column:
    """All spellings of a canonical word."""
    return F.array_distinct(F.concat(F.array(word), *(F.when(word == b, F.array(F.lit(a))).otherwise(F.array().cast("array<string>")) for a, b in SPELLINGS)))


def known_licenses(spark: SparkSession, rows: list[tuple[str, str]] = KNOWN) -> DataFrame:
    return spark.createDataFrame(rows, "license string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, whole (ids that match the entire document), licenses (sorted ids that match it or a part),
    n_notices (matching parts; the whole document, a paragraph and a line at different places each count)."""
    known = known_licenses(docs.sparkSession) if known is None else known.select("license", "text")
    forms = known.filter(F.col("license").isNotNull()).select("license", canonical(without_copyright(F.col("text"))).alias("form")).filter("form <> ''")
    forms = forms.select("license", F.sha2("form", 256).alias("digest"), F.substring_index("form", " ", 1).alias("w1"), F.substring_index(F.substring_index("form", " ", 2), " ", -1).alias("w2"), F.contains("form", F.lit(" ")).alias("two")).distinct()
    digests = forms.select("license", "digest").distinct()
    # a text whose first two words begin no known licence, in any spelling, can't match: its digest needn't be made
    heads = forms.select(F.explode(_variants(F.col("w1"))).alias("w1"), F.when(F.col("two"), F.col("w2")).otherwise("").alias("w2")).select("w1", F.explode(_variants(F.col("w2"))).alias("w2")).distinct()
    if known.count() <= BROADCAST_ROWS:
        digests, heads = F.broadcast(digests), F.broadcast(heads)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("h"))
    part = lambda kind, at, text: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), text.alias("text"))
    none = F.array().cast("array<string>")
    units = F.concat(
        F.array(part(0, F.lit(0), F.col("body"))),
        F.transform(F.when(F.col("body").rlike(r"\n[ \t\r]*+\n"), F.split("body", r"\n[ \t\r]*+\n")).otherwise(none), lambda x, i: part(1, i, x)),
        F.transform(F.when(F.col("body").contains("\n"), F.split("body", "\n")).otherwise(none), lambda x, i: part(2, i, x)),
    )
    head = lambda k: F.lower(F.regexp_extract("u.text", HEAD, k))
    found = (
        rows.filter(F.col("text").isNotNull())
        .select("doc_id", "h", without_copyright(F.col("text")).alias("body"))
        .select("doc_id", "h", F.explode(units).alias("u"))
        .select("doc_id", "h", "u", head(1).alias("w1"), head(2).alias("w2"))
        .join(heads, ["w1", "w2"], "left_semi")
        .select("doc_id", "h", "u.kind", "u.at", digest(F.col("u.text")).alias("digest"))
        .join(digests, "digest")
        .groupBy("doc_id", "h")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("kind") == 0, F.col("license")))).alias("whole"),
            F.array_sort(F.collect_set("license")).alias("licenses"),
            F.size(F.collect_set(F.struct("kind", "at"))).cast("long").alias("n_notices"),
        )
    )
    rows, found = rows.select("doc_id", "h").alias("r"), found.alias("f")
    return rows.join(found, F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.h") == F.col("f.h")), "left").select("r.doc_id", F.coalesce("f.whole", none).alias("whole"), F.coalesce("f.licenses", none).alias("licenses"), F.coalesce("f.n_notices", F.lit(0)).cast("long").alias("n_notices"))


def oracle_sql() -> str:
    """The query's rows in DuckDB: whole and licenses joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    body = lambda x: f"regexp_replace({x}, {quote(COPYRIGHT)}, '', 'g')"

    def canon(x: str) -> str:
        x = f"' ' || regexp_replace(lower({x}), {quote(f'[{BETWEEN}]+')}, '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
WITH known(license, text) AS (VALUES {values}),
digests AS (SELECT DISTINCT license, c FROM (SELECT license, {canon(body('text'))} AS c FROM known) WHERE c <> ''),
docs AS (SELECT row_number() OVER () AS rn, doc_id, {body('text')} AS text FROM documents),
units AS (
  SELECT rn, 0 AS kind, 0 AS pos, text AS u FROM docs
  UNION ALL SELECT rn, 1, pos, u FROM (SELECT rn, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS u, generate_subscripts(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), 1) AS pos FROM docs WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n'))
  UNION ALL SELECT rn, 2, pos, u FROM (SELECT rn, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs WHERE contains(text, chr(10)))
),
found AS (SELECT rn, kind, pos, license FROM (SELECT rn, kind, pos, {canon('u')} AS c FROM units) JOIN digests USING (c)),
per AS (
  SELECT rn, coalesce(string_agg(DISTINCT CASE WHEN kind = 0 THEN license END, ',' ORDER BY CASE WHEN kind = 0 THEN license END), '') AS whole,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT kind::VARCHAR || ':' || pos::VARCHAR) AS n_notices
  FROM found GROUP BY rn
)
SELECT doc_id, coalesce(whole, '') AS whole, coalesce(licenses, '') AS licenses, coalesce(n_notices, 0) AS n_notices FROM docs LEFT JOIN per USING (rn)
"""
