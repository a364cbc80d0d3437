"""License scan by canonical digests.

A text is brought into a canonical form (case, punctuation, copyright lines, equivalent spellings), and the digest of
the whole form is looked up among the digests of known licences. Whole documents are looked up, and every line and every
paragraph of a document by itself, as notices stand on lines of their own. Licence texts and headers of several lines are
also looked for inside the canonical form of longer documents, however their lines are wrapped or commented out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: spellings that count as the same, in canonical words
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
    ("version 2 0", "version 2"),
    ("version 3 0", "version 3"),
    ("copyright owner", "copyright holder"),
)
COPYRIGHT_LINE = (
    r"(?m)^[\s/*#;-]*(?:copyright\s*(?:\(c\)|©|[0-9]|by\b|:)|\(c\)\s*[0-9]|©|all rights reserved)[^\n]*$"
)
NO_WORD = r"[^a-z0-9\x{80}-\x{10ffff}]+"

# fixed values: licence notices and short licences by SPDX identifier
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

# words that every known text has at least one of; a unit without them is not looked up
MARK = "licen|permi|redistribut"
# fixed values: the part of a file in license_texts that stays the same in every copy, by its first and last words
BODIES = {
    "Apache-2.0": ("1. Definitions.", "END OF TERMS AND CONDITIONS"),
    "Artistic-1.0-Perl": ("Preamble", "The End"),
    "BSL-1.0": ("Permission is hereby granted", None),
    "CC0-1.0": ("Statement of Purpose", None),
    "GFDL-1.2": ("0. PREAMBLE", "ADDENDUM: How to use"),
    "GFDL-1.3": ("0. PREAMBLE", "ADDENDUM: How to use"),
    "GPL-1.0": ("TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "GPL-2.0": ("TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": ("0. Definitions.", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.0": ("TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": ("TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0": ("This version of the GNU Lesser General Public License", None),
    "MPL-1.1": ("1. Definitions.", "EXHIBIT A"),
    "MPL-2.0": ("1. Definitions", "Exhibit A - Source Code Form License Notice"),
}
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """{0}Neither the name of {1} nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE {0} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE {1} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <{0}://unlicense.org{1}>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

{0}The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
{1}Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
{2}This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

{0}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at {0}://mozilla.org/MPL/2.0/."""
GNU_HEADER = """is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by
the Free Software Foundation{2} {3}version {4} of the License{5}"""
GNU = (
    ("GPL-1.0", "General Public License", "1"), ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"), ("LGPL-2.0", "Library General Public License", "2"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
)
SPDX = (
    "0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0",
    "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)


def _files() -> list[tuple[str, str]]:
    """Files of license_texts, and the parts of them that BODIES names."""
    out = []
    for license, (begin, end) in BODIES.items():
        text = (Path(__file__).parent / "license_texts" / f"{license}.txt").read_text()
        body = text[text.index(begin) :]
        out += [(license, text), (license, body[: body.rindex(end)] if end else body)]
    return out


def _texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of several lines each."""
    out = [("MIT", MIT), ("ISC", ISC), *_files()]
    for marks in (("", "", ""), ("1. ", "2. ", "3. "), ("a. ", "b. ", "c. ")):
        start = BSD_START.format(*marks)
        for first in ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"):
            for second in ("COPYRIGHT HOLDER", "COPYRIGHT HOLDERS"):
                end = BSD_END.format(first, second)
                out.append(("BSD-2-Clause", start + end))
                for name in ("the copyright holder", "the copyright holders"):
                    out.append(("BSD-3-Clause", start + BSD_NAMES.format(marks[2], name) + end))
        regents = start + BSD_NAMES.format(marks[2], "the University") + BSD_END.format("REGENTS", "REGENTS")
        out.append(("BSD-3-Clause", regents))
    out += [("Unlicense", UNLICENSE.format(http, end)) for http in ("http", "https") for end in ("", "/")]
    out += [("Zlib", ZLIB.format(*marks)) for marks in (("", "", ""), ("1. ", "2. ", "3. "))]
    out += [("Apache-2.0", APACHE_HEADER.format(http)) for http in ("http", "https")]
    out += [("MPL-2.0", MPL_HEADER.format(http)) for http in ("http", "https")]
    for license, name, version in GNU:
        out.append((license, GNU_HEADER.format(";", name, ";", "either ", version, ", or (at your option) any later version")))
        out.append((license, GNU_HEADER.format(";", name, ",", "", version, "")))
    return tuple(out)


def _notices() -> tuple[tuple[str, str], ...]:
    out = []
    for license in SPDX:
        out += [(license, f"SPDX-License-Identifier: {license}{end}") for end in ("", "-only", "-or-later")]
        out += [(license, f"{verb} under the {license} license.") for verb in ("Licensed", "Released")]
    return tuple(out)


# looked for inside documents; the list of the query is KNOWN, NOTICES and TEXTS, of which the SQL has KNOWN
TEXTS = _texts()
NOTICES = _notices()


def canonical(text: Column) -> Column:
    """Words of a text between single spaces, with a space at both ends."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, ""), NO_WORD, " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for spelling, standard in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {standard} "))
    return out


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]]) -> DataFrame:
    """(digest, license), one row per digest; as long as the list of known texts."""
    texts = spark.createDataFrame(list(known), "license string, text string")
    digest = F.md5(canonical(F.col("text")))
    return texts.select(digest.alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def contained(docs: DataFrame, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(doc_id, line, license) of texts that stand in a document between other words or alone; the line is null."""
    bodies = docs.sparkSession.createDataFrame(list(texts), "license string, text string")
    bodies = bodies.select("license", canonical(F.col("text")).alias("body")).distinct()
    marked = docs.where(F.col("text").rlike(f"(?i){MARK}"))
    forms = marked.select("doc_id", canonical(F.col("text")).alias("form"))
    found = forms.join(F.broadcast(bodies), F.contains("form", "body"))  # bounded by the list of known texts
    return found.select("doc_id", F.lit(None).cast("int").alias("line"), "license")


def matches(
    docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN + NOTICES, texts: Sequence[tuple[str, str]] = TEXTS
) -> DataFrame:
    """(doc_id, line, license): line 0 is the whole text, others count from 1, null is a longer run of words.

    Rows repeat as often as texts match.
    """
    listed = [*known, *texts]
    assert all(re.search(MARK, text, re.IGNORECASE) for _, text in listed), "a text without any word of MARK"
    mark = f"(?i){MARK}"
    # a one-line text is looked up as a whole and as its line, so both levels are complete
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("part")))
    # a line without words ends a paragraph; a paragraph of one line is a line
    blocks = F.filter(F.split("text", r"\n[^a-zA-Z0-9\x{80}-\x{10ffff}\n]*\n"), lambda x: F.contains(x, F.lit("\n")))
    runs = F.transform(blocks, lambda x: F.struct(F.lit(None).cast("int").alias("line"), x.alias("part")))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("part"))), lines, runs)
    units = docs.where(F.col("text").rlike(mark)).select("doc_id", F.explode(parts).alias("u"))
    units = units.where(F.col("u.part").rlike(mark))
    digests = units.select("doc_id", "u.line", F.md5(canonical(F.col("u.part"))).alias("digest"))
    table = F.broadcast(known_digests(docs.sparkSession, listed))  # bounded by the list of known texts
    found = digests.join(table, "digest").select("doc_id", "line", "license")
    return found.unionByName(contained(docs, texts))


def scanned(
    docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN + NOTICES, texts: Sequence[tuple[str, str]] = TEXTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, whole_license, license_lines (count), licenses (all, sorted, by comma).

    Null, empty and other texts without a match have null, 0 and an empty string. Rows of one id share their matches,
    counted once for each such row; rows with a null id, too. Other columns are not read.
    """
    found = (
        matches(docs, known, texts)
        .groupBy("doc_id")
        .agg(
            F.min(F.when(F.col("line") == 0, F.col("license"))).alias("whole_license"),
            F.count(F.when(F.col("line") > 0, 1)).alias("license_lines"),
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        )
        .withColumnRenamed("doc_id", "id")
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", "whole_license", F.coalesce("license_lines", F.lit(0)).cast("long").alias("license_lines"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )


def duck_canonical(text: str) -> str:
    """SQL for :func:`canonical`."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    line = COPYRIGHT_LINE.replace("'", "''")
    out = f"regexp_replace({low}, '{line}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{NO_WORD}', ' ', 'g')) || ' '"
    for spelling, standard in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {standard} ')"
    return f"({out})"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""
WITH known AS (
  SELECT md5({duck_canonical("text")}) AS digest, min(license) AS license
  FROM (VALUES {values}) AS v(license, text) GROUP BY 1),
units AS (
  SELECT doc_id, 0 AS line, text AS part FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 1, unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL),
found AS (
  SELECT doc_id, min(CASE WHEN line = 0 THEN license END) AS whole_license,
    count(CASE WHEN line > 0 THEN 1 END) AS license_lines,
    array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses
  FROM units JOIN known ON md5({duck_canonical("part")}) = digest GROUP BY doc_id)
SELECT d.doc_id, whole_license, coalesce(license_lines, 0) AS license_lines, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
"""
