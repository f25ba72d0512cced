"""License scan by canonical digests.

A unit of text (the whole document, a paragraph or a line) is put into a canonical form: lower
case, no copyright lines, equivalent spellings made one, punctuation and white space reduced to
single blanks. Its MD5 is looked up, by a hash join, among the digests of the known licences in
the same form: a unit matches when its entire text is a licence. The registry is a parameter; the
built-in one has the short licences as texts (also with their titles), the usual one-line notices and
the digests of the long licences, some fifty entries, so it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, table

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (licence, text): public licence texts and the usual one-line notices.
LICENSES: list[tuple[str, str]] = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\n" + _NO_WARRANTY,
    ),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", "\n\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_WARRANTY])),
    ("BSD-3-Clause", "\n\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY])),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("all-rights-reserved", "All rights reserved."),
]

#: The Unlicense's own paragraphs.
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
    "in perpetuity of all present and future rights to this software under copyright law.\n\n"
    + _NO_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
    + "\n\nFor more information, please refer to <https://unlicense.org/>"
)
LICENSES += [("Unlicense", _UNLICENSE)]

#: What stands before the text in licence files, besides copyright lines.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "All rights reserved.", "BSD 2-Clause License\n\nAll rights reserved."],
    "BSD-3-Clause": ["BSD 3-Clause License", "All rights reserved.", "BSD 3-Clause License\n\nAll rights reserved."],
}
LICENSES += [(k, f"{title}\n\n{text}") for k, text in LICENSES if "\n\n" in text for title in TITLES.get(k, [])]

# MD5 of the canonical form of whole licence texts too long to be kept here.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "ba2aea5b00c3476955dcc645b7f4a341"),  # with the appendix on how to apply it
    ("Apache-2.0", "115f337ac3e17753c432f6dfcdfa1b05"),  # up to the end of the terms
    ("Artistic-1.0", "a8b0fb0c6e43a3b36bdc159e59dbfd1e"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "8d64296097632a6da16bb912a89806d5"),
    ("GFDL-1.3", "540a05ef5d4a55c2aa4aa12d8e0ef925"),
    ("GPL-1.0", "007696355fd297f36a437fcca97929da"),
    ("GPL-2.0", "7952460f754ba446bb0d6f6e1dcb0e04"),
    ("GPL-3.0", "8a31082f3fe03b961888bf630eff7d35"),
    ("LGPL-2.0", "fd5c42bc693d3ad279cf7eb459c8d50b"),
    ("LGPL-2.1", "3f554d01f627f29bdce11767a44fd410"),
    ("LGPL-3.0", "148b473852f0e3b14ba500ebbd2e8f9c"),
    ("MPL-1.1", "5b6b8dda539aa39fb69931742bec1b7f"),
    ("MPL-2.0", "3e00e008c04aa92b30ad6a7ab2a46921"),
]

#: (pattern, one spelling) on lower-case text; valid in Java's and RE2's syntax.
SPELLINGS: list[tuple[str, str]] = [
    (r"licen[cs]e", "license"),
    (r"licen[cs]ing", "licensing"),
    (r"sub[- ]license", "sublicense"),
    (r"non[- ]infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"organisation", "organization"),
    (r"favour", "favor"),
    (r"acknowledgement", "acknowledgment"),
    (r"https:", "http:"),
    (r"copyright (owner|proprietor)", "copyright holder"),
    (r"creative commons attribution", "cc by"),
    (r"\bversion ([0-9])", "v$1"),
    (r"\bv\. ?([0-9])", "v$1"),
    (r"&", " and "),
]
#: Lines that name a holder and a year, or the rights reserved beside them, vary without meaning.
COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright *(\(c\)|©|[0-9]{4})|(\(c\)|©) *[0-9]{4})[^\n]*$"
#: Lower-case text without any of these is the same before and after the copyright lines and spellings.
_VARIED = "|".join([r"copyright|\(c\)|©", *(pattern for pattern, _ in SPELLINGS)])


def canonical(text: F.Column) -> F.Column:
    lower = F.lower(text)
    out = F.regexp_replace(lower, COPYRIGHT_LINE, " ")
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    out = F.when(lower.rlike(_VARIED), out).otherwise(lower)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def registry(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of known texts (by default the built-in ones and digests); equal digests
    keep the first id by name."""
    rows = spark.createDataFrame(LICENSES if licenses is None else licenses, "license_id string, text string")
    rows = rows.select("license_id", F.md5(canonical(F.col("text"))).alias("digest"))
    if licenses is None:
        rows = rows.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Matches of ``docs`` (doc_id, text): doc_id, license_id, scope (document, paragraph or line),
    n_units (units of the text with that licence).

    The whole text is one unit, and so is each paragraph (between blank lines) and each line; a
    text or paragraph that is one line only is counted as the larger unit. Every unit is digested,
    whatever its words and its length: a text is held three times over, as a whole, in paragraphs and in
    lines. Null and empty texts match nothing. Equal and repeated rows count as often as they
    come; rows of one doc_id are counted together. An empty table gives no rows; further columns are ignored."""
    known = registry(docs.sparkSession) if known is None else known
    filled = docs.select("doc_id", "text").where("text <> ''")
    paragraphs = F.split("text", r"\n[ \t\r]*\n")
    lines = F.split("text", "\n")
    as_units = lambda array, scope: F.transform(array, lambda u: F.struct(F.lit(scope).alias("scope"), u.alias("unit")))
    none = F.array().cast("array<struct<scope:string,unit:string>>")
    units = F.concat(
        as_units(F.array("text"), "document"),
        F.when(F.size(paragraphs) > 1, as_units(paragraphs, "paragraph")).otherwise(none),
        F.when(F.size(lines) > 1, as_units(lines, "line")).otherwise(none),
    )
    # the outer form, and a digest that is never null: else both would be worked out twice, for filters below them
    cut = filled.select("doc_id", units.alias("units")).select("doc_id", F.inline_outer("units"))
    cut = cut.withColumn("digest", F.coalesce(F.md5(canonical(F.col("unit"))), F.lit("")))
    found = cut.select("doc_id", "scope", "digest").join(broadcast_if_small(known), "digest")
    return found.groupBy("doc_id", "license_id", "scope").agg(F.count("*").alias("n_units"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(lower(unit), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
    for pattern, spelling in SPELLINGS:
        form = f"regexp_replace({form}, {quote(pattern)}, {quote(spelling.replace('$', chr(92)))}, 'g')"
    form = rf"trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    entries = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in LICENSES)
    digests = ", ".join(f"({quote(k)}, {quote(d)})" for k, d in DIGESTS)
    return rf"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, md5({form}) AS digest FROM (VALUES {entries}) AS v(license_id, unit)
    UNION ALL SELECT * FROM (VALUES {digests}) AS v(license_id, digest)) GROUP BY 1
), units AS (
  SELECT doc_id, 'document' AS scope, text AS unit FROM documents
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(string_split_regex(text, '\n[ \t\r]*\n')) FROM documents
    WHERE len(string_split_regex(text, '\n[ \t\r]*\n')) > 1
  UNION ALL
  SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))
)
SELECT doc_id, license_id, scope, count(*) AS n_units FROM (SELECT doc_id, scope, md5({form}) AS digest FROM units) u
JOIN known USING (digest) GROUP BY ALL
"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": _sql()}
