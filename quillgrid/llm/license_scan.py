"""License scans: canonical digests of whole texts, joined with those of known licences.

A text is brought into a canonical form that ignores case, punctuation, title
and copyright lines and equivalent spellings, and is looked up by the SHA-256 of
that form. Its lines and paragraphs are looked up in the same way, which finds
notices within other text. The steps are regular expressions that Spark and
DuckDB read alike, so the same list makes the SQL that checks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as one, in canonical text (lower case, words between single spaces).
# Fixed values, after the equivalent words of the SPDX matching guidelines.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
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
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

# Licence texts and notices, fixed values. Only the wording counts, not the layout.
NOTICES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    (
        "Apache-2.0-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    ),
    (
        "MPL-2.0-header",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    *(
        (
            f"{short}-{version}.0-or-later-header",
            f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General
Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option)
any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details.
You should have received a copy of the GNU {name}General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
        )
        for short, name, version in (("GPL", "", 2), ("GPL", "", 3), ("AGPL", "Affero ", 3), ("LGPL", "Lesser ", 3))
    ),
)
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("BSD-2-Clause", _BSD + _AS_IS),
    (
        "BSD-3-Clause",
        _BSD
        + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
        + _AS_IS,
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line that only names a licence.
_TITLE = r"(^|\n)[ \t]*(the )?(0bsd|apache|boost software|bsd|isc|mit|mozilla public|zlib|gnu [a-z ]*general public)[a-z0-9 \"'.,-]*licen[cs]e( \([a-z0-9 -]+\))?[ \t]*(\r?\n|$)"
# Lines of licences that begin with the word but claim nothing; other ones with a capital after it name an owner.
_UNCLAIMED = ("Holder", "Owner", "Notice", "License", "Licence", "Law", "Statement", "Interest")
_OWNER = r"(^|\n)[ \t]*Copyright[ \t]+[A-Z][^\n]*"
# A line that claims a copyright, and the sentence that goes with it. A line of a
# licence that merely begins with the word names no year, sign or owner after it.
_COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t:]+(\(c\)|©|[0-9]{4}|by )|\(c\)|©)[^\n]*"
_RESERVED = r"all rights reserved\.?"
# Everything but letters, digits and what is beyond ASCII; typographic marks are beyond it, and named.
_MARKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+|[\x{00A0}-\x{00BF}\x{2000}-\x{206F}]+"


def _steps() -> list[tuple[str, str]]:
    words = [(f" {a} ", f" {b} ") for a, b in EQUIVALENT]
    return [(_TITLE, "\n"), (_COPYRIGHT, "\n"), (_RESERVED, " "), (_MARKS, " "), *words]


def canonical(text: Column) -> Column:
    """Canonical form of a text: canonical words between single spaces, with one at either end."""
    out = F.coalesce(text, F.lit(""))
    for word in _UNCLAIMED:
        out = F.replace(out, F.lit(f"Copyright {word}"), F.lit(f"copyright {word}"))
    out = F.translate(F.regexp_replace(out, F.lit(_OWNER), F.lit("\n")), _UPPER, _LOWER)
    for pattern, instead in _steps()[:4]:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(instead))
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), F.lit(" +"), F.lit(" "))
    for word, instead in _steps()[4:]:
        out = F.replace(out, F.lit(word), F.lit(instead))
    return out


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    out = f"coalesce({text}, '')"
    for word in _UNCLAIMED:
        out = f"replace({out}, 'Copyright {word}', 'copyright {word}')"

    def replaced(value: str, pattern: str, instead: str) -> str:
        quoted = pattern.replace("\\", "\\\\").replace("'", "''")
        return f"regexp_replace({value}, E'{quoted}', E'{instead.replace(chr(10), chr(92) + 'n')}', 'g')"

    out = f"translate({replaced(out, _OWNER, chr(10))}, '{_UPPER}', '{_LOWER}')"
    for pattern, instead in _steps()[:4]:
        out = replaced(out, pattern, instead)
    out = f"regexp_replace(' ' || {out} || ' ', ' +', ' ', 'g')"
    for word, instead in _steps()[4:]:
        out = f"replace({out}, '{word}', '{instead}')"
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*NOTICES, *TEXTS], "license_id string, text string")


# A word of the trade: lines, paragraphs and known texts without one are not looked at as parts of a text.
_SPEAKS = r"[Ll][Ii][Cc][Ee][Nn][CcSs]|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Ww][Aa][Rr][Rr][Aa][Nn][Tt]"
_BLANK = r"\n[ \t\r]*\n"


def _digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _by_digest(known: DataFrame) -> DataFrame:
    """``canonical_sha256, license_id`` of known texts with canonical words; of equal ones the smallest id."""
    rows = known.filter(F.trim(canonical(F.col("text"))) != "").select(_digest(F.col("text")).alias("canonical_sha256"), "license_id")
    return rows.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan_parts(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, part, license_id``: the lines and paragraphs of ``documents`` that are known texts, each distinct one once per row.

    Only parts and known texts that speak of a licence, permission or warranty are compared.
    """
    speaking = _by_digest(known.filter(F.col("text").rlike(_SPEAKS)))
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", _BLANK)))
    few = documents.filter(F.col("text").rlike(_SPEAKS)).select("doc_id", F.explode(F.filter(parts, lambda p: p.rlike(_SPEAKS))).alias("part"))
    return few.withColumn("canonical_sha256", _digest(F.col("part"))).join(speaking, "canonical_sha256").select("doc_id", "part", "license_id")


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, canonical_sha256, license_id, part_license_ids`` of every row of ``documents``.

    ``known`` has ``license_id`` and ``text``. ``license_id`` is NULL where the
    whole text is none of them; of known texts with one canonical form the
    smallest id counts. A text without canonical words (NULL, empty, or only a
    title or copyright line) is never a licence. ``part_license_ids`` lists the
    ids of the lines and paragraphs of rows with the same ``doc_id`` that are known texts, in
    order and joined by commas; NULL without any. Repeated rows give repeated results,
    other columns are ignored.

    Spark broadcasts the known digests if they are small by its own measure, and
    else joins by the digest, splitting frequent ones.
    """
    whole = documents.select("doc_id", _digest(F.col("text")).alias("canonical_sha256")).join(_by_digest(known), "canonical_sha256", "left")
    found = scan_parts(documents, known).groupBy("doc_id").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    found = found.select(F.col("doc_id").alias("part_doc"), F.array_join("ids", ",").alias("part_license_ids"))
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("part_doc")), "left")
    return joined.select("doc_id", "canonical_sha256", "license_id", "part_license_ids")


def scan_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in [*NOTICES, *TEXTS])
    speaks, blank = _SPEAKS, _BLANK.replace("\\", "\\\\")
    return f"""
        WITH k(license_id, text) AS (VALUES {quoted}),
        known AS (SELECT sha256({canonical_sql('text')}) AS digest, min(license_id) AS license_id FROM k GROUP BY 1),
        d AS (SELECT doc_id, sha256({canonical_sql('text')}) AS canonical_sha256 FROM documents),
        p AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, E'{blank}'))) AS part FROM documents),
        spoken AS (SELECT doc_id, sha256({canonical_sql('part')}) AS digest FROM p WHERE regexp_matches(part, '{speaks}')),
        parts AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS part_license_ids
                  FROM spoken JOIN known USING (digest) GROUP BY doc_id)
        SELECT doc_id, canonical_sha256, license_id, part_license_ids FROM d LEFT JOIN known ON digest = canonical_sha256 LEFT JOIN parts USING (doc_id)
    """
