"""Licence scan by canonical digests.

A text is canonical after these steps: lower case; copyright lines dropped; every run of characters other than
letters, digits and line ends becomes one space; equivalent spellings replaced. Units of a document are looked up
by the SHA-256 of their canonical form, as entire texts, in the digests of known licences and notices:

* the whole document, without title lines of licences;
* blocks between blank lines, and single lines;
* passages: wherever a document has the first ``LEAD`` words of a longer known text, as many characters as that
  text has, in whatever way they are broken into lines and paragraphs.

Known texts are a list or a table of some thousands at most (``known_files`` reads a folder of them); they are
collected once, and what is broadcast are their digests.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

# Spellings that count as equal (whole words, applied in this order).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("non commercial", "noncommercial"), ("copyright holders", "copyright owners"),
    ("v2 0", "version 2 0"), ("v3", "version 3"),
)

# Known notices and licence texts, by identifier.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)

# Title lines of licence texts (canonical).
TITLES = (
    "mit license", "the mit license", "the mit license mit", "isc license", "the isc license", "bsd 2 clause license", "bsd 3 clause license",
    "the 2 clause bsd license", "the 3 clause bsd license", "simplified bsd license", "new bsd license", "bsd zero clause license", "zlib license",
    "the zlib license", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0",
)

#: Words that a passage begins with and the least words of known texts that are looked for as passages.
LEAD, LEAST = 8, 16
#: Lines with a copyright mark and a year, a holder after the mark, or the usual closing words.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(?:copyright[ ,:]*(?:\(c\)|©|&copy;|[0-9]{4}|by |<year>|\[year\]|\[yyyy\])|\(c\) *(?:copyright *)?[0-9]{4}|©|all rights reserved)[^\n]*"
NOT_TEXT = r"[^\p{L}\p{N}\n]+"
BLANK_LINE = r"\n[ \n]*\n"


def _spelled(text: Column) -> Column:
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return text


def canonical_lines(text: Column) -> Column:
    """Canonical form with its line ends; spaces on both sides of every word and line end, so that plain replacement meets whole words."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    out = F.replace(F.regexp_replace(out, NOT_TEXT, F.lit(" ")), F.lit("\n"), F.lit(" \n "))
    return _spelled(F.concat(F.lit(" "), F.regexp_replace(out, " +", " "), F.lit(" ")))


def canonical_text(lines: Column) -> Column:
    """Canonical lines as one line without title lines, a space at both ends. Spellings may stand across line ends."""
    out = F.concat(F.lit("\n"), lines, F.lit("\n"))
    for title in TITLES:
        out = F.replace(out, F.lit(f"\n {title} \n"), F.lit("\n"))
    return _spelled(F.concat(F.lit(" "), unit(out), F.lit(" ")))


def unit(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, "[ \n]+", " "))


def digest(unit_text: Column) -> Column:
    return F.sha2(unit_text.cast("binary"), 256)


@dataclass(frozen=True)
class Known:
    license_id: str
    text: str  # canonical, on one line

    @property
    def lead(self) -> str:
        return " ".join(self.text.split(" ")[:LEAD])


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, text) of a folder of licence texts, one a file, named by its licence."""
    files = spark.read.text(folder, wholetext=True).withColumnRenamed("value", "text")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("license_id"), "text")


def canonical_known(spark: SparkSession, known) -> list[Known]:
    """Known texts (pairs, or a DataFrame with license_id and text) in canonical form; of equal ones the first identifier."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license_id string, text string")
    texts = rows.select("license_id", F.trim(canonical_text(canonical_lines(F.col("text")))).alias("text")).where("text <> ''").groupBy("text").agg(F.min("license_id").alias("license_id"))
    return [Known(r.license_id, r.text) for r in texts.orderBy("license_id", "text").collect()]


def anchors(known: list[Known]) -> list[str]:
    """Words of which every known text has at least one, as it stands in the lower-case original.

    The longest word of each text that no spelling rule produces or replaces; [''] (which every text has) if one has none.
    """
    spelled = {w for pair in SPELLINGS for side in pair for w in side.split()}
    out = set()
    for k in known:
        words = sorted(set(k.text.split(" ")) - spelled, key=lambda w: (-len(w), w))
        out.add(words[0] if words else "")
    return [""] if "" in out else sorted(out)


def license_hits(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every matching unit: doc_id, kind (whole, block, line or passage), unit (its number, from 0), license_id.

    Whole texts are looked up, however long. Null and empty texts have no units. A one-line document that
    matches is found as whole, block and line. Rows that repeat an id are looked up each; null ids stay null; an
    empty table, or no known text, gives no rows. Other columns are not read. Texts without any anchor word of a
    known text can't match in any unit and are passed over after that search; only matching digests leave the
    broadcast join.
    """
    spark = docs.sparkSession
    texts = canonical_known(spark, known)
    found = "doc_id long, kind string, unit int, license_id string"
    if not texts:
        return spark.createDataFrame([], found)
    low = F.lower(F.col(text_col))
    may = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in anchors(texts)])
    lines = docs.where(may).select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(F.col(text_col)).alias("canon"))
    lines = lines.withColumn("flat", canonical_text(F.col("canon")))
    kinds = [F.struct(F.lit(kind).alias("kind"), parts.alias("parts")) for kind, parts in (("whole", F.array("flat")), ("block", F.split("canon", BLANK_LINE)), ("line", F.split("canon", "\n")))]
    # passages: lead and length of each longer text; where the lead stands, the text may
    longer = [k for k in texts if k.text.count(" ") + 1 >= LEAST]
    if longer:
        leads = F.array(*(F.struct(F.lit(f" {k.lead} ").alias("lead"), F.lit(len(k.text)).alias("size")) for k in longer))
        here = F.filter(leads, lambda k: F.contains("flat", k["lead"]))
        nth = lambda k: F.sequence(F.lit(1), ((F.length("flat") - F.length(F.replace(F.col("flat"), k["lead"], F.lit("")))) / F.length(k["lead"])).cast("int"))
        at = lambda k, i: F.length(F.call_function("substring_index", F.col("flat"), k["lead"], i)) + 1
        cut = lambda k, i: F.when(F.substring("flat", at(k, i) + k["size"] + 1, 1) == " ", F.substring("flat", at(k, i) + 1, k["size"])).otherwise("")
        kinds.append(F.struct(F.lit("passage").alias("kind"), F.flatten(F.transform(here, lambda k: F.transform(nth(k), lambda i: cut(k, i)))).alias("parts")))
    parts = lines.select("doc_id", F.explode(F.array(*kinds)).alias("k")).select("doc_id", "k.kind", F.posexplode("k.parts").alias("unit", "body"))
    digests = parts.withColumn("body", unit(F.col("body"))).where("body <> ''").select("doc_id", "kind", "unit", digest(F.col("body")).alias("digest"))
    table_ = spark.createDataFrame([(hashlib.sha256(k.text.encode()).hexdigest(), k.license_id) for k in texts], "digest string, license_id string")
    return digests.join(F.broadcast(table_), "digest").select("doc_id", "kind", "unit", "license_id")


def license_scan(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id: doc_id, whole_license (null if the entire text is none), n_lines, n_blocks, n_passages, licenses.

    ``n_passages`` counts the licences that are found as passages; ``licenses`` lists the distinct identifiers found in
    any unit, in order and comma-joined ('' if none). Null and empty texts have none. Rows that repeat an id are added
    up into one row; null ids make one row. An empty table gives an empty result. Other columns are not read.
    """
    hits = license_hits(docs, known, id_col, text_col)
    found = hits.select("doc_id", "kind", "license_id").unionByName(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("license_id")))
    passages = F.collect_set(F.when(F.col("kind") == "passage", F.col("license_id")))
    return found.groupBy("doc_id").agg(
        F.min(F.when(F.col("kind") == "whole", F.col("license_id"))).alias("whole_license"),
        F.count(F.when(F.col("kind") == "line", True)).alias("n_lines"),
        F.count(F.when(F.col("kind") == "block", True)).alias("n_blocks"),
        F.size(passages).cast("long").alias("n_passages"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_sql() -> str:
    def spelled(x: str) -> str:
        for old, new in SPELLINGS:
            x = f"replace({x}, ' {old} ', ' {new} ')"
        return x

    def canon(x: str) -> str:
        out = rf"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT_LINE}', '\1', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
        return spelled(f"' ' || regexp_replace(replace({out}, chr(10), ' ' || chr(10) || ' '), ' +', ' ', 'g') || ' '")

    def flat(x: str) -> str:
        x = f"chr(10) || {x} || chr(10)"
        for title in TITLES:
            x = f"replace({x}, chr(10) || ' {title} ' || chr(10), chr(10))"
        return spelled(f"' ' || {unit_of.format(x)} || ' '")

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    unit_of = r"trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    return rf"""
WITH v AS (SELECT i, {canon("t")} AS canon FROM (VALUES {values}) v(i, t)),
k AS (SELECT trim({flat("canon")}) AS body, min(i) AS license_id FROM v GROUP BY 1),
c AS (SELECT doc_id, {canon("text")} AS canon FROM documents),
f AS (SELECT *, {flat("canon")} AS flat FROM c),
u AS (
  SELECT doc_id, 'whole' AS kind, flat AS part FROM f
  UNION ALL SELECT doc_id, 'block', unnest(regexp_split_to_array(canon, '
[ 
]*
')) FROM f
  UNION ALL SELECT doc_id, 'line', unnest(string_split(canon, chr(10))) FROM f
),
h AS (
  SELECT doc_id, kind, license_id FROM (SELECT doc_id, kind, {unit_of.format("part")} AS part FROM u) JOIN k ON part = body WHERE part <> ''
  UNION ALL  -- a passage is a known text of {LEAST} words or more that stands anywhere
  SELECT doc_id, 'passage', license_id FROM f JOIN (SELECT * FROM k WHERE len(string_split(body, ' ')) >= {LEAST}) ON contains(flat, ' ' || body || ' ')
)
SELECT d.doc_id, min(CASE WHEN kind = 'whole' THEN license_id END) AS whole_license,
       count(CASE WHEN kind = 'line' THEN 1 END) AS n_lines, count(CASE WHEN kind = 'block' THEN 1 END) AS n_blocks,
       count(DISTINCT CASE WHEN kind = 'passage' THEN license_id END) AS n_passages,
       coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id), '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN h ON d.doc_id IS NOT DISTINCT FROM h.doc_id
GROUP BY d.doc_id
"""
