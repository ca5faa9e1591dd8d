"""License scans: canonical digests of whole texts, looked up among those of known licences.

A text is normalised until only what licences agree on is left: case, punctuation, white space, copyright lines and
equivalent spellings don't count. Its digest is then joined to the digests of known texts, normalised alike. Whole
documents are looked up, and each of their lines as a text of its own, since notices of one line are common.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import let, table

#: Spellings that count as equal, from the left one to the right one.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("recognised", "recognized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"),
    ("http://", "https://"),
    ("v.2.0", "version 2.0"),
)
#: Lines that state a copyright: the word with a year, a sign and a name, or a place for these, or a sign and one word alone. Other lines that begin with
#: the word may be a licence's own, wrapped there.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(?:copyright[ \t:]*(?:(?:\(c\)|©)[ \t]*[^_\s]|[0-9]{4}|<|\[|\{)|\(c\)[ \t]*(?:copyright|[0-9]{4}|<|\[|\{)|©)[^\n]*$|^[ \t#*/;-]*\(c\)[ \t]+[^\s_.]+[ \t]*$"
_GAP = r"[\s#*/;-]+"
#: Notices in the known texts themselves, which wrapping may move into lines of other words.
_NOTICES = (
    r"copyright \(c\) [0-9]{4}(?:,?[\s#*/;-]*[0-9]{4})* free software foundation,? inc\.?,?",
    r"copyright \(c\) (?:<year>|19yy|19xx|year) <?name of author>?",
    r"copyright \(c\) year your name\.",
    r"copyright \(c\) the regents of the university of california\. all rights reserved\.",
    r"copyright \[yyyy\] \[name of copyright owner\]",
)
OWN_NOTICES = "|".join(_NOTICES).replace(" ", _GAP)
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Known texts by licence. Full texts with and without a title, and notices of one line; longer ones are
#: files by licence in licence_texts, as published.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _0BSD),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
) + tuple((path.stem.removesuffix("-UC"), path.read_text("utf-8")) for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), OWN_NOTICES, " "), COPYRIGHT, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """Null for texts of which nothing is left, as these would all be equal."""
    return let(canonical(text), lambda c: F.when(c != "", F.sha2(c, 256)))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, licence), each digest once: the smallest name of its licences. A fixed list, so its size has a bound."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "licence").where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, digest, licence (null: not a known text), n_licence_lines, line_licences (their
    licences, each once, in order, joined by commas; null if none).

    Null and empty texts, and texts of punctuation or copyright lines alone, have no digest. Rows that repeat a doc_id
    share what is found in lines of any of them; each row is looked up whole, however long its text is. No rows: no rows.
    Other columns aren't read. Whether known is sent to all executors or shuffled is left to its size.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    line = own.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    found = line.select("doc_id", digest(F.col("line")).alias("digest")).join(known, "digest").groupBy("doc_id")
    lines = found.agg(F.count("*").alias("n_licence_lines"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences"))
    whole = own.select("doc_id", digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    lines = lines.withColumnRenamed("doc_id", "_id")
    out = whole.join(lines, whole.doc_id.eqNullSafe(lines._id), "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("n_licence_lines", F.lit(0)).alias("n_licence_lines"), "line_licences")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), {_quoted(OWN_NOTICES)}, ' ', 'g'), {_quoted(COPYRIGHT)}, '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _digest_sql(text: str) -> str:
    return f"CASE WHEN {_canonical_sql(text)} <> '' THEN sha256({_canonical_sql(text)}) END"


OP1_SQL = f"""
WITH known AS (
  SELECT {_digest_sql("text")} AS digest, min(licence) AS licence
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)}) v(licence, text) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM (SELECT doc_id, {_digest_sql("line")} AS digest FROM line) JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {_digest_sql("coalesce(text, '')")} AS digest FROM documents)
SELECT whole.doc_id, whole.digest, known.licence, coalesce(found.n, 0) AS n_licence_lines, found.licences AS line_licences
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found ON found.doc_id IS NOT DISTINCT FROM whole.doc_id
"""
