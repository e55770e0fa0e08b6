"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to its canonical form: lower case, equivalent spellings made
one, copyright statements dropped (lines that begin with the word or sign and
have a year, a ``(c)`` or the sign, and the sentence "all rights reserved"),
everything but letters and digits as one space, and a title of ``TITLES`` at the
head cut off.  How lines are wrapped does not matter.  Its SHA-256 is looked up
in the digests of known licences, and the same is done for single lines and the
wordings of notices.  A text that begins with a copyright statement is looked up in
a second form too, in which all from there to the licence's first words is dropped
(``HEADER``: at most 600 characters: statements without a year or over several
lines), and the owner that a BSD text may name is the copyright holder.  The known digests are a fixed list of a few hundred rows,
so they are broadcast; documents are never shuffled, only the few lines found.
A line is looked up only if it has a word that every notice has.

Defined cases: null and empty texts and texts of copyright statements alone have
no licence; a text that is a whole licence has it in ``licence``; notices found
as whole lines are in ``notices``, sorted and distinct, the empty string if none;
repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import KEY, keyed

# Texts of well-known short licences, and names with identifiers.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
WHOLE = {
    "MIT": _GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "MIT-0": _GRANT + ". " + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AUTHOR,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD3 + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
}
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"], "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "AGPL-3.0": ["GNU Affero General Public License, version 3"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0 1.0"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"], "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
PHRASES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This file is licensed under the {}", "This software is licensed under the {}", "License: {}")
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("organisation", "organization"), ("https://", "http://"), ("merchantibility", "merchantability"))
# Digests of the canonical full texts, title included, as published by their stewards.
FULL = {
    "0be25ae8b112b6c47bf696a745855eebba678079747ad8bbf877d928555027f1": "Apache-2.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61": "MPL-1.1",
    "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56": "MPL-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d": "CC-BY-SA-4.0",
}
# Canonical titles of the licences, which stand above their texts in files.
TITLES = ("mit license", "the mit license", "the mit license mit", "mit no attribution", "isc license", "the isc license", "bsd zero clause license", "zero clause bsd", "bsd 2 clause license", "the bsd 2 clause license", "simplified bsd license", "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "zlib license", "the zlib license")
#: Lines of copyright statements, and the sentence that often follows them.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[0-9]{4})[^\n]*$|^[^a-z0-9\n]*(?:\(c\)|©)[^\n]*$"
RESERVED = r"all rights reserved\.?"
# First words of the licences that are written out.
OPENINGS = ("permission is hereby granted free of charge", "permission to use copy modify and or distribute", "redistribution and use in source and binary forms", "this software is provided as is without any express", "licensed under the apache license version 2 0")
#: In canonical words: a title, if any, a copyright statement, and what follows up to a licence's first words.
HEADER = rf"^(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))}) )?(?:copyright|c|portions copyright|[0-9]{{4}}) .{{0,600}}?({'|'.join(OPENINGS)})"
#: The owner that the third clause of a BSD text names.
OWNER = r"neither the names? of .{1,200}? nor the names of (?:its|their) contributors"
HOLDER = "neither the name of the copyright holder nor the names of its contributors"
#: What a text with such a statement has near its beginning.
STATED = ("copyright", "(c)", "©")
#: Words of which every notice has one.
MARKS = ("under", "license")


def notices() -> list[tuple[str, str]]:
    """(licence, line) of the notices, from names and phrases."""
    rows = [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    return rows + [(k, f"SPDX-License-Identifier: {k}") for k in NAMES]


def plain(text: Column) -> Column:
    """Lower case with one spelling of each word."""
    low = F.lower(text)
    for old, new in SPELLINGS:
        low = F.replace(low, F.lit(old), F.lit(new))
    return low


def words(low: Column) -> Column:
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def canonical(low: Column) -> Column:
    """The canonical form of a text in plain spelling."""
    whole = words(F.regexp_replace(F.regexp_replace(low, COPYRIGHT, ""), RESERVED, ""))
    return F.regexp_replace(whole, rf"^(?:{'|'.join(sorted(TITLES, key=len, reverse=True))}) ", "")


def headless(low: Column) -> Column:
    """The second form of a text in plain spelling: without a header of copyright statements, owners as a slot; null if there is no statement near the beginning."""
    begin = F.substring(low, 1, 400)
    whole = F.regexp_replace(words(F.regexp_replace(low, RESERVED, "")), HEADER, "$1")
    return F.when(reduce(lambda a, b: a | b, [F.contains(begin, F.lit(m)) for m in STATED]), F.regexp_replace(whole, OWNER, HOLDER))


def _known(spark: SparkSession, rows: list[tuple[str, str]], form) -> DataFrame:
    frame = spark.createDataFrame(rows, "licence string, known string")
    return frame.select("licence", F.sha2(form(plain(F.col("known"))), 256).alias("digest"))


def _texts(spark: SparkSession) -> DataFrame:
    """Digests of whole texts: those written out here, and ``FULL``."""
    full = spark.createDataFrame(list(FULL.items()), "digest string, licence string").select("licence", "digest")
    return F.broadcast(_known(spark, list(WHOLE.items()), canonical).unionByName(full).groupBy("digest").agg(F.min("licence").alias("licence")))


def _notices(spark: SparkSession) -> DataFrame:
    return F.broadcast(_known(spark, notices(), words).groupBy("digest").agg(F.min("licence").alias("licence")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the canonical text, licence (null if none), notices and n_notices of every document."""
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col).select("doc_id", *KEY, plain(F.col("text")).alias("low"))
    marked = lambda text: reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in MARKS])
    lines = docs.where(marked(F.col("low"))).select(*KEY, F.explode(F.filter(F.split("low", "\n"), marked)).alias("line"))
    found = (
        lines.select(*KEY, F.sha2(words(F.col("line")), 256).alias("digest")).join(_notices(spark), "digest")
        .groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"), F.countDistinct("licence").alias("n_notices"))
    )
    texts = _texts(spark)
    second = texts.select(F.col("digest").alias("headless"), F.col("licence").alias("second"))
    whole = docs.select("doc_id", *KEY, F.sha2(canonical(F.col("low")), 256).alias("digest"), F.sha2(headless(F.col("low")), 256).alias("headless"))
    whole = whole.join(texts, "digest", "left").join(F.broadcast(second), "headless", "left").withColumn("licence", F.coalesce("licence", "second"))
    return whole.join(found, KEY, "left").select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql_plain(column: str) -> str:
    low = f"lower({column})"
    for old, new in SPELLINGS:
        low = f"replace({low}, '{old}', '{new}')"
    return low


def oracle_sql() -> str:
    """The same scan over ``documents`` for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in rows)
    words_of = lambda c: f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"
    titles = "|".join(sorted(TITLES, key=len, reverse=True))
    form = lambda c: f"regexp_replace({words_of(f"regexp_replace(regexp_replace({c}, '{COPYRIGHT}', '', 'g'), '{RESERVED}', '', 'g')")}, '^(?:{titles}) ', '')"
    headless_of = lambda c: f"regexp_replace(regexp_replace({words_of(f"regexp_replace({c}, '{RESERVED}', '', 'g')")}, '{HEADER}', '\\1'), '{OWNER}', '{HOLDER}', 'g')"
    stated = " OR ".join(f"contains(substring(low, 1, 400), '{m}')" for m in STATED)
    return f"""
WITH texts AS (SELECT min(licence) AS licence, digest FROM (SELECT licence, sha256({form(_sql_plain('known'))}) AS digest FROM (VALUES {values(WHOLE.items())}) v(licence, known) UNION ALL SELECT * FROM (VALUES {values((v, k) for k, v in FULL.items())}) f(licence, digest)) GROUP BY digest),
marks AS (SELECT min(licence) AS licence, digest FROM (SELECT licence, sha256({words_of(_sql_plain('known'))}) AS digest FROM (VALUES {values(notices())}) v(licence, known)) GROUP BY digest),
low AS (SELECT doc_id, {_sql_plain("coalesce(text, '')")} AS low FROM documents),
hits AS (SELECT doc_id, sha256({words_of('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM low)),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(DISTINCT licence) AS n_notices FROM hits JOIN marks USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({form('low')}) AS digest, CASE WHEN {stated} THEN sha256({headless_of('low')}) END AS headless FROM low)
SELECT w.doc_id, w.digest, coalesce(t.licence, s.licence) AS licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
FROM whole w LEFT JOIN texts t ON t.digest = w.digest LEFT JOIN texts s ON s.digest = w.headless LEFT JOIN found f ON f.doc_id = w.doc_id"""
