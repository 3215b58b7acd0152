"""Licence scans by canonical digest.

A text is made canonical and its SHA-256 is looked up among those of known licences in a hash join. The
same is done for each line that could be a notice. Everything is built from SQL functions. Canonical are

* lower case, without lines that state a copyright (a year, a sign or a holder's ``by`` must follow the
  word, so wrapped lines that only begin with "copyright" stay) or reserve all rights;
* without a title: a first line of few words that ends in "license", and version and address lines after it;
* runs of anything but letters and digits as one space, so wrapping and comment signs do not count;
* one of equivalent spellings, by whole words.

The known licences are a parameter: (licence, text). The shipped ones are a short constant list, so the
broadcast has a proven bound; a longer list is joined as Spark plans it. ``DIGESTS`` holds digests of long
texts alone.

Defined results: null and empty texts, and texts that are canonically empty, match nothing (null
licence, no notices). Repeated rows each have their result. Licences with one canonical text share a
digest: the smallest id wins. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Short licences and notices as their publishers word them.
KNOWN = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <http://unlicense.org/>'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)
#: Digests of the canonical texts of longer licences as published, those of Apache and GNU also
#: without their appendix.
DIGESTS = (
    ("Apache-2.0", "97bb151359ca7824a239b0d881e1a58ad4d423d5b5c39e5c7b235fd47c1d52f7"),
    ("Apache-2.0", "fc9db7a0164e7200da89e02c3227560cc6bf5b50226261135c541f76ac8098f9"),
    ("Apache-2.0", "dd6b373e28950376ea177a601b11ba7f0238e579d5802f43e69921c313c82549"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "46df66eb30fadb738a42b19ccce2f18a583866e5837bccc790b4acff41ba12da"),
    ("GFDL-1.3", "3c426fbfcdf22792d87bb85fe1538455be3c49904a6d4c0f754f86b16154c8bf"),
    ("GPL-1.0", "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc"),
    ("GPL-1.0", "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5"),
    ("GPL-1.0", "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12"),
    ("GPL-2.0", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-2.0", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2"),
    ("GPL-2.0", "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1"),
    ("GPL-3.0", "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3"),
    ("GPL-3.0", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19"),
    ("GPL-3.0", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2"),
    ("LGPL-2.0", "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c"),
    ("LGPL-2.0", "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688"),
    ("LGPL-2.0", "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f"),
    ("LGPL-2.1", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f"),
    ("LGPL-2.1", "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4"),
    ("LGPL-2.1", "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("MPL-1.1", "34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf"),
    ("MPL-2.0", "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3"),
)
#: Spellings that count as equal, as whole words; those of two words after those of one.
EQUIVALENT = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("favour", "favor"), ("organisation", "organization"), ("honour", "honor"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"))
#: A line is looked up among the shipped licences if it has one of these; every shipped one-line notice has.
NOTICE = "licen[cs]e|permission|released under|source code form"

_OWNER = r"(?m)^[^\p{L}\p{N}\n©]*(?:(?:portions )?copyright[ \t:]*(?:©|\([cC]\)|&copy;|by\b|[\[<{(]?(?:[0-9]{4}|y{4}|year))[^\n]*|©[^\n]*|\([cC]\)[ \t]*[0-9]{4}[^\n]*|all rights reserved[.]?[ \t\r]*)$"
_TITLE = r"\A[^\p{L}\p{N}]*(?:the[ \t]+)?(?:[^\s:;]+[ \t]+){0,6}licen[cs]e(?:[ \t]*[(v0-9][^\n]{0,20})?[ \t\r]*\n\s*(\S)"
_VERSION = r"\A(?:version[ \t][0-9][^\n]{0,30}\n\s*)?(?:https?://[^\s]+[ \t\r]*\n\s*)?"


def canonical(text: Column) -> Column:
    """The canonical form (see above), words between single spaces."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, _OWNER, " ")
    out = F.regexp_replace(F.regexp_replace(out, _TITLE, "$1"), _VERSION, "")
    # Two spaces between words, so that neighbours share none.
    out = F.concat(F.lit("  "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit("  "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """The SHA-256 of the canonical text, null if that is empty."""
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def known(spark: SparkSession, licences: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(digest, licence) of known texts, and of digests of canonical texts."""
    table = spark.createDataFrame(list(licences), "licence string, text string")
    table = table.select(digest(F.col("text")).alias("digest"), "licence").where(F.col("digest").isNotNull())
    if digests:
        table = table.union(spark.createDataFrame([(d, x) for x, d in digests], "digest string, licence string"))
    return table.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, canonical_sha256, licence of the whole text, and its notices.

    ``notices`` are the distinct licences of its lines, sorted and comma-joined; ``n_notices`` counts lines.
    ``licences`` is a table as ``known`` gives it; every line is looked up in one that is not shipped.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    if licences is None:
        table = F.broadcast(known(documents.sparkSession, KNOWN, DIGESTS))
        lines = F.filter(lines, lambda x: x.rlike(f"(?i){NOTICE}"))
    else:
        table = licences
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(F.col("text")).alias("digest"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest"))))
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", units.alias("units"))
    found = rows.select("_row", "doc_id", F.explode("units").alias("u")).select("_row", "doc_id", F.col("u.whole").alias("whole"), F.col("u.digest").alias("digest")).join(table, "digest", "left")
    found = found.where(F.col("whole") | F.col("licence").isNotNull())
    out = found.groupBy("_row", "doc_id").agg(
        F.first(F.when(F.col("whole"), F.col("digest")), ignorenulls=True).alias("canonical_sha256"),  # one row of each document is whole
        F.first(F.when(F.col("whole"), F.col("licence")), ignorenulls=True).alias("licence"),
        F.count(F.when(~F.col("whole"), True)).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("notices"),
    )
    return out.drop("_row")


def _sql_canonical(text: str) -> str:
    """The canonical form over a list of words: equivalents are looked up, not replaced in the text."""
    owner, title, version = (x.replace("'", "''") for x in (_OWNER, _TITLE, _VERSION))
    out = f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{owner}', ' ', 'g'), '{title}', '\\1'), '{version}', '')"
    ones, pairs = [x for x in EQUIVALENT if " " not in x[0]], [(*a.split(), b) for a, b in EQUIVALENT if " " in a]
    single = "CASE " + " ".join(f"WHEN x = '{a}' THEN '{b}'" for a, b in ones) + " ELSE x END"
    words = f"list_transform(list_filter(string_split_regex({out}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: {single})"
    begin = " ".join(f"WHEN w[i] = '{a}' AND w[i + 1] = '{b}' THEN '{c.split()[0]}'" for a, b, c in pairs)
    end = " ".join(f"WHEN i > 1 AND w[i - 1] = '{a}' AND w[i] = '{b}' THEN {repr(c.split()[1]) if ' ' in c else 'NULL'}" for a, b, c in pairs)
    return f"(SELECT nullif(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE {begin} {end} ELSE w[i] END), lambda x: x IS NOT NULL), ' '), '') FROM (SELECT {words} AS w))"


def sql() -> str:
    """The same scan in DuckDB's SQL."""
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    digests = ", ".join(f"('{d}', '{i}')" for i, d in DIGESTS)
    return rf"""
        WITH k AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256({_sql_canonical("t")}) AS digest, i AS licence FROM (VALUES {values}) v(i, t) UNION ALL SELECT * FROM (VALUES {digests}) u(digest, licence)) GROUP BY 1),
        d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents),
        l AS (SELECT r, sha256({_sql_canonical("x")}) AS digest FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM d) WHERE regexp_matches(x, '(?i){NOTICE}')),
        n AS (SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM l JOIN k USING (digest) GROUP BY r)
        SELECT doc_id, d.digest AS canonical_sha256, k.licence, coalesce(n, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
        FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN n USING (r)"""
