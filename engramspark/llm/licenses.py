"""Licence scans by canonical digest, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ship

#: Known texts at most: the bound on what is broadcast.
MOST_KNOWN = 10_000

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."

#: (id, text) of whole licences and of the notices by which texts name one.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", _MIT),
    ("ISC", "ISC License\n" + _ISC + _NO_WARRANTY), ("ISC", _ISC + _NO_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TWO + _BSD_TAIL), ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", "zlib License\n" + _ZLIB), ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE), ("GPL-3.0-or-later", _GPL), ("MPL-2.0", _MPL),
    *((name, f"{verb} under the {title}.") for name, title in (("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("GPL-3.0-only", "GNU General Public License, version 3"), ("GPL-2.0-only", "GNU General Public License, version 2"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"))
      for verb in ("Licensed", "Released", "Distributed", "This work is licensed", "This software is licensed", "This project is licensed")),
    *((f"CC-{kind.replace(' ', '-')}-4.0", f"{verb} under CC {kind} 4.0.") for kind in ("BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND") for verb in ("Licensed", "Released", "This work is licensed")),
]

#: SHA-256 of the canonical form of whole licences that are too long to stand here, as their publishers write them: with everything
#: after the terms, and without the instructions that follow the terms.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "7dc0ccfedfe9cf9e59c97a3e43eea7b035a0e7a7be84d714acef36eb5c9fb4bc"),
    ("Apache-2.0", "ac68c71d53e621b3beea1252644799f10f9c4712422f05798ef36f47219e5ad1"),
    ("Apache-2.0", "4f14b6cbdd362d5a6d1023eaee7538d57a6c9271c5e1de4bdc60e02a182c0730"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "7843068060f4d9ee30736221ce49abf6cb7dafa9b775fabb47fbf0c21e05b102"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "8eb68a3bb5fc0c6b23dd0a427ecd4ec28af872ca452a9f03b3e2fb9d7cee562a"),
    ("GFDL-1.2", "925dba96dda1b00cd8ff146661df40b6b2a302af5bf2f1243976eddb6d5a8450"),
    ("GFDL-1.3", "43d218bf9431bc9e8914f6bb2e4c3dc99da407a32596213a1afda7550fdc0e19"),
    ("GFDL-1.3", "0cb0736777286efc71748df95c0748e42cbf34246d31f42e488fded6114061ce"),
    ("Artistic-1.0-Perl", "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
]

#: Copyright lines say who or when; "copyright notice", "copyright holders" and a list's "(c)" do not. Text in as it is written.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;-]*("
    r"(?i:copyright)[ \t:,]*(?i:\(c\)|©)[^\n]*"  # Copyright (c) ...
    r"|(?i:copyright)[ \t:,]*(?i:by[ \t]|[0-9]{4}|<|\[)[^\n]*"  # Copyright 2020, Copyright by, Copyright <year>
    r"|Copyright[ \t:,]+\p{Lu}[\p{Ll}'.-][^\n]*"  # Copyright Somebody
    r"|(?i:\(c\)|©)[ \t]*(?i:copyright)?[ \t]*([0-9]{4}|<|\[)[^\n]*)"  # (c) 2020
)
#: Lower-cased text in, in this order: (pattern, replacement).
STEPS = [
    ("(^|\\n)[ \\t*#/;-]*all rights reserved[ \\t.]*", "\n"),
    ("licence", "license"),
    ("(sub|re)[- ]license", "$1license"),
    ("non[- ]infringement", "noninfringement"),
    ("(author|organ|recogn)is(e|ed|ation)", "$1iz$2"),
    ("acknowledgement", "acknowledgment"),
    ("http://", "https://"),
    ("&", " and "),
    ("[^\\p{L}\\p{N}]+", " "),
]
#: Each text of KNOWN and DIGESTS has one of these in canonical form, and no step makes or joins them, so a text without them in lower case is none.
HINT = r"licen|permi|(^|[^\p{L}\p{N}])cc([^\p{L}\p{N}]|$)"


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "\n"))
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, license_id, notices, n_notices: a row for each row of docs.

    license_id is the licence whose known text equals the whole text, in canonical form: lower case, without copyright
    lines, with equivalent spellings made one, and with runs of anything but letters and digits as one blank; null if none does. notices has the distinct ids of the
    text's lines that equal a known text, sorted and comma-joined, n_notices the number of such lines. Digests of equal canonical texts are equal; of two known ids with one text the
    smaller holds. known has (id, text) and digests (id, SHA-256 of a canonical text), both the caller's if either is given. Null or empty
    text: no licence, no notices. Null doc_id and repeated rows are carried. Empty table: no rows. Other columns are ignored.

    Whole texts are hash-joined to the known digests, MOST_KNOWN at most, and lines are looked up in the same digests, since their exchange
    by digest would be one of the corpus; no exchange, no Python on the executors."""
    spark = docs.sparkSession
    ship(spark)
    own = known is not None or digests is not None
    known, digests = (known or [], digests or []) if own else (KNOWN, DIGESTS)
    if len(known) + len(digests) > MOST_KNOWN:
        raise ValueError(f"{len(known) + len(digests)} known texts; at most {MOST_KNOWN} are broadcast")
    texts = spark.createDataFrame(known, "license_id string, known string")
    formed = texts.select(canonical(F.col("known")).alias("known"), "license_id").filter("known <> ''")
    rows = formed.groupBy(F.sha2(F.col("known").cast("binary"), 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.col("known").rlike(HINT)).alias("hinted")).collect()
    sure = all(r["hinted"] for r in rows) and not (own and digests)  # else texts without a hint can be known ones
    by_digest: dict[str, str] = {}
    for one, license_id in [*((r["digest"], r["license_id"]) for r in rows), *((d, i) for i, d in digests)]:
        by_digest[one] = min(license_id, by_digest.get(one, license_id))
    table = spark.createDataFrame(sorted(by_digest.items()), "digest string, license_id string")
    lookup = F.map_from_arrays(F.array(*map(F.lit, by_digest)), F.array(*map(F.lit, by_digest.values()))) if by_digest else F.create_map().cast("map<string,string>")
    hint = lambda x: F.lower(x).rlike(HINT) if sure else F.lit(True)
    hinted = hint(F.col("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), hint)
    found = F.filter(F.transform(lines, lambda x: lookup[digest(x)]), lambda x: x.isNotNull())
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    two = two.select("doc_id", F.when(hinted, digest(F.col("text"))).alias("digest"), F.when(hinted, found).otherwise(F.array().cast("array<string>")).alias("found"))
    joined = two.join(F.broadcast(table), "digest", "left")
    return joined.select("doc_id", "license_id", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def oracle() -> str:
    """The same results by other means: lines are dropped one by one, spellings replaced word by word, and words joined; no prefilter."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    mark = r"^[ \t*#/;-]*"
    who = (
        mark + r"[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][ \t:,]*(\([cC]\)|©|[bB][yY][ \t]|\d{4}|[<\[])",
        mark + r"Copyright[ \t:,]+\p{Lu}[\p{Ll}''.-]",
        mark + r"(\([cC]\)|©)[ \t]*([cC][oO][pP][yY][rR][iI][gG][hH][tT])?[ \t]*(\d{4}|[<\[])",
    )

    def canon(expression: str) -> str:
        kept = f"array_to_string(list_filter(string_split({expression}, chr(10)), lambda x: NOT (" + " OR ".join(f"regexp_matches(x, '{w}')" for w in who) + ")), chr(10))"
        out = f"regexp_replace(chr(10) || lower({kept}), '\\n[ \\t*#/;-]*all rights reserved', chr(10), 'g')"
        out = f"replace(replace(replace({out}, 'licence', 'license'), 'acknowledgement', 'acknowledgment'), '&', ' and ')"
        for word in ("sub", "re"):
            out = f"replace(replace({out}, '{word}-license', '{word}license'), '{word} license', '{word}license')"
        out = f"replace(replace({out}, 'non-infringement', 'noninfringement'), 'non infringement', 'noninfringement')"
        for word in ("author", "organ", "recogn"):
            out = f"replace(replace({out}, '{word}ise', '{word}ize'), '{word}isation', '{word}ization')"
        out = f"replace({out}, 'http://', 'https://')"
        return f"sha256(array_to_string(regexp_extract_all({out}, '[\\p{{L}}\\p{{N}}]+'), ' '))"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    more = " UNION ALL ".join(f"SELECT {quoted(d)}, {quoted(i)}" for i, d in DIGESTS)
    return f"""
WITH forms AS (SELECT {canon('known')} AS digest, license_id FROM (VALUES {values}) AS t(license_id, known) UNION ALL {more}),
known AS (SELECT digest, min(license_id) AS license_id FROM forms GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
named AS (SELECT l.doc_id, k.license_id FROM (SELECT doc_id, {canon('line')} AS digest FROM lines) l JOIN known k USING (digest)),
notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM named GROUP BY 1)
SELECT d.doc_id, k.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM documents d LEFT JOIN known k ON k.digest = {canon("coalesce(d.text, '')")} LEFT JOIN notices n ON n.doc_id = d.doc_id"""
