"""Licence scan by canonical digest.

A text is brought to a canonical form: letters in lower case, its title, copyright lines and reserved
rights dropped, lines joined, equivalent spellings unified, every run of other characters one blank. Its SHA-256
is then joined to the digests of known licence texts, made by the same expression.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import without

# Spellings that licence matching treats as equal, as words in canonical text.
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("v3", "version 3"),
    ("v2", "version 2"),
    ("https", "http"),
]

# Parts of texts that several licences share.
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
NO_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission. "
)
AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Known texts. Users hand in a larger table of the same two columns.
KNOWN = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", REDISTRIBUTION + AS_IS),
    ("BSD-3-Clause", REDISTRIBUTION + NO_ENDORSEMENT + AS_IS),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the "
        "Software, unless such copies or derivative works are solely in the form of machine-executable "
        "object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should "
        "have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

# Titles that stand over a licence, and what follows "copyright" in running text.
TITLES = (
    "mit license", "mit", "expat license", "isc license", "bsd zero clause license", "zero-clause bsd",
    "bsd 2-clause license", "bsd 2-clause \"simplified\" license", "bsd 3-clause license",
    "bsd 3-clause \"new\" or \"revised\" license", "new bsd license", "simplified bsd license", "zlib license",
    "boost software license", "the unlicense", "unlicense",
)
PROSE = (
    "notice", "notices", "holder", "holders", "owner", "owners", "law", "laws", "license", "licence", "licenses",
    "licences", "statement", "statements", "interest", "and", "or", "in", "is", "this", "the", "to", "for", "as",
)

#: A title line at the start of a text.
TITLE = r"^\s*(the )?(" + "|".join(TITLES) + r")( \([a-z0-9. -]+\))?[ \t]*:?[ \t]*\r?\n"
#: A line of running text that happens to begin with the word is kept: the word is marked ...
WRAPPED = r"(^|\n)([ \t]*)copyright([ \t]*\r?\n|[ \t]*$|[ \t]+(?:" + "|".join(PROSE) + r")\b)"
#: ... and other lines that begin by naming an owner go as a whole, with or without a year.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
RESERVED = r"all rights reserved\.?"
OTHER = "[^a-z0-9\u0080-\U0010ffff]+"


def canonical(text: Column) -> Column:
    """Canonical form; null counts as empty. Non-ASCII letters stay as they are."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(low, TITLE, "")
    out = F.regexp_replace(out, WRAPPED, "$1$2\x01copyright$3")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, RESERVED, " ")
    # Few texts hold any of the words that these patterns look for.
    signs = [F.contains(low, F.lit(s)) for s in ("licen", "mit", "copyright", "(c)", "©", "all rights reserved")]
    out = F.when(reduce(or_, signs), out).otherwise(low)
    # Words get blanks of their own on both sides, so that plain replacement works on whole words.
    out = F.concat(F.lit(" "), F.regexp_replace(out, OTHER, "  "), F.lit(" "))
    for spelling, same in EQUIVALENT:
        spaced = [f" {x.replace(' ', '  ')} " for x in (spelling, same)]
        out = F.replace(out, F.lit(spaced[0]), F.lit(spaced[1]))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(texts: DataFrame) -> DataFrame:
    """``digest, licence`` of a table ``licence, text``: one row a digest, smallest name first.

    Texts without a canonical character are left out, or every empty text would match them.
    """
    rows = texts.select("licence", canonical(F.col("text")).alias("canonical"))
    rows = rows.filter((F.col("canonical") != "") & F.col("licence").isNotNull())
    return rows.groupBy(F.sha2(F.col("canonical").cast("binary"), 256).alias("digest")).agg(
        F.min("licence").alias("licence")
    )


def default_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "licence string, text string")


def scan(df: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``digest`` and ``licence`` (null if unknown) to every row, by its entire text.

    A null or empty text, and one without a letter or digit, has the digest of the empty form and
    no licence. Repeated rows stay repeated; input columns of the result's names are replaced; an
    empty table stays empty. The hash join sends the known digests to all tasks only if
    Spark finds them small enough. A digest that a third of all rows share is one row on the known
    side, so adaptive execution can split its rows.
    """
    rows = without(df.withColumn("_digest", digest(df[text_col])), "digest", "licence")
    return rows.withColumnRenamed("_digest", "digest").join(known_digests(known), "digest", "left")


def scan_lines(
    docs: DataFrame, known: DataFrame, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``key, licences``: the sorted licences whose entire text is one line of the document.

    Every line is a text of its own to ``scan``. Keys without a match have no row; rows that
    share a key share its licences; a null key is a key like any other. What is gathered for a
    key are different known licences, whose number does not depend on the documents.
    """
    lines = docs.select(
        docs[key].alias("key"), F.explode(F.split(docs[text_col], "\n")).alias("line")
    )
    found = scan(lines, known, "line").filter(F.col("licence").isNotNull())
    return found.groupBy(F.col("key").alias(key)).agg(
        F.array_sort(F.collect_set("licence")).alias("licences")
    )
