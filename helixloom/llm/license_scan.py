"""License scan: canonical digests of whole texts, joined with the digests of known licences.

A text is made canonical line by line: lower case; copyright lines (a line that starts with copyright, (c) or the sign)
emptied; runs of other than letters and digits made one space; equivalent spellings (licence / license, sub-license,
copyright owner / holder, https / http, version / v) made one. The lines that say something, but for one that only reserves
rights beside others, are joined by spaces. The SHA-256 of that is looked up among the digests of the catalog.

Two kinds of whole texts are looked up: the document, and each of its lines, since notices stand as lines in documents.
Built-in functions only. The catalog side carries digests and names; Spark broadcasts it where its size allows, and
otherwise shuffles digests, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.operators.sizing import broadcast_if, is_small

# Public notices and short public licences with their SPDX names.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

# Equivalent spellings, replaced in this order in a text whose words are parted by single spaces.
SPELLINGS = [("licenc", "licens"), (" sub licens", " sublicens"), (" copyright owner", " copyright holder"), (" non commercial", " noncommercial"),
             (" https ", " http "), (" http www ", " http "), (" version ", " v ")]
RESERVED = "all rights reserved"
NOT_WORD = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
CLAIM = r"(^|\n)[ \t*#/-]*(copyright|\(c\)|©)[ \t][^\n]*"


def bare(text: Column) -> Column:
    """Lower-case letters, digits, single spaces and line ends of a text; copyright lines are empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    claims = t.contains("copyright ") | t.contains("(c)") | t.contains("©")
    t = F.when(claims, F.regexp_replace(t, CLAIM, "$1")).otherwise(t)
    return F.regexp_replace(t, NOT_WORD, " ")


def canonical_lines(text: Column) -> Column:
    """The lines of a `bare` text, trimmed and with one spelling for all."""

    def spelled(line: Column) -> Column:
        out = F.concat(F.lit(" "), F.trim(line), F.lit(" "))
        for old, new in SPELLINGS:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.trim(out)

    # Most texts hold none of the words with several spellings; their lines are only trimmed.
    some = F.lit(False)
    for old, _ in SPELLINGS:
        some = some | text.contains(old.strip())
    lines = F.split(text, "\n")
    return F.when(some, F.transform(lines, spelled)).otherwise(F.transform(lines, lambda line: F.trim(line)))


def whole(lines: Column) -> Column:
    """Canonical form of a whole text: its lines that say something, without a line of reserved rights beside others."""
    told = F.filter(lines, lambda x: (x != "") & (x != RESERVED))
    return F.when(F.size(told) > 0, F.array_join(told, " ")).when(F.array_contains(lines, RESERVED), F.lit(RESERVED)).otherwise(F.lit(""))


def catalog(spark: SparkSession) -> DataFrame:
    """The built-in catalog: license, text."""
    return spark.createDataFrame(NOTICES, "license string, text string")


def digests(licenses: DataFrame) -> DataFrame:
    """(digest, license): one row per canonical text, named by the first license in order of names."""
    canon = (licenses.filter("license is not null").select("license", bare(F.col("text")).alias("t"))
             .select("license", canonical_lines(F.col("t")).alias("lines")).select("license", whole(F.col("lines")).alias("c")).filter("c <> ''"))
    return canon.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """doc_id, license (of the whole text, else null), licenses (distinct, of whole text and lines, sorted), n_lines (lines that are licences).

    One row per input row. Null or empty texts match nothing. Rows are told apart by doc_id and a hash of the text, so rows
    equal in both get equal results. Other columns are not read.
    """
    known = digests(licenses)
    rows = (docs.select("doc_id", F.xxhash64("text").alias("h"), bare(F.col("text")).alias("t"))
            .select("doc_id", "h", canonical_lines(F.col("t")).alias("lines")))
    entire = F.array(F.struct(F.lit(True).alias("entire"), whole(F.col("lines")).alias("c")))
    single = F.transform("lines", lambda x: F.struct(F.lit(False).alias("entire"), x.alias("c")))
    unit = rows.select("doc_id", "h", F.explode(F.concat(entire, single)).alias("u")).filter("u.c <> ''")
    # A row of the catalog's side is about a hundred bytes; within the bound it is broadcast, beyond it digests are shuffled.
    known = broadcast_if(is_small(known), known)
    found = unit.select("doc_id", "h", "u.entire", F.sha2("u.c", 256).alias("digest")).join(known, "digest").groupBy("doc_id", "h").agg(
        F.min(F.when(F.col("entire"), F.col("license"))).alias("license"),
        F.array_sort(F.collect_set("license")).alias("licenses"), F.count_if(~F.col("entire")).alias("n_lines"))
    back = found.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "license", "licenses", "n_lines")
    named = docs.select("doc_id", F.xxhash64("text").alias("h")).join(back, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    return named.select("doc_id", "license", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
