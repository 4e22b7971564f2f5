"""License scans: sparse TF-IDF cosine, then inheritance down directories.

Each text's header (the sentences that speak of a licence) becomes a sparse TF-IDF vector, with document frequencies from
the whole corpus, and is held against the notices by cosine; so is the header
with its wrapped lines joined and the marks of comments taken away, where that
differs, and the better cosine holds. Every text that
speaks of a licence at all is also held, whole, against full licence texts.
Licence files speak for their directory: a file without a header of its own
takes the licence of the nearest directory above it that has one.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import cut, table, word_count

#: Identifiers and the notices by which works name these licences,
#: short and long ones apart.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MIT", "MIT License"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Licences whose works say that they may be passed on under a version of them "or any later version".
VERSIONED = [
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
]
#: Identifiers that stand in a line of their own, and the licences whose identifiers also come with these endings.
IDENTIFIERS = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense"]
ENDINGS = ["", "-only", "-or-later"]
#: Full licence texts, by the names of their files.
TEXTS = Path(__file__).parent / "license_texts"
#: Least cosine of a header to a notice, and of a whole text to a full licence.
LEAST_COSINE, LEAST_WHOLE = 0.6, 0.8
#: A file of such a name whose header speaks is a licence file; so is one whose
#: name has no ending if its header holds at least this part of its words.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright|notice)s?([._-][^/]*)?$"
FILE_PART, ENDING = 0.5, r"[^/.][^/]*\.[A-Za-z][^/.]*$"
#: Parts that the texts with one term are dealt over where they meet its frequency.
SALTS = 16
#: A header line names a licence in one of these ways, in small letters.
SPEAKS = r"licen[cs]e|copyright|spdx-|public domain|\bcc0\b|\bcc[ -]by\b|creative commons"
#: Such lines are cut into sentences, of which those that grant rights count, too.
SENTENCE, GRANTS = r"(?<=[.!?])\s+(?=\p{Lu})", r"permission is hereby granted|permission to use, copy|redistribution and use"
#: What opens and closes a line of a comment; a line of so many characters that doesn't end a sentence goes on in the next.
OPENS = r"(?m)^[ \t]*+(?://+|/\*+|\*+(?!/)|#+|--+|;+|%+|<!--|\"{3}|'{3})!?[ \t]*"
CLOSES = r"(?m)(?:(?<!\*)\*+/|-->)[ \t]*$"
WRAPPED = r"(?m)^(.{40,}[^\s.!?:;])[ \t]*\r?\n(?=\S)"
#: Full licences of at most so many characters are looked for in headers, too.
SHORT_TEXT = 2000
#: A term is a run of letters, or of digits with points between.
TERM = r"\p{L}+|\d+(?:\.\d+)*+"


def _is_file() -> Column:
    mostly = ~F.col("path").rlike(ENDING) & (word_count(F.col("header")) >= FILE_PART * word_count(F.col("text")))
    return F.coalesce(F.col("header").isNotNull() & (F.col("path").rlike(FILE_NAME) | mostly), F.lit(False))


def spoken(text: Column) -> Column:
    """The sentences of a text that speak of a licence, a line each."""

    def sentences(line: Column) -> Column:
        return F.filter(F.split(line, SENTENCE), lambda s: F.lower(s).rlike(f"{SPEAKS}|{GRANTS}"))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.lower(line).rlike(f"{SPEAKS}|{GRANTS}"))
    return F.array_join(F.flatten(F.transform(lines, sentences)), "\n")


def unwrapped(text: Column) -> Column:
    """A text without the marks of comments, its wrapped lines joined."""
    bare = F.regexp_replace(F.regexp_replace(text, CLOSES, ""), OPENS, "")
    return F.regexp_replace(bare, WRAPPED, "$1 ")


def headers(files: DataFrame) -> DataFrame:
    """Adds `header, wrapped, is_file` to `path, text` rows.

    `header` is null if no line speaks. `wrapped` is the header as it reads with
    wrapped lines joined, null also where that makes no difference.
    """
    speaks = F.lower("text").rlike(SPEAKS)
    found = files.withColumn("header", F.when(speaks, spoken(F.col("text")))).withColumn("wrapped", F.when(speaks, spoken(unwrapped(F.col("text")))))
    return found.withColumn("wrapped", F.when(F.col("wrapped") != F.col("header"), F.col("wrapped"))).withColumn("is_file", _is_file())


def terms(column: str) -> Column:
    """The terms of a header, in small letters."""
    return F.regexp_extract_all(F.lower(column), F.lit(TERM), 0)


def full_texts() -> list[tuple[str, str]]:
    """Names and full texts of the licences that come with the library.

    The AGPL 3 differs from the GPL 3 by its name, parts of its preamble and
    section 13; the GPL's text under the other name stands for it.
    """
    found = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    gpl = dict(found)["GPL-3.0"]
    renamed = gpl.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    return [*found, ("AGPL-3.0", renamed)]


def notices() -> list[tuple[str, str]]:
    """Names and texts of all notices: the listed ones, those of versioned licences, and identifiers."""
    later = [
        (
            license,
            f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
            f"either version {version} of the License, or (at your option) any later version. See the GNU {name} for more details. "
            f"You should have received a copy of the GNU {name} along with this program.",
        )
        for license, name, version in VERSIONED
    ]
    identifiers = [(name, name) for name in IDENTIFIERS] + [(license, license + ending) for license, *_ in VERSIONED for ending in ENDINGS]
    return [*TEMPLATES, *later, *[(license, f"SPDX-License-Identifier: {name}") for license, name in identifiers]]


def closest(found: DataFrame, column: str, templates: list[tuple[str, str]], least: float, short: list[tuple[str, str]] | None = None) -> DataFrame:
    """`fid, license, cosine`: the closest template of each text of the column, if close enough.

    Weights are tf * ln((1 + N) / (1 + df)), plus tf so that no term weighs
    nothing; N and df count the column's texts. The templates are a fixed list
    of a few thousand terms, so the join is against a table of bounded size.
    Of the `short` templates only the sentences count that a header would keep.
    """
    spark = found.sparkSession
    tf = found.filter(F.col(column).isNotNull()).select("fid", F.explode(terms(column)).alias("term")).groupBy("fid", "term").agg(F.count("*").alias("tf"))
    tf = cut(tf, f"license-terms-{column}")
    frequency = tf.groupBy("term").agg(F.count("*").alias("df"))
    listed = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates]
    listed += [F.struct(F.lit(name).alias("license"), spoken(unwrapped(F.lit(text))).alias("text")) for name, text in short or []]
    known = spark.range(1).select(F.posexplode(F.array(*listed)).alias("number", "t")).select("number", "t.license", F.explode(terms("t.text")).alias("term")).groupBy("number", "license", "term").agg(F.count("*").alias("tf"))
    known = cut(known, f"license-templates-{column}")  # plans from here on don't carry the texts
    texts = tf.select(F.count_distinct("fid").alias("n"))
    weight = F.col("tf") * (1 + F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))))
    template = known.join(frequency, "term", "left").crossJoin(texts).withColumn("weight", weight)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("number")))
    template = template.select("number", "license", "term", (F.col("weight") / length).alias("template_weight"))
    # a text's own terms join their frequency, which is there once for each salt, as "license" is a term of nearly all
    spread = frequency.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    own = tf.withColumn("salt", F.pmod("fid", F.lit(SALTS))).join(spread, ["term", "salt"]).drop("salt").crossJoin(texts).withColumn("weight", weight)
    sizes = own.groupBy("fid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    dots = own.join(F.broadcast(template), "term").groupBy("fid", "license", "number").agg(F.sum(F.col("weight") * F.col("template_weight")).alias("dot"))
    cosines = dots.join(sizes, "fid").select("fid", "license", F.round(F.col("dot") / F.col("size"), 9).alias("cosine"))
    best = cosines.groupBy("fid").agg(F.max_by(F.struct("license", "cosine"), F.struct("cosine", "license")).alias("best"))
    return best.select("fid", "best.*").filter(F.col("cosine") >= least)


def match_headers(found: DataFrame) -> DataFrame:
    """`fid, license, cosine`: the closest notice of each header, as it stands or with its wrapped lines joined.

    Joined headers are also held against the short licences themselves.
    """
    short = [(name, text) for name, text in full_texts() if len(text) <= SHORT_TEXT]
    both = closest(found, "header", notices(), LEAST_COSINE).unionByName(closest(found, "wrapped", notices(), LEAST_COSINE, short))
    return both.groupBy("fid").agg(F.max_by(F.struct("license", "cosine"), F.struct("cosine", "license")).alias("best")).select("fid", "best.*")


def match_files(found: DataFrame) -> DataFrame:
    """`fid, whole_license, whole_cosine`: the licence that a text holds in full."""
    return closest(found, "whole", full_texts(), LEAST_WHOLE).withColumnsRenamed({"license": "whole_license", "cosine": "whole_cosine"})


def inherit(files: DataFrame) -> DataFrame:
    """`directory, from_directory, license`: the nearest licence above each directory.

    `files` has `directory, path, is_file, license, cosine`. Of several licence
    files in a directory the closest match speaks, ties to the first path.
    Directories, not files, climb: each is listed with its ancestors once.
    """
    speakers = files.filter("is_file and license is not null").groupBy("directory").agg(F.min_by(F.struct("license"), F.struct(-F.col("cosine"), "path", "license")).alias("s")).select(F.col("directory").alias("from_directory"), "s.license")
    own = files.select("directory").distinct()
    parts = F.split("directory", "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    above = own.select("directory", F.explode(F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("from_directory"))
    found = above.join(speakers, "from_directory")
    return found.groupBy("directory").agg(F.max_by(F.struct("from_directory", "license"), F.length("from_directory")).alias("s")).select("directory", F.col("s.from_directory").alias("from_directory"), F.col("s.license").alias("directory_license"))


def scan(files: DataFrame) -> DataFrame:
    """`files` (`id, path, text`) with `license, cosine, evidence, from_directory`.

    A full licence text ("file") comes first, then a file's own header
    ("header", or "file" for a licence file), then the nearest directory above ("inherited"), else "none". Null and empty
    texts have no header; a null path is the root. Repeated rows are treated
    each by itself and other columns ignored. Headers are read whole.
    """
    own = files.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("path"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    found = headers(own).select(F.monotonically_increasing_id().alias("fid"), "id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), "header", "wrapped", "is_file", F.when(F.col("header").isNotNull(), F.col("text")).alias("whole"))
    found = cut(found, "license-headers")
    both = found.drop("header", "wrapped", "whole").join(match_headers(found), "fid", "left").join(match_files(found), "fid", "left")
    both = both.withColumn("is_file", F.col("is_file") | F.col("whole_license").isNotNull()).withColumn("license", F.coalesce("whole_license", "license")).withColumn("cosine", F.coalesce("whole_cosine", "cosine"))
    matched = cut(both.drop("whole_license", "whole_cosine"), "license-matched")
    joined = matched.join(inherit(matched), "directory", "left")
    own_one = F.col("license").isNotNull()
    return joined.select(
        "id",
        "path",
        F.coalesce("license", "directory_license").alias("license"),
        "cosine",
        F.when(own_one & F.col("is_file"), "file").when(own_one, "header").when(F.col("directory_license").isNotNull(), "inherited").otherwise("none").alias("evidence"),
        F.when(~own_one, F.col("from_directory")).alias("from_directory"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """`id, path, text` of `documents`, which have no paths of their own.

    A document's path is source / language / thousands of its id / id, so that
    directories nest and fill as the corpus grows.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("unknown")), part("doc_id"))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every row of `documents`, own or inherited."""
    return scan(document_paths(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
