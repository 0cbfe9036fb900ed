"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file with a licensing word gives candidate passages. Its lines are freed of comment signs; empty
lines part them into blocks, whose lines are joined, so that wrapped notices are read as one. Candidates
are the blocks, the pieces of lines and of blocks after sentence ends, the leading comment of the file
as a whole and, for licence files, the whole text. An SPDX line is not cut at its colon. Equal passages
are scored once, however many files share them: their words are counted, weighted by the inverse
document frequency of the templates, and joined with the sparse template vectors; the cosine decides.
A word of no template weighs as much as one of a single template. Templates are one-line notices,
customary headers, titles of long licences, SPDX lines and the short licences in full. A template of a
license with a version counts only where the passage has the numbers of that version. A file's own
license is the best one found at ``FLOOR`` or more.

A licence file (named LICENSE, LICENCE, COPYING or NOTICE, with any ending) declares its own
license for its directory. A file without one of its own inherits from the nearest directory
above it, its own included, that declares one. Directories, not files, are joined with their
ancestors, and the result is joined back to the files.

Defined results: a null text has no license of its own, a null path inherits nothing; equal
paths are separate rows. Of equally good licenses, and of several licence files in a directory,
the better score wins, then the smaller name. A text of any length is read whole, in one row.
An empty table gives no rows. Of the input the columns ``keep`` are returned; those named like an
output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut_lineage

FLOOR = 0.6
ANCHOR = r"(?i)licen[cs]e|copyright|copyleft|released under|permission|permitted|redistribut|warrant|spdx"
LICENCE_FILE = r"(?i)^(LICENSE|LICENCE|COPYING|NOTICE)(\..*)?$"
COMMENT = r"^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|\"\"\"|''')"
COMMENT_END = r"\s*(?:\*+/|-->|\"\"\"|''')?\s*$"
SENTENCE_END = r"(?<=[.!?;:])(?<!Identifier:)[ \t]+"

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_SOURCE_AND_BINARY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_NO_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."

# fixed values: customary notices, headers and titles of public licenses, the short ones in full
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License",
        _GRANT,
        _GRANT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
        "This program is free software: " + _GNU.format("General Public License", ",", "3"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; " + _GNU.format("General Public License", ";", "2"),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: " + _GNU.format("Lesser General Public License", ",", "3"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; " + _GNU.format("Lesser General Public License", ";", "2.1"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: " + _GNU.format("Affero General Public License", ",", "3"),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
        _SOURCE_AND_BINARY + _NO_ENDORSEMENT + _AS_IS,
    ],
    "BSD-2-Clause": [_SOURCE_AND_BINARY + _AS_IS],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
}
for _name, _texts in TEMPLATES.items():
    _endings = ("", "-only", "-or-later") if "GPL" in _name else ("",)
    _texts += [f"SPDX-License-Identifier: {_name}{_ending}" for _ending in _endings]

_TERM = r"[a-z0-9]+"


def version_terms(license: str) -> set[str]:
    """The numbers a passage must have to name this version: 3 for GPL-3.0, 2 and 1 for LGPL-2.1."""
    found = re.search(r"(\d+)\.(\d+)$", license)
    return {n for n in found.groups() if n != "0"} if found else set()


def template_vectors(templates: dict[str, list[str]] = TEMPLATES) -> tuple[dict[str, float], float, list[tuple[str, int, str, float, int, int]]]:
    """(idf by term, idf of other terms, [(term, template number, license, unit weight,
    whether the term is of the version, how many such terms the template has)])."""
    listed = [(name, Counter(re.findall(_TERM, t.lower()))) for name, ts in sorted(templates.items()) for t in ts]
    spread = Counter(term for _, counts in listed for term in counts)
    idf = {term: math.log((1 + len(listed)) / (1 + n)) + 1 for term, n in spread.items()}
    other = math.log((1 + len(listed)) / 2) + 1
    rows = []
    for number, (name, counts) in enumerate(listed):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
        version = version_terms(name) & set(counts)
        rows += [(t, number, name, c * idf[t] / norm, int(t in version), len(version)) for t, c in counts.items()]
    return idf, other, rows


def candidate_passages(text: Column, path: Column) -> Column:
    """The distinct candidates of a file, none where no licensing word is in it."""
    raw = F.split(text, "\n")
    lines = F.transform(raw, lambda line: F.regexp_replace(F.regexp_replace(line, COMMENT, ""), r"^\s+|" + COMMENT_END, ""))
    blocks = F.transform(F.split(F.array_join(lines, "\n"), r"\n\n+"), lambda block: F.translate(block, "\n", " "))
    pieces = F.flatten(F.transform(F.concat(lines, blocks), lambda part: F.split(part, SENTENCE_END)))
    plain = F.array_position(F.transform(raw, lambda line: line.rlike(COMMENT + r"|^\s*$")), F.lit(False))
    head = F.array_join(F.when(plain > 0, F.slice(lines, F.lit(1), (plain - 1).cast("int"))).otherwise(lines), " ")
    whole = F.when(F.regexp_extract(path, r"[^/]*$", 0).rlike(LICENCE_FILE), F.array_join(lines, " ")).otherwise(F.lit(""))
    found = F.filter(F.concat(pieces, blocks, F.array(head, F.coalesce(whole, F.lit("")))), lambda p: p.rlike(ANCHOR))
    return F.when(text.rlike(ANCHOR), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def score_passages(passages: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(passage_id, license, score) of the best template of every distinct passage (passage_id, passage)
    with a common term."""
    spark = passages.sparkSession
    idf, other, rows = template_vectors(templates)  # as many rows as the templates have words
    weights = spark.createDataFrame(list(idf.items()), "term string, idf double")
    vectors = spark.createDataFrame(rows, "term string, template int, license string, weight double, version int, versions int")
    counted = (
        passages.groupBy("passage_id")
        .agg(F.first("passage").alias("passage"))
        .select("passage_id", F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(_TERM), F.lit(0))).alias("term"))
        .groupBy("passage_id", "term")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(weights), "term", "left")
        .withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    )
    norms = counted.groupBy("passage_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        counted.select("passage_id", "term", "w")
        .join(F.broadcast(vectors), "term")
        .groupBy("passage_id", "template", "license")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sum("version").alias("has"), F.max("versions").alias("needs"))
        .where("has >= needs")
    )
    cosine = F.least(F.lit(1.0), F.round(F.col("dot") / F.col("norm"), 9))
    best = dots.join(norms, "passage_id").select("passage_id", "license", cosine.alias("score"))
    return best.groupBy("passage_id").agg(_best("license", "score").alias("b")).select("passage_id", "b.license", "b.score")


def _best(license: str, score: str) -> Column:
    """The license of the highest score, of equal ones the smallest name."""
    return F.min(F.struct((-F.col(score)).alias("minus"), F.col(license).alias("license"), F.col(score).alias("score")))


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def nearest_declared(folders: DataFrame, declared: DataFrame) -> DataFrame:
    """(folder, declared_in, license): the nearest of the folder and its ancestors in ``declared``."""
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")))
    # a path without a leading slash has the empty folder above its first part
    chain = F.when(F.substring("folder", 1, 1) == "/", above).otherwise(
        F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at"))), F.filter(above, lambda a: a["at"] != ""))
    )
    steps = folders.select("folder").distinct().where("folder IS NOT NULL").select("folder", F.explode(chain).alias("a"))
    found = steps.select("folder", "a.depth", F.col("a.at").alias("declared_in")).join(declared, "declared_in")
    return (
        found.groupBy("folder")
        .agg(F.max(F.struct("depth", "declared_in", "license")).alias("m"))
        .select("folder", "m.declared_in", "m.license")
    )


OUTPUTS = ["path", "own_license", "score", "inherited_from", "license"]


def scan(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    keep: list[str] | None = None,
    templates: dict[str, list[str]] = TEMPLATES,
    floor: float = FLOOR,
) -> DataFrame:
    """(keep, path, own_license, score, inherited_from, license) of every file.

    ``score`` is the best cosine of the file, 0 without a candidate; ``license`` the file's own
    or the inherited one.
    """
    keep = [c for c in keep or [] if c not in OUTPUTS]
    stored = cut_lineage(
        files.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(f"`{path}`").alias("path"),
            F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("_kept"),
            candidate_passages(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{path}`")).alias("_passages"),
        )
    )
    passages = stored.select("_row", F.explode("_passages").alias("passage")).withColumn("passage_id", F.sha2("passage", 256))
    scored = passages.select("_row", "passage_id").join(score_passages(passages, templates), "passage_id")
    own = scored.groupBy("_row").agg(_best("license", "score").alias("b")).select("_row", F.col("b.license").alias("_license"), F.col("b.score").alias("_score"))
    known = cut_lineage(
        stored.drop("_passages")
        .join(own, "_row", "left")
        .select(
            "path", "_kept", _folder(F.col("path")).alias("folder"),
            F.when(F.col("_score") >= floor, F.col("_license")).alias("own_license"),
            F.coalesce("_score", F.lit(0.0)).alias("score"),
        )
    )
    declared = (
        known.where(F.col("own_license").isNotNull() & F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE))
        .groupBy(F.col("folder").alias("declared_in"))
        .agg(_best("own_license", "score").alias("b"))
        .select("declared_in", "b.license")
    )
    nearest = nearest_declared(known.where("own_license IS NULL"), declared).withColumnRenamed("folder", "_folder")
    joined = known.join(nearest, (F.col("folder") == F.col("_folder")) & F.col("own_license").isNull(), "left")
    return joined.select(
        *[F.col("_kept").getField(c).alias(c) for c in keep],
        "path",
        "own_license",
        "score",
        F.col("declared_in").alias("inherited_from"),
        F.coalesce("own_license", "license").alias("license"),
    )
