"""Licence scans: TF-IDF cosine to templates, then directory inheritance.

A text is compared in units: each of its sentences and lines that speaks of a
licence (wrapped lines are one sentence), and the whole text. A unit's terms are
its words and pairs of neighbouring words, weighted by term frequency and by
inverse document frequency over the templates, so that a score does not depend
on the corpus; a term of no template counts as the rarest. The cosine with every
template of the unit's kind, notice or whole licence, decides the licence and
its score; the pairs tell versions and variants apart. A text that as a whole is
a licence, or that is mostly notice, is a licence file: it speaks for its
directory. A file without a licence of its own takes that of the nearest
directory above it that has a licence file.

All of it is DataFrame operations. The vectors are sparse: (unit, term) rows
joined on the term with the few template rows. Ancestors are looked up by
equality joins on directory paths, once for each directory and not for each
file; files of directories that hold very many take theirs from a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.llm.hot_keys import look_up
from flowsieve.session import written as stored

# SPDX identifiers with the sentences of their notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
                "(at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_BSD_NAMES = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
            "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

# Whole licences that are short enough to stand in a file as they are.
LICENCES = (
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
            "PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
            "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
            "SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
            "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)

MARKERS = "licen[cs]e|copyright|spdx|redistribut|permission is hereby granted"
_TERM = "[a-z0-9]+"


@dataclass(frozen=True)
class LicenseConfig:
    """``least``: least cosine of a notice, ``least_file`` of a whole licence;
    ``file_percent``: least share of words in sentences, and in lines, that speak
    of a licence for a text with a notice to be a licence file; texts of any length are compared as a whole."""

    notices: tuple[tuple[str, str], ...] = field(default=NOTICES)
    licences: tuple[tuple[str, str], ...] = field(default=LICENCES)
    least: float = 0.6
    least_file: float = 0.7
    file_percent: int = 50


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_TERM})"), F.lit(1))


def _parent(path: Column) -> Column:
    """The directory of a path, '' for the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _with_pairs(words: Column) -> Column:
    """The words and the pairs of neighbours."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(
        F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _sentences(folded: Column) -> Column:
    """Sentences; a blank line ends one, a line end does not."""
    text = F.regexp_replace(folded, r"\n[\x20\x09\r]*\n", "\x01")
    return F.split(F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\x01"), "\x01")


def scan_licenses(files: DataFrame, cfg: LicenseConfig = LicenseConfig()) -> DataFrame:
    """One row per input row: the input's id, path, license, score, origin
    ('header', 'file', 'inherited', 'none'), license_dir.

    Needs columns id, path ('/' between names) and text. A null text has no
    notice; a null path is in the top directory; ties go to the whole licence,
    then to the licence first by name. Repeated rows each get a result; an empty
    table gives an empty one. license is null where origin is 'none'.
    """
    spark = files.sparkSession
    base = files.select("id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folded = _folded(F.col("text"))
    speaks = lambda x: x.rlike(MARKERS)
    # a file is known by id, path and text; units that repeat in it are one
    header = (base.where(folded.rlike(MARKERS)).select(
        "id", "path", F.xxhash64("id", "path", "text").alias("file"),
        F.filter(_sentences(folded), speaks).alias("sentences"), F.filter(F.split(folded, "\n"), speaks).alias("lines"),
        _terms(folded).alias("words"))
        .withColumn("n_all", F.size("words")).withColumn("n_notice", F.least(*[F.size(_terms(F.array_join(c, "\n"))) for c in ("sentences", "lines")]))
        .withColumnRenamed("words", "whole"))
    header = stored(header, "license-headers")
    one = header.dropDuplicates(["file"])
    units = (one.select("file", F.explode(F.array_distinct(F.concat("sentences", "lines"))).alias("unit"))
             .select("file", F.lit("notice").alias("kind"), _terms(F.col("unit")).alias("words"))
             .unionByName(one.select("file", F.lit("licence").alias("kind"), F.col("whole").alias("words")))
             .withColumn("unit", F.xxhash64("kind", "words")))
    # notices of many files have the same words: each is scored once
    texts = units.select("unit", "kind", "words").dropDuplicates(["unit"])
    known = spark.createDataFrame([(i, kind, n, t) for i, (kind, n, t) in enumerate(
        [("notice", *x) for x in cfg.notices] + [("licence", *x) for x in cfg.licences])],
        "template int, kind string, license string, text string")
    in_template = (known.select("template", "kind", "license", F.explode(_with_pairs(_terms(_folded(F.col("text"))))).alias("term"))
                   .groupBy("template", "kind", "license", "term").agg(F.count("*").alias("tf")))
    total = len(cfg.notices) + len(cfg.licences)
    idf = in_template.groupBy("term").agg((F.log(F.lit(1.0 + total) / (F.count("*") + 1)) + 1).alias("idf"))
    template = in_template.join(idf, "term").select("template", "kind", "license", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    length = template.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("t_norm"))
    rarest = F.log(F.lit(1.0 + total)) + 1
    in_unit = texts.select("unit", "kind", F.explode(_with_pairs(F.col("words"))).alias("term")).groupBy("unit", "kind", "term").agg(
        F.count("*").alias("tf"))
    # the templates are a parameter of a few thousand terms
    weighed = stored(in_unit.join(F.broadcast(idf), "term", "left").select(
        "unit", "kind", "term", (F.col("tf") * F.coalesce("idf", rarest)).alias("w"), F.col("idf").isNotNull().alias("shared")),
        "license-weights")
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (weighed.where("shared").join(F.broadcast(template), ["kind", "term"]).groupBy("unit", "kind", "license", "template")
            .agg(F.sum(F.col("w") * F.col("tw")).alias("dot")))
    least = F.when(F.col("kind") == "licence", cfg.least_file).otherwise(cfg.least)
    scored = (dots.join(norms, "unit").join(F.broadcast(length), "template")
              .select("unit", "kind", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("score"))
              .where(F.col("score") >= least)
              .groupBy("unit", "kind").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")))
    scored = stored(scored.select("unit", (F.col("kind") == "licence").alias("whole"), "best"), "license-scores")
    # a whole licence goes before a notice
    per_file = (look_up(units.select("file", "unit"), scored, "unit").where("best is not null")
                .groupBy("file").agg(F.min(F.struct((~F.col("whole")).alias("w"), F.col("best.s").alias("s"), F.col("best.license").alias("l"))).alias("b")))
    own = (header.join(per_file, "file")
           .select("id", "path", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"),
                   (~F.col("b.w") | (F.col("n_notice") * 100 >= F.col("n_all") * cfg.file_percent)).alias("is_file"))
           .groupBy("id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "is_file")).alias("best"))
           .select("id", "path", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"),
                   F.col("best.is_file").alias("is_file")))
    own = stored(own, "license-own")

    speaking = (own.where("is_file").select(_parent(F.col("path")).alias("license_dir"), "license", "score")
                .groupBy("license_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
                .select("license_dir", F.col("best.license").alias("dir_license"), (-F.col("best.s")).alias("dir_score")))
    placed = base.select("id", "path", _parent(F.col("path")).alias("dir"))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(
        F.slice(parts, F.lit(1), n), "/")))
    inherited = (placed.select("dir").distinct().withColumn("license_dir", F.explode(F.array_distinct(above)))
                 .join(speaking, "license_dir")
                 .groupBy("dir").agg(F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "dir_license",
                                                    "dir_score")).alias("near"))
                 .select("dir", "near.license_dir", "near.dir_license", "near.dir_score"))
    inherited = stored(inherited, "license-inherited")
    placed = placed.join(own.withColumnRenamed("path", "own_path").withColumnRenamed("id", "own_id"),
                         F.col("id").eqNullSafe(F.col("own_id")) & (F.col("path") == F.col("own_path")), "left")
    out = look_up(placed, inherited, "dir", counted=base.select(_parent(F.col("path")).alias("dir")))
    mine = F.col("license").isNotNull()
    return out.select(
        "id", "path", F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(mine & F.col("is_file"), "file").when(mine, "header").when(F.col("dir_license").isNotNull(), "inherited")
        .otherwise("none").alias("origin"),
        F.when(mine & F.col("is_file"), F.col("dir")).when(~mine, F.col("license_dir")).alias("license_dir"))
