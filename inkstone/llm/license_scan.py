"""License scans with DataFrame functions only: sparse TF-IDF cosine of lines, paragraphs and whole files to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, checkpoint, released, small, table

# Usual notices of well-known licences, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "BSD-2-Clause": ("Use of this source code is governed by a BSD 2-Clause license.", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
DISCLAIMER = "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
NAMES_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
# Whole texts of short licences, titles, and the headings that full texts of long ones begin with.
FULL: dict[str, tuple[str, ...]] = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-2-Clause": (f"{BSD} {DISCLAIMER}", "BSD 2-Clause License"),
    "BSD-3-Clause": (f"{BSD} {NAMES_CLAUSE} {DISCLAIMER}", "BSD 3-Clause License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License"),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": (
        f"{GRANT}: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        GRANT,
        "MIT License",
        "The MIT License (MIT)",
    ),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "PSF-2.0": ("PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "zlib License"),
}
#: Number of the first of FULL among a licence's templates; the number of its tag.
FIRST_FULL, TAG = 100, 99
#: What a comment's line begins with.
MARK = r"[ \t]*(?:#|//|--|;|%|\*)"
#: What a licence notice is known by: texts, and parts of texts, without any of these are no notice.
NOTICE = "(?i)licen[cs]|spdx|copyright|redistribut|permission|unencumbered|public domain|waived|creative commons|cc0"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names of licence files.
NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
THRESHOLD = 0.7


def terms(text: str) -> list[str]:
    """Words of letters and digits, and pairs of neighbours."""
    words = re.findall("[a-z0-9]+", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


Unit = tuple[str, int, dict[str, float]]


def vectors(templates: dict[str, tuple[str, ...]], full: dict[str, tuple[str, ...]]) -> tuple[dict[str, float], list[Unit], float]:
    """The idf of each term, the unit vector of each template (of every licence its SPDX tag is one), and the idf of terms that no template has."""
    numbered = [(name, n, text) for texts, first in ((templates, 0), (full, FIRST_FULL)) for name, own in sorted(texts.items()) for n, text in enumerate(own, first)]
    numbered += [(name, TAG, f"SPDX-License-Identifier: {name}") for name in sorted({*templates, *full})]
    found = [(name, n, Counter(terms(text))) for name, n, text in numbered]
    df = Counter(t for _, _, tf in found for t in tf)
    idf = {t: round(math.log((1 + len(found)) / (1 + n)) + 1, 9) for t, n in df.items()}
    out = []
    for name, n, tf in found:
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        out.append((name, n, {t: c * idf[t] / norm for t, c in tf.items()}))
    return idf, out, round(math.log(1 + len(found)) + 1, 9)


def paragraphs(low: Column) -> Column:
    """Runs of lines with letters or digits; a run ends too where comment lines begin or end."""
    parted = F.regexp_replace(low, rf"(?m)(^{MARK}[^\n]*\n)(?!{MARK}|$)", "$1\n")
    parted = F.regexp_replace(parted, rf"(?m)(^(?!{MARK})[^\n]+\n)(?={MARK})", "$1\n")
    return F.split(parted, r"\n(?:[^a-z0-9\n]*\n)+")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, full: dict[str, tuple[str, ...]] = FULL) -> DataFrame:
    """``files`` (path, text and more) with ``license``, ``score``, ``origin`` and ``license_from``.

    Every line, every paragraph of several lines and every whole text that holds a word of ``NOTICE`` is a TF-IDF vector of words and word pairs (idf over the templates); the template of the highest cosine names the license, ties going to the smaller name. ``origin`` is "header" for a line or paragraph and "file" for a whole text (the line if both score the same, unless the file's name is a licence file's). A licence file is one whose name says so or whose whole text reaches the threshold; files without a license of their own take that of the licence file in the nearest directory above them ("inherited", with that directory in ``license_from``): of several there the best score, then the smaller name. Else all four are null; so they are for null or empty texts without a licence file above. Null paths have no directory. Texts may be of any length. Rows that repeat are judged alike; an empty table gives no rows; columns of ``files`` with the names added are replaced; other names are free.
    """
    rows = carried(files, ("license", "score", "origin", "license_from"))
    directory = F.when(F.col("in_path").isNotNull(), F.regexp_replace("in_path", r"(^|/)[^/]*$", ""))
    rows = rows.withColumns({"key": F.xxhash64("in_path", "in_text"), "dir": directory})
    idf, units, unknown = vectors(templates, full)
    spark = files.sparkSession
    terms_of = [{"t": t, "i": idf[t], "w": [{"license": n, "n": k, "w": u[t]} for n, k, u in units if t in u]} for t in sorted(idf)]
    # A row for each term of the templates, however large the input.
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(terms_of)), "array<struct<t: string, i: double, w: array<struct<license: string, n: int, w: double>>>>")))

    hit = rows.filter(F.col("in_text").rlike(NOTICE))
    hit = hit.select("key", "dir", F.coalesce(F.col("in_path").rlike(NAMES), F.lit(False)).alias("named"), lowered(F.col("in_text")).alias("low")).dropDuplicates(["key"])
    # Paragraphs of several lines are numbered from -2 down.
    wrapped = F.filter(F.transform(paragraphs(F.col("low")), lambda x, i: F.struct((-2 - i).alias("no"), x.alias("part"))), lambda p: p["part"].contains("\n"))
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("no"), F.col("low").alias("part"))), F.transform(F.split("low", "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("part"))), wrapped)
    pieces = hit.select("key", "dir", "named", F.inline(F.filter(parts, lambda p: p["part"].rlike(NOTICE))))
    words = pieces.withColumn("word", F.regexp_extract_all("part", F.lit("[a-z0-9]+"), F.lit(0)))
    pairs = F.zip_with(F.slice("word", 1, F.greatest(F.array_size("word") - 1, F.lit(0))), F.slice("word", 2, F.array_size("word")), lambda a, b: F.concat_ws(" ", a, b))
    place = ["key", "dir", "named", "no"]
    bag = words.select(*place, F.explode(F.concat("word", pairs)).alias("t"))
    tf = bag.groupBy(*place, "t").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(F.broadcast(weights), "t", "left").withColumn("x", F.col("tf") * F.coalesce("i", F.lit(unknown)))
    norm = F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, F.col("x") * F.col("x")))
    # The first of a term's templates carries its share of the length.
    spread = weighed.select(*place, "x", F.posexplode_outer("w").alias("k", "at")).select(*place, "x", "k", "at.*")
    dots = spread.groupBy(*place, "license", "n").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), norm.alias("square"))
    lengths = dots.groupBy(*place).agg(F.sum("square").alias("square"), F.filter(F.collect_list(F.struct("license", "n", "dot")), lambda d: d["license"].isNotNull()).alias("dots"))
    best = F.array_max(F.transform("dots", lambda d: F.round(d["dot"] / F.sqrt("square"), 6)))
    scored = lengths.withColumn("score", best)
    same = F.filter("dots", lambda d: F.round(d["dot"] / F.sqrt("square"), 6) == F.col("score"))
    scored = scored.filter(F.col("score") >= threshold).select(*place, "score", F.array_min(F.transform(same, lambda d: d["license"])).alias("license"), F.exists(same, lambda d: d["n"] >= FIRST_FULL).alias("full"))
    scored = scored.withColumn("whole", F.col("no") == -1)
    # A licence's whole text decides before any paragraph that licences share; of equal scores a line comes before a paragraph.
    full_text, wrapped_at = F.col("whole") & F.col("full"), F.col("no") < -1
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(full_text), F.desc("score"), F.when(F.col("named"), ~F.col("whole")).otherwise(F.col("whole")), wrapped_at, "license", F.abs("no")))
    found = checkpoint(scored.withColumn("rank", rank).groupBy("key").agg(*(F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c) for c in ("license", "score", "whole", "named", "dir")), F.max("whole").alias("file")))

    # One license for each directory that has a licence file.
    held = found.filter((F.col("named") | F.col("file")) & F.col("dir").isNotNull())
    ranked = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    given = checkpoint(held.groupBy("dir").agg(ranked.alias("b")).select(F.col("dir").alias("up"), F.col("b.license").alias("up_license"), (-F.col("b.s")).alias("up_score")))
    # Directories are few beside files: each looks for the nearest above, and then its files look it up.
    folders = rows.filter("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.array_size(steps)))))
    above = above.withColumn("up", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(small(given, 100_000), "up").groupBy(F.col("dir").alias("d")).agg(F.max(F.struct("depth", "up", "up_license", "up_score")).alias("n")).select("d", "n.*")
    out = rows.join(small(found.select(F.col("key").alias("k"), "license", "score", "whole"), 100_000), F.col("key") == F.col("k"), "left")
    out = out.join(small(checkpoint(nearest), 100_000), F.col("dir") == F.col("d"), "left")
    has = F.col("license").isNotNull()
    origin = F.when(has, F.when(F.col("whole"), "file").otherwise("header")).when(F.col("up_license").isNotNull(), "inherited")
    return released(out, license=F.coalesce("license", "up_license"), score=F.coalesce("score", "up_score"), origin=origin, license_from=F.when(~has, F.col("up")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, path, license, score, origin, license_from; cases as in ``scan``."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return scan(files).select("doc_id", "path", "license", "score", "origin", "license_from")


def oracle() -> str:
    """The same rows by SQL, every line and text against every template."""
    idf, units, unknown = vectors(TEMPLATES, FULL)
    values = ", ".join(f"('{t}', {idf[t]!r})" for t in sorted(idf))
    weights = ", ".join(f"('{name}', {n}, '{t}', {w!r})" for name, n, unit in units for t, w in unit.items())
    return rf"""
WITH idf(t, i) AS (VALUES {values}), weight(license, n, t, w) AS (VALUES {weights}),
file AS (
  SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS dir, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents
), piece AS (
  SELECT doc_id, -1 AS no, low AS part FROM file UNION ALL
  SELECT doc_id, generate_subscripts(string_split(low, chr(10)), 1) - 1, unnest(string_split(low, chr(10))) FROM file
), word AS (
  SELECT doc_id, no, regexp_extract_all(part, '[a-z0-9]+') AS w FROM piece
), bag AS (
  SELECT doc_id, no, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS t FROM word
), tf AS (
  SELECT doc_id, no, t, count(*) AS tf FROM bag GROUP BY ALL
), x AS (
  SELECT doc_id, no, tf.t, tf * coalesce(i, {unknown!r}) AS x FROM tf LEFT JOIN idf ON tf.t = idf.t
), length AS (
  SELECT doc_id, no, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL
), dot AS (
  SELECT doc_id, no, license, n, sum(x * w) AS dot FROM x JOIN weight ON x.t = weight.t GROUP BY ALL
), scored AS (
  SELECT doc_id, no, license, round(dot / norm, 6) AS score FROM dot JOIN length USING (doc_id, no) WHERE round(dot / norm, 6) >= {THRESHOLD}
), own AS (
  SELECT doc_id, license, score, no = -1 AS whole FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, no = -1, license, no) = 1
), given AS (
  SELECT dir AS up, own.license, own.score FROM own JOIN file USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM scored WHERE no = -1)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own.score DESC, own.license) = 1
)
SELECT doc_id, path, coalesce(own.license, given.license) AS license, coalesce(own.score, given.score) AS score,
  CASE WHEN own.license IS NOT NULL AND whole THEN 'file' WHEN own.license IS NOT NULL THEN 'header' WHEN given.license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own.license IS NULL THEN up END AS license_from
FROM file LEFT JOIN own USING (doc_id) LEFT JOIN given ON dir = up
"""
