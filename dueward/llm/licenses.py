"""License scans: sparse TF-IDF cosine of lines, blocks and files to licence texts, then inheritance by directory.

A unit is a line, a block (lines up to a blank one, joined, so wrapped headers are whole) or, in files called LICENSE or
COPYING, the whole file. Units and templates are vectors of ``(1 + ln tf) * idf``; document frequencies are counted for
every term of all files, so an ordinary word weighs as little in a unit as it is frequent, whether a template has it or
not. The best cosine at or above the threshold names the licence.

Most units never meet a template, and two bounds say so without loss. A template's heaviest terms are its anchors, until the
others hold less than ``threshold`` of its length: a unit without any anchor of a template cannot reach it. And a unit
whose terms outside the templates, at the least weight a term can have, already make it too long cannot reach any. Only
what passes both is split into terms and joined with their frequencies.

Files called LICENSE or COPYING license their directory; a file without its own licence takes that of its nearest
ancestor directory by a join on the directory's path.

Only built-in functions run. Frequencies and scores are pre-aggregated per task; a directory with a third of all files is a
skewed join side, which adaptive execution splits. The templates' terms, a fixed number, are all that the driver holds.

Null texts count as empty; a null path has no directory and inherits nothing. Equal scores go to the first template by
name. Repeated paths: each row is scored by itself; of two licence files in a directory the better score counts, then
the first licence by name. Extra columns are ignored, an empty table gives an empty result, and texts of any length are
read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, stored, text_or_empty

_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution.")
_GNU_NOTICE = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
    "Software Foundation; either version {version} of the License, or (at your option) any later version.")
# Paragraphs and header sentences of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("BSD-2-Clause", " ".join(_BSD_CONDITIONS)),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", " ".join(_BSD_CONDITIONS) + " Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU_NOTICE.format(name="General Public License", version="2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU_NOTICE.format(name="General Public License", version="3")),
    ("AGPL-3.0", _GNU_NOTICE.format(name="Affero General Public License", version="3")),
    ("LGPL-2.1", _GNU_NOTICE.format(name="Lesser General Public License", version="2.1")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     + _NO_WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means."),
)
THRESHOLD = 0.75
#: No unit of fewer terms is compared.
MIN_TERMS = 3
_TERM = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"
_LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying)[^/]*$"
#: What comments put before a line.
_MARK = r"(?m)^[\x20\t]*(?:[#*;%/]+|<!--|--)?[\x20\t]*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), 0)


def templates_with_files(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str]]]:
    """``(licence, terms)`` of every template, and of all paragraphs of a licence together, for whole files."""
    listed = list(templates)
    for name in dict.fromkeys(n for n, _ in templates):
        own = [t for n, t in templates if n == name]
        if len(own) > 1:
            listed.append((name, "\n".join(own)))
    # The same term as the engine's pattern finds: letters and numbers, and numbers behind a point.
    return [(n, re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower())) for n, t in listed]


def document_frequencies(files: DataFrame) -> DataFrame:
    """``(term, df)`` over all files."""
    each = files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _vectors(templates: list[tuple[str, list[str]]], idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """Templates as unit vectors."""
    found = []
    for name, terms in templates:
        v = {t: (1 + math.log(n)) * idf[t] for t, n in Counter(terms).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        found.append((name, {t: w / norm for t, w in v.items()}))
    return found


def anchors(vector: dict[str, float], threshold: float) -> list[str]:
    """The heaviest terms, until the others hold less than ``threshold`` of the length."""
    rest, chosen = sum(w * w for w in vector.values()), []
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < threshold**2 - 1e-9:
            break
        chosen.append(t)
        rest -= w * w
    return chosen


def _units(text: Column, path: Column) -> Column:
    """Lines, blocks of several lines, and the whole of a licence file; comment marks go."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), _MARK, "")
    blocks = F.filter(F.split(bare, r"\n(?:[\x20\t]*\n)+", -1), lambda b: F.contains(b, F.lit("\n")))
    whole = F.when(F.coalesce(F.rlike(path, F.lit(_LICENSE_FILE)), F.lit(False)), F.array(bare)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.split(bare, "\n", -1), blocks, whole)


def scanned(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(file, path, text)`` to ``(row, file, path, license, cosine)``: the best template of each file's units, or null."""
    spark = files.sparkSession
    plain = documents_of(files, "file", "path", "text").withColumn("text", text_or_empty())
    listed = templates_with_files(templates)
    vocabulary = sorted({t for _, terms in listed for t in terms})
    counts = stored(document_frequencies(plain))
    total = plain.count()
    seen = {r.term: r.df for r in counts.where(F.col("term").isin(vocabulary)).collect()}
    idf = {t: math.log((total + 1.0) / (seen.get(t, 0) + 1.0)) + 1.0 for t in vocabulary}
    vectors = _vectors(listed, idf)
    heavy = sorted({t for _, v in vectors for t in anchors(v, threshold)})
    # One pass of a pattern over each text: no anchor, no unit.
    near = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(t) for t in sorted(heavy, key=lambda t: (-len(t), t))) + r")(?![\p{L}\p{N}])"
    weights = F.create_map(*(F.lit(x) for t in vocabulary for x in (t, idf[t])))
    words = F.array(*(F.lit(t) for t in vocabulary))

    def weigh(terms: Column) -> Column:
        """The terms of a unit that may reach the threshold, else null."""
        own = F.array_distinct(terms)
        shared = F.array_intersect(own, words)

        def squared(t: Column) -> Column:
            times = F.size(F.filter(terms, lambda x: x == t)).cast("double")
            return F.pow((F.lit(1.0) + F.log(times)) * F.element_at(weights, t), F.lit(2.0))

        inner = F.aggregate(shared, F.lit(0.0), lambda held, t: held + squared(t))
        others = (F.size(own) - F.size(shared)).cast("double")  # each weighs 1 at least
        return F.when((F.size(own) >= MIN_TERMS) & (inner >= (threshold**2 - 1e-9) * (inner + others)), terms)

    hit = F.rlike("text", F.lit(near))
    units = F.filter(_units(F.col("text"), F.col("path")), lambda u: F.rlike(u, F.lit(near)))
    able = F.filter(F.transform(units, lambda u: weigh(_terms(u))), lambda t: t.isNotNull())
    none = F.array().cast("array<array<string>>")
    rows = stored(plain.select("file", "path", F.when(hit, F.array_distinct(able)).otherwise(none).alias("units"),
                               F.monotonically_increasing_id().alias("row")))
    in_unit = rows.select("row", F.posexplode("units").alias("at", "terms")).select("row", "at", F.explode("terms").alias("term"))
    tf = in_unit.groupBy("row", "at", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = stored(tf.join(counts, "term").select(
        "row", "at", "term", ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * (
            F.log((F.lit(float(total)) + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w")))
    lengths = weighed.groupBy("row", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    listed_rows = [(k, name, t, w) for k, (name, v) in enumerate(vectors) for t, w in v.items()]
    # A row per template and term: fixed by the argument.
    table = F.broadcast(spark.createDataFrame(listed_rows, "template int, license string, term string, weight double"))
    dots = weighed.join(table, "term").groupBy("row", "at", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.least(F.col("dot") / F.col("length"), F.lit(1.0)), 6)
    best = (
        dots.join(lengths, ["row", "at"]).select("row", "license", cosine.alias("cosine")).where(F.col("cosine") >= threshold)
        .groupBy("row").agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("license"))).alias("license"), F.max("cosine").alias("cosine")))
    return rows.select("row", "file", "path").join(best, "row", "left")


def inherited(found: DataFrame) -> DataFrame:
    """Adds ``inherited_license`` and ``inherited_from``: the licence file of the nearest ancestor directory."""
    found = stored(found)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    granting = found.where(F.col("license").isNotNull() & F.rlike("path", F.lit(_LICENSE_FILE))).select(folder.alias("folder"), "license", "cosine")
    granting = granting.groupBy("folder").agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("license"))).alias("granted"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = found.where("path IS NOT NULL").select("row", F.explode(F.array_distinct(above)).alias("folder"))
    nearest = asked.join(granting, "folder").groupBy("row").agg(
        F.max_by(F.struct("granted", "folder"), F.length("folder")).alias("near"))
    return found.join(nearest, "row", "left").select(
        "file", "path", "license", "cosine", F.col("near.granted").alias("inherited_license"), F.col("near.folder").alias("inherited_from"),
        F.coalesce("license", "near.granted").alias("effective_license"))


def as_files(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Paths for tables that come without them: source, language and two levels by a hash; short texts are licence files."""
    digest = F.md5(F.col(id_column).cast("string"))
    name = F.when(F.length(F.coalesce(text_column, F.lit(""))) <= 300, F.concat(F.lit("LICENSE-"), F.col(id_column))).otherwise(
        F.concat(F.col(id_column).cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", F.substring(digest, 1, 1), F.when(F.length(F.coalesce(text_column, F.lit(""))) > 300, F.substring(digest, 2, 1)), name)
    return docs.select(F.col(id_column).alias("file"), path.alias("path"), F.col(text_column).alias("text"))


def license_scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    return inherited(scanned(files, templates, threshold))
