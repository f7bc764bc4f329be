"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

DataFrame functions only. Windows are the lines of a text (a notice often stands on a line of its own)
and runs of ``WINDOW`` words every ``STEP`` words across lines. A window whose similarity to a template's
window is s shares one of ``len(SEEDS)`` bands of one minimum with probability 1 - (1 - s) ** len(SEEDS):
0.996 at 0.5, 1 for equal windows. Inside a long line or paragraph a window is much larger than a short
template, so a third kind of window is a single shingle: it shares a band with a template if it is one of the
template's least shingles under the seeds. A text with a share c of a template's shingles, whatever stands
around them, holds one of those with probability about 1 - (1 - c) ** len(SEEDS): 1 for whole templates.
What a shared band retrieves is verified on the shingles of the whole document. A text without a single shingle of any
template can hold none of them, so only the others have their windows made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, WINDOW, STEP, CONTAINED = 4, 64, 32, 0.8
#: Templates of fewer shingles must be found whole: one word there is another license.
SHORT = 20
#: Seeds of the minima, one band each.
SEEDS = (11, 23, 37, 41, 53, 67, 79, 97)

#: Wording of public licenses and of notices that name them.
TEMPLATES = {
    "notice-mit": "Released under the MIT License.",
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-cc-by-4.0": "Licensed under CC BY 4.0.",
    "notice-cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "notice-bsd": "Released under the BSD License.",
    "notice-gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "notice-mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
}


#: Possessive, as a repeated group that can give back takes a stack frame a turn.
WORD = r"[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)*+"


def words_of(text: Column) -> Column:
    """Hashes of the words of a lower-cased text: runs of letters and digits, dots and dashes inside."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def word_lines(text: Column) -> Column:
    """Hashes of the words of each line."""
    return F.transform(F.split(lowered(text), "\n", -1), words_of)


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of SHINGLE words; a shorter non-empty window is one shingle. ``words`` is a column or variable."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) > 0, runs).otherwise(F.expr("cast(array() as array<bigint>)"))


def _under(seed: int):
    return lambda h: F.xxhash64(h, F.lit(seed))


def bands_of(shingles: Column) -> Column:
    """One hash for each band: its number with the least shingle hash under its seed."""
    return F.array(*[F.xxhash64(F.lit(seed), F.array_min(F.transform(shingles, _under(seed)))) for seed in SEEDS])


def least_shingles(shingles: Column) -> Column:
    """The distinct shingles with the least hash under one of the seeds."""
    under = lambda seed: F.array_min(F.transform(shingles, lambda h: F.struct(_under(seed)(h).alias("by"), h.alias("h"))))["h"]
    return F.array_distinct(F.array(*[under(seed) for seed in SEEDS]))


def windows(rows: DataFrame, text: str, least: list[int] | None = None, around: int = WINDOW) -> DataFrame:
    """rows with ``words`` and ``spot``: a row for each overlapping window.

    Windows are the lines of up to WINDOW words, and WINDOW words every STEP across lines; their spot is
    null. Each shingle among ``least`` is a spot, with the words up to ``around`` before and after its start.
    """
    own = [c for c in rows.columns if c != text]
    lined = rows.select(*own, word_lines(F.col(text)).alias("lines")).select(*own, "lines", F.flatten("lines").alias("all"))
    short = F.filter("lines", lambda w: (F.size(w) > 0) & (F.size(w) <= WINDOW))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1)), F.lit(STEP)), lambda i: F.slice("all", i, WINDOW))
    plain = lambda w: F.struct(w.alias("words"), F.lit(None).cast("long").alias("spot"))
    found = F.transform(F.concat(short, F.filter(runs, lambda w: F.size(w) > 0)), plain)
    if least:
        at = F.filter(F.transform(shingles_of(F.col("all")), lambda h, i: F.struct((i + 1).alias("i"), h.alias("h"))), lambda x: x["h"].isin(least))
        first = lambda x: F.greatest(x["i"] - around, F.lit(1))
        found = F.concat(found, F.transform(at, lambda x: F.struct(F.slice("all", first(x), x["i"] - first(x) + around).alias("words"), x["h"].alias("spot"))))
    return lined.select(*own, F.explode(found).alias("w")).select(*own, "w.words", "w.spot")


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``(license, body, n_words, shingles)``: a row a template, its distinct shingles."""
    t = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    t = t.select("license", "body", F.flatten(word_lines(F.col("body"))).alias("all"))
    return t.select("license", "body", F.size("all").alias("n_words"), F.array_distinct(shingles_of(F.col("all"))).alias("shingles"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """``(doc_id, license, n_shared, n_shingles, containment)`` for each document and template it holds.

    A window retrieves a template; containment is then the share of the template's distinct shingles that the
    whole document has. ``contained`` of them make a match, all of them if they are fewer than SHORT. Null and
    empty texts match nothing; rows of one id count as one document; rows with a null id are left out. The
    template table is a parameter of fixed size and goes to every task.
    """
    known = template_table(docs.sparkSession, templates)
    least = known.where("n_words > 0").select("license", "n_words", F.explode(least_shingles(F.col("shingles"))).alias("band"))
    spots = least.collect()  # at most len(SEEDS) a template
    own = sorted({h for r in known.select("shingles").collect() for h in r["shingles"]})
    shortest = min((r["n_words"] for r in spots), default=0)
    around = max((r["n_words"] for r in spots), default=WINDOW)
    of_windows = windows(known.select("license", "body"), "body").select("license", shingles_of(F.col("words")).alias("s"))
    bands = F.broadcast(of_windows.select("license", F.explode(bands_of(F.col("s"))).alias("band")).union(least.select("license", "band")).distinct())
    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    # no word spans lines, so the words of all lines are those of the text; an array of one stands in for a
    # name, so that the words are found once
    mine = lambda f: F.element_at(F.transform(F.array(words_of(lowered(F.col("body")))), f), 1)
    if shortest >= SHINGLE:
        base = base.where(mine(lambda ws: F.exists(shingles_of(ws), lambda h: h.isin(own))))
    held = mine(lambda ws: F.array_distinct(F.filter(shingles_of(ws), lambda h: h.isin(own))))
    if shortest < SHINGLE:  # lines of fewer words have a shingle of their own
        few = F.filter(word_lines(F.col("body")), lambda w: (F.size(w) > 0) & (F.size(w) < SHINGLE))
        held = F.array_union(held, F.transform(few, lambda w: F.element_at(shingles_of(w), 1)))
    base = base.withColumn("held", held)
    asked = windows(base, "body", sorted({r["band"] for r in spots}), around).select("doc_id", "held", "spot", shingles_of(F.col("words")).alias("s"))
    asked = asked.select("doc_id", "held", F.explode(F.when(F.col("spot").isNull(), bands_of(F.col("s"))).otherwise(F.array("spot"))).alias("band"))
    hits = asked.join(bands, "band").select("doc_id", "license", "held").distinct()
    exact = hits.join(F.broadcast(known.select("license", "shingles")), "license")
    shared = exact.select("doc_id", "license", F.size("shingles").alias("n_shingles"), F.explode(F.array_intersect("held", "shingles")).alias("h"))
    shared = shared.groupBy("doc_id", "license", "h").agg(F.first("n_shingles").alias("n_shingles"))
    found = shared.groupBy("doc_id", "license").agg(F.count("*").alias("n_shared"), F.first("n_shingles").cast("long").alias("n_shingles"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= F.when(F.col("n_shingles") < SHORT, 1.0).otherwise(contained))
