"""License scans: headers and licence files compared with templates by TF-IDF cosine, and inheritance down the folders.

A text, or its header, is a sequence of words. It is compared with each template whole, and in spans as long as the template, wherever a
term stands that no near span can lack; so statements are found within prose, wrapped over lines, or on one line. Spans and templates are
sparse vectors of word weights, with document frequencies counted over all files. Licence texts give their licence to all documents in and
below their folder that have none themselves; the nearest folder counts. Only built-in functions are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.lookup import salted_join, value_key
from postwatch.llm.common import store

#: Licences by their published ids, and the names they go by.
NAMES: Mapping[str, tuple[str, ...]] = {
    "MIT": ("the MIT License",),
    "ISC": ("the ISC License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache 2.0 license"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "the GPLv3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the LGPLv2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the LGPLv3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the AGPLv3"),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("the Eclipse Public License, version 2.0",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: How a file states a licence by its name or id.
STATEMENTS = ("under {name}",)  # whatever verb stands before
TAGS = ("SPDX-License-Identifier: {id}", "SPDX-License-Identifier: {id}-only", "SPDX-License-Identifier: {id}-or-later")
#: Published headers, and texts or opening words of licences.
GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the "
              "Free Software Foundation, {version}")
TEXTS: Mapping[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
                GNU_HEADER.format(kind="General Public License", version="either version 2 of the License, or (at your option) any later version."),
                GNU_HEADER.format(kind="General Public License", version="version 2 of the License.")),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                GNU_HEADER.format(kind="General Public License", version="either version 3 of the License, or (at your option) any later version."),
                GNU_HEADER.format(kind="General Public License", version="version 3 of the License.")),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
                 GNU_HEADER.format(kind="Lesser General Public License", version="either version 2.1 of the License, or (at your option) any later version.")),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                 GNU_HEADER.format(kind="Lesser General Public License", version="either version 3 of the License, or (at your option) any later version.")),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
                 GNU_HEADER.format(kind="Affero General Public License", version="either version 3 of the License, or (at your option) any later version.")),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder "
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Terms a span must not have if its template lacks them.
KINDS = r"by-\w+(?:-\w+)*|attribution-\w+(?:-\w+)*|lesser|affero"
#: Terms a span must share with its template whatever its cosine: versions and kinds, which tell licences of one wording apart.
TELLING = r"v?\d+(?:\.\d+)*|\d-clause|by|attribution|[al]?gplv[\d.]+|mit|isc|" + KINDS
LEAST_COSINE, HEADER_LINES, LICENCE_FILE = 0.8, None, r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def default_templates() -> dict[str, tuple[str, ...]]:
    """Templates by licence: its statements, tags and texts."""
    made = {n: tuple(s.format(name=x) for x in xs for s in STATEMENTS) + tuple(t.format(id=n) for t in TAGS) for n, xs in NAMES.items()}
    return {n: made.get(n, ()) + TEXTS.get(n, ()) for n in {**made, **TEXTS}}


def folded(text: Column) -> Column:
    """The text in small letters and with one spelling of "license"; empty for null."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("licence"), F.lit("license"))


def words(text: Column) -> Column:
    """Words, numbers and versions of a folded text: letters, digits, and dots and hyphens between them."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.-]*"), F.lit(0)), lambda w: F.rtrim(w, F.lit(".-")))


def document_frequencies(files: DataFrame) -> DataFrame:
    """(term, df): in how many rows of ``files`` (text) a term occurs, for terms in two or more; counted before the shuffle."""
    each = files.select(F.explode(F.array_distinct(words(folded(F.col("text"))))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")


def inverse_frequency(df: Column, rows: int) -> Column:
    """Weight of a term in ``df`` (null: one) of ``rows`` documents; 1 or more for the terms of these documents."""
    return F.log((F.lit(1.0) + rows) / (F.coalesce(df, F.lit(1)) + 1.0)) + 1.0


def needed_terms(weights: Mapping[str, float], least: float) -> set[str]:
    """Terms of a unit vector of which a span must have one to reach the cosine ``least``.

    A cosine is at most the length of the template's part that the span shares. So terms are taken, the heaviest first, until
    what is left is shorter than ``least``.
    """
    needed, left = set(), 1.0
    for term, weight in sorted(weights.items(), key=lambda r: (-r[1], r[0])):
        if left < least**2 - 1e-6:
            break
        needed.add(term)
        left -= weight**2
    return needed


def template_anchors(spark: SparkSession, templates: Mapping[str, tuple[str, ...]], frequencies: DataFrame, rows: int, least: float) -> DataFrame:
    """(term, shift, template, licence, size, norm, weights, telling): one row for each place of a needed term in a template.

    All of it is as large as the templates. ``weights`` are the squares of the template's unit vector, ``norm`` its length before.
    """
    texts = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in templates.items() for t in ts)]
    listed = spark.createDataFrame(texts, "template int, licence string, text string").select("template", "licence", words(folded(F.col("text"))).alias("words"))
    terms = listed.select(F.explode("words").alias("term")).distinct()
    idf = {r["term"]: r["idf"] for r in frequencies.join(F.broadcast(terms), "term", "right").select("term", inverse_frequency(F.col("df"), rows).alias("idf")).collect()}
    out = []
    for r in listed.collect():
        own = set(r["words"])
        norm = math.sqrt(sum(idf[w] ** 2 for w in own))
        unit = {w: idf[w] / norm for w in own}
        telling = sorted(w for w in own if re.fullmatch(TELLING, w)) or ([r["words"][-1]] if r["words"] and r["words"][0].startswith("spdx") else [])
        squares = [(w, x * x) for w, x in sorted(unit.items())]
        needed = needed_terms(unit, least)
        out += [(w, at, r["template"], r["licence"], len(r["words"]), norm, squares, telling) for at, w in enumerate(r["words"]) if w in needed]
    return spark.createDataFrame(out, "term string, shift int, template int, licence string, size int, norm double, "
                                      "weights array<struct<term: string, square: double>>, telling array<string>")


def near_spans(files: DataFrame, anchors: DataFrame, least: float, header_lines: int | None) -> DataFrame:
    """(key, at, licence, size, dot, shared, rest): spans of ``files`` that may reach ``least``, from what they share with a template.

    ``shared`` is the squared length of the shared part, ``rest`` the span's other terms, whose weights are still to come. As
    none weighs less than 1, most spans go here already.
    """
    wanted = sorted({r["term"] for r in anchors.select("term").distinct().collect()})  # as few as the templates' terms
    seen = folded(F.col("text"))
    if header_lines is not None:
        seen = F.when(F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)), seen).otherwise(F.substring_index(seen, "\n", header_lines))
    stated = files.select("key", seen.alias("seen")).where(F.col("seen").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(re.escape(t) for t in wanted)})(?![\p{{L}}\p{{N}}])"))
    worded = stated.select("key", words(F.col("seen")).alias("words"))
    keep = F.array(*[F.lit(t) for t in wanted])
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda p: F.array_contains(keep, p["w"]))
    met = worded.select("key", "words", F.explode(places).alias("p")).join(F.broadcast(anchors), F.col("p.w") == F.col("term"))
    begin = F.greatest(F.col("p.i") - F.col("shift"), F.lit(0))
    aligned = F.struct(begin.alias("at"), F.array_distinct(F.slice("words", begin + 1, F.col("size"))).alias("terms"))
    whole = F.struct(F.lit(0).alias("at"), F.array_distinct("words").alias("terms"))
    spans = F.when(F.size("words") <= 2 * F.col("size"), F.array(aligned, whole)).otherwise(F.array(aligned))
    cut = met.select("key", "licence", "size", "norm", "weights", "telling", F.explode(spans).alias("s"))
    cut = cut.where(F.size(F.array_except("telling", "s.terms")) == 0)
    both = F.filter("weights", lambda t: F.array_contains(F.col("s.terms"), t["term"]))
    part = cut.select("key", F.col("s.at").alias("at"), "licence", "size", "norm", F.aggregate(both, F.lit(0.0), lambda a, t: a + t["square"]).alias("part"),
                      F.array_sort(F.array_except("s.terms", F.transform("weights", lambda t: t["term"]))).alias("rest"))
    shared = F.col("part") * F.col("norm") ** 2
    reach = F.col("part") * F.col("norm") / F.sqrt(shared + F.size("rest"))
    other = F.exists("rest", lambda t: t.rlike(f"^(?:{KINDS})$"))
    return part.where((F.sqrt("part") >= least - 1e-6) & (reach >= least - 1e-6) & ~other).select(
        "key", "at", "licence", "size", (F.col("part") * F.col("norm")).alias("dot"), shared.alias("shared"), "rest")


def own_licences(files: DataFrame, templates: Mapping[str, tuple[str, ...]] | None = None, least: float = LEAST_COSINE,
                 header_lines: int | None = HEADER_LINES) -> DataFrame:
    """(key, licence, cosine, at): the best match of each text of ``files`` (key, path, text), one row for each text that has one.

    All of a text counts, or the first ``header_lines`` of files that are no licence file. ``at`` is the word at which the span
    begins. Equal cosines go to the longer template, then to the earlier span, then to the licence first by name.
    """
    spark = files.sparkSession
    rows = files.count()
    frequencies = store(document_frequencies(files), "frequencies")
    anchors = template_anchors(spark, default_templates() if templates is None else templates, frequencies, rows, least)
    spans = store(near_spans(files, anchors, least, header_lines), "spans")
    # Statements repeat: the terms that templates lack are weighed once for each different list of them, and what a list weighs goes
    # back by a salted join, as one statement, or none such term, may be that of a third of all spans.
    listed = spans.withColumn("list", value_key("rest"))
    lists = listed.where(F.size("rest") > 0).groupBy("list").agg(F.first("rest").alias("rest"))
    weighed = lists.select("list", F.explode("rest").alias("term")).join(frequencies, "term", "left")
    spare = store(weighed.groupBy("list").agg(F.sum(inverse_frequency(F.col("df"), rows) ** 2).alias("spare")), "lists")
    near = salted_join(listed.drop("rest"), spare, "list", spread_by="key", how="left").withColumn(
        "cosine", F.round(F.col("dot") / F.sqrt(F.col("shared") + F.coalesce("spare", F.lit(0.0))), 9)).where(F.col("cosine") >= least)
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("size")).alias("s"), "at", "licence")).alias("b"))
    return best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), F.col("b.at").alias("at"))


def folders(path: Column) -> Column:
    """The folders a path lies in, the nearest first, the root as an empty text last: ``a/b/c`` gives ``a/b``, ``a`` and the root."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: Mapping[str, tuple[str, ...]] | None = None, least: float = LEAST_COSINE,
         header_lines: int | None = HEADER_LINES, covers: Column | None = None) -> DataFrame:
    """(key, path, licence, cosine, at, covered_by): the licence of each row of ``files`` (key, path, text).

    A text's own licence counts first; ``covered_by`` is then its own path. Else the nearest folder that holds a
    text with a licence and ``covers`` (by default, a licence file's name) gives its licence; of several there, the one of the best
    cosine, then the first by path. Others have nulls. Null paths and paths without a folder lie in the root. Null and empty texts have no
    licence of their own. Rows with equal keys (null is one) share the best licence among them; an empty table gives an empty result.

    Folder licences are joined by path on narrow rows without texts. A folder that holds a third of all files meets one row of
    the folder table, and Spark may split such a key as the join stands alone before its aggregate.
    """
    covers = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)) if covers is None else covers
    own = store(own_licences(files, templates, least, header_lines), "licences")
    paths = files.select("key", "path", covers.alias("covers"))
    named = paths.join(own.withColumnRenamed("key", "_own"), F.col("key").eqNullSafe(F.col("_own")), "left").drop("_own")
    givers = named.where(F.col("covers") & F.col("licence").isNotNull()).select(
        F.get(folders(F.col("path")), F.lit(0)).alias("folder"), "licence", "cosine", "path")
    table = store(givers.groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("giver"), F.col("licence").alias("given"))).alias("g"))
                  .select("folder", "g.giver", "g.given"), "folders")
    homes = paths.select(F.get(folders(F.col("path")), F.lit(0)).alias("home")).distinct()
    above = F.when(F.col("home") == "", F.array().cast("array<string>")).otherwise(folders(F.col("home")))
    climbs = homes.select("home", F.posexplode(F.concat(F.array("home"), above)).alias("up", "folder"))
    nearest = climbs.join(table, "folder").groupBy("home").agg(F.min(F.struct("up", "giver", "given")).alias("n")).select("home", "n.giver", "n.given")
    placed = named.withColumn("home", F.get(folders(F.col("path")), F.lit(0))).join(nearest, "home", "left")
    return placed.select("key", "path", F.coalesce("licence", "given").alias("licence"), "cosine", "at",
                         F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("giver")).alias("covered_by"))
