"""Licence scans: normalised text against licence templates, by the Dice coefficient of word bigrams.

What is compared is each line of a document, the document as a whole where it has several lines, and in what lies between
matching lines each paragraph (lines up to one without letters and digits), then, between matching paragraphs, every run of
words that begins with a bigram of a template and is two thirds to three halves as long, in five steps. So notices wrapped over
lines and notices inside longer lines are found. Both sides are normalised (small ASCII letters and digits, everything
else, line breaks and comment marks too, is a space) and become sets of word bigrams. A unit reaches the threshold t with
a template of w bigrams only if it has w * t / (2 - t) of them: texts without as many for any template leave first, and so do
rests and starts of runs. A text that lacks a bigram with a number of the template is of another version and does not
match; a unit carries the name of the template it is most like.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and short licence texts that are looked for unless others are given: name, text. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
]
THRESHOLD = 0.8
#: Templates of up to so many characters in all are constants of the plan; others meet the texts by joins on bigrams.
MOST_CONSTANT = 20_000
#: Lengths of runs of words, as shares of the length of a template.
RUNS = (2 / 3, 5 / 6, 1, 5 / 4, 3 / 2)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pairs(text):
    """The word bigrams of a text column, in order."""
    words = F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    # The last word has no other after it.
    return F.filter(pairs, lambda p: p.isNotNull())


def bigrams(text):
    """The distinct word bigrams of a text column."""
    return F.array_distinct(_pairs(text))


def _candidates(docs: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text, wanted: the texts that can match, each with the templates (licence, pairs, length, least) it can match."""
    sets = templates.select("licence", _pairs(F.col("text")).alias("all")).filter(F.size("all") > 0)
    # A hair below the bound, for rounding; the coefficient itself decides.
    least = F.ceil(F.size("pairs") * F.lit(threshold / (2 - threshold)) - 1e-6).cast("int")
    sets = sets.select("licence", F.array_distinct("all").alias("pairs"), F.size("all").alias("length"))
    sets = sets.withColumns({"least": least, "numbered": F.filter("pairs", lambda p: p.rlike(r"\d"))})
    if templates.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] <= MOST_CONSTANT:
        rows = sets.collect()
        if not rows:
            return docs.limit(0).select("doc_id", "text", F.array().cast(_WANTED).alias("wanted"))
        constants = [F.struct(F.lit(r.licence).alias("licence"), F.array(*map(F.lit, r.pairs)).alias("pairs"), F.array(*map(F.lit, r.numbered)).cast("array<string>").alias("numbered"), F.lit(r.length).alias("length"), F.lit(r.least).alias("least")) for r in rows]
        every = F.array(*map(F.lit, sorted({p for r in rows for p in r.pairs})))
        # Unfolding a list of one keeps what is found as a column: it is worked out once, not wherever it is used.
        hits = docs.select("doc_id", "text", F.explode(F.array(F.array_intersect(_pairs(F.col("text")), every))).alias("hits"))
        hits = hits.filter(F.size("hits") >= min(r.least for r in rows))
        near = F.filter(F.array(*constants), lambda t: F.size(F.array_intersect("hits", t["pairs"])) >= t["least"])
        return hits.select("doc_id", "text", F.explode(F.array(near)).alias("wanted")).filter(F.size("wanted") > 0)
    # Rows of one id and text are one document.
    keyed = docs.withColumn("key", F.sha2("text", 256)).dropDuplicates(["doc_id", "key"])
    sets = sets.withColumn("template", F.sha2(F.to_json(F.struct("licence", "pairs", "length")), 256)).dropDuplicates(["template"])
    common = keyed.select("doc_id", "key", F.explode(bigrams(F.col("text"))).alias("pair")).join(
        sets.select("template", "least", F.explode("pairs").alias("pair")), "pair"
    )
    enough = common.groupBy("doc_id", "key", "template").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).filter("n >= least")
    wanted = enough.select("doc_id", "key", "template").join(sets, "template").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("licence", "pairs", "numbered", "length", "least")).alias("wanted")
    )
    return keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "text", "wanted")


_WANTED = "array<struct<licence: string, pairs: array<string>, numbered: array<string>, length: int, least: int>>"
_HITS = "array<struct<licence: string, dice: double>>"
_CUT = "\x01"


def _matches(found, threshold):
    """licence, dice of the templates in `wanted` that a set of bigrams matches."""
    scored = F.transform("wanted", lambda t: F.struct(t["licence"].alias("licence"), _score(found, t).alias("dice")))
    return F.filter(scored, lambda m: m["dice"] >= threshold)


def _named(kind, hits):
    """unit, licence, dice of the matches of numbered units."""
    return F.flatten(F.transform(hits, lambda h, i: F.transform(h, lambda m: F.struct(F.concat(kind, i.cast("string")).alias("unit"), m["licence"].alias("licence"), m["dice"].alias("dice")))))


def _between(parts, hits, mark):
    """The parts that match nothing, joined up to those that match."""
    kept = F.transform(parts, lambda p, i: F.when(F.size(F.element_at(hits, i + 1)) > 0, F.lit(_CUT)).otherwise(p))
    return F.split(F.array_join(kept, mark), _CUT)


def _possible(found):
    """The templates in `wanted` of which a list of bigrams has enough."""
    every = F.array_distinct(F.flatten(F.transform("wanted", lambda t: t["pairs"])))
    own = F.transform(F.array(F.array_intersect(found, every)), lambda hits: F.filter("wanted", lambda t: F.size(F.array_intersect(hits, t["pairs"])) >= t["least"]))
    return F.flatten(own)


def _runs(rest, wanted, threshold):
    """group (runs that overlap have one number), licence, dice of the runs of words that match the templates `wanted`. A run
    begins with a bigram of the template and has `least` of them, so it is scored only if as many stand near enough."""
    def of(t):
        at = F.filter(F.transform(rest, lambda p, i: F.when(F.array_contains(t["pairs"], p), i + 1)), lambda i: i.isNotNull())

        def scored(places, share):
            length = F.ceil(t["length"] * F.lit(share)).cast("int")
            starts = F.filter(places, lambda i, k: F.get(places, k + t["least"] - 1) < i + length)
            dice = F.transform(starts, lambda i: F.struct(i.alias("start"), (i + length).alias("end"), t["licence"].alias("licence"), _score(F.array_distinct(F.slice(rest, i, length)), t).alias("dice")))
            return F.filter(dice, lambda m: m["dice"] >= threshold)

        # The places are worked out once, as the element of a list of one.
        return F.flatten(F.transform(F.array(at), lambda places: F.concat(*[scored(places, share) for share in RUNS])))

    found = F.array_sort(F.flatten(F.transform(wanted, of)))
    none = F.array().cast("array<struct<group: int, licence: string, dice: double>>")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("group"), none.alias("out"))

    def take(so_far, m):
        group = F.when(m["start"] < so_far["end"], so_far["group"]).otherwise(so_far["group"] + 1)
        return F.struct(
            F.greatest(so_far["end"], m["end"]).alias("end"),
            group.alias("group"),
            F.concat(so_far["out"], F.array(F.struct(group.alias("group"), m["licence"].alias("licence"), m["dice"].alias("dice")))).alias("out"),
        )

    return F.aggregate(found, start, take, lambda x: x["out"])


def scan_licences(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches (lines, whole text, paragraphs and runs of words that match a licence; overlapping runs are one,
    and what lies in a matching larger or earlier kind of unit is not counted again), licences (names, sorted, comma-joined), best
    (the licence of the highest coefficient, the first by name among equals) and best_dice, for every row.

    Null, empty and one-word texts match nothing: 0, "", null, null. Rows that share an id are one document, and so are
    rows without an id; each row gets what the document has. Templates are (licence, text), any number of each licence; null
    or one-word templates match nothing. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    if templates is None:
        known = [F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in TEMPLATES]
        templates = spark.range(1).select(F.inline(F.array(*known)))
    texts = _candidates(docs.select("doc_id", "text"), templates.select("licence", "text"), threshold)
    lines = texts.select("doc_id", "wanted", F.split(F.translate("text", _CUT, " "), "\n").alias("lines"))
    lines = lines.withColumn("hits", F.transform("lines", lambda x: _matches(bigrams(x), threshold)))
    whole = F.when(F.size("lines") > 1, _matches(bigrams(F.array_join("lines", "\n")), threshold)).otherwise(F.array().cast(_HITS))
    lines = lines.withColumn("whole", whole)
    # Wrapped notices: only where the whole text is none. All in one pass: each step is a column of the row.
    steps = lines.withColumn("parts", F.when(F.size("whole") == 0, _between(F.col("lines"), F.col("hits"), "\n")).otherwise(F.array().cast("array<string>")))
    steps = steps.withColumn("parts", F.transform("parts", lambda x: F.split(x, r"\n(?:[^A-Za-z0-9\n]*\n)+")))
    steps = steps.withColumn("inner", F.transform("parts", lambda ps: F.transform(ps, lambda x: _matches(bigrams(x), threshold))))
    rest = F.flatten(F.transform("parts", lambda ps, i: _between(ps, F.element_at("inner", i + 1), "\n")))
    steps = steps.withColumn("rest", F.transform(rest, _pairs))
    # Most of what is left has not enough bigrams of any template.
    possible = F.filter(F.transform("rest", lambda x: F.struct(x.alias("pairs"), _possible(x).alias("wanted"))), lambda x: F.size(x["wanted"]) > 0)
    steps = steps.withColumn("possible", possible)
    steps = steps.withColumn("runs", F.transform("possible", lambda x: _runs(x["pairs"], x["wanted"], threshold)))
    units = F.concat(
        _named(F.lit("line"), F.col("hits")),
        _named(F.lit("whole"), F.array("whole")),
        F.flatten(F.transform("inner", lambda hits, i: _named(F.concat(F.lit("paragraph"), i.cast("string"), F.lit(".")), hits))),
        F.flatten(F.transform("runs", lambda runs, i: F.transform(runs, lambda m: F.struct(F.concat(F.lit("run"), i.cast("string"), F.lit("."), m["group"].cast("string")).alias("unit"), m["licence"].alias("licence"), m["dice"].alias("dice"))))),
    )
    matches = steps.select("doc_id", F.inline(units))
    # A unit is of the licence that it is most like, the first by name among equals.
    top = F.min(F.struct((-F.col("dice")).alias("less"), "licence")).alias("top")
    of_unit = matches.groupBy("doc_id", "unit").agg(top).select("doc_id", "unit", "top.licence", (-F.col("top.less")).alias("dice"))
    of_doc = of_unit.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count_distinct("unit").alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
        F.min(F.struct((-F.col("dice")).alias("less"), "licence")).alias("top"),
    )
    return docs.select("doc_id").join(of_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("licences", F.lit("")).alias("licences"),
        F.col("top.licence").alias("best"),
        (-F.col("top.less")).alias("best_dice"),
    )


def _score(found, template):
    """The Dice coefficient, 0 where the text lacks a bigram with a number of the template: another version."""
    dice = F.size(F.array_intersect(found, template["pairs"])) * 2 / (F.size(found) + F.size(template["pairs"]))
    return F.when(F.size(F.array_except(template["numbered"], found)) == 0, dice).otherwise(F.lit(0.0))
