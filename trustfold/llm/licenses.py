"""Licence scans by the Dice coefficient of word bigrams, in DataFrame functions only.

Texts are compared line by line and as a whole. A unit and a template are
lower-cased, cut into runs of letters and digits, and turned into bags A and B
of word bigrams, as large as their words less one. The coefficient
2|A n B| / (|A| + |B|) can reach s only if |A| lies between s / (2 - s) and
(2 - s) / s times |B|: units outside the bounds of all templates are dropped by
counting their words, before bigrams are made, and a bigram meets only
templates whose bounds hold the unit.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.llm.common import broadcast_if_small, let, row_key, stored

SCORE = 0.8

#: Common notices of public licences.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """The files of license_texts in order of their names: <license>.txt, or <license>.<part>.txt."""
    texts = sorted((f for f in (files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return tuple((f.name.removesuffix(".txt").removesuffix(".header").removesuffix(".grant"), f.read_text(encoding="utf-8")) for f in texts)


#: The notices, then whole licences and whole headers.
TEMPLATES: tuple[tuple[str, str], ...] = NOTICES + full_texts()


def normal(text: Column) -> Column:
    """Lower-cased runs of letters and digits, one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring words of a text of two words or more, in order."""
    words = F.split(normal(text), " ")
    pair = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: pair(w, i)))


def bigram_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")) - 1


def template_grams(templates: DataFrame, score: float) -> DataFrame:
    """(template, license, size, low, high, gram, times): low and high bound the sizes that can match."""
    sized = templates.withColumn("size", bigram_count(F.col("text"))).where("size >= 1")
    low, high = F.ceil(F.col("size") * (score / (2 - score)) - 1e-9), F.floor(F.col("size") * ((2 - score) / score) + 1e-9)
    rows = sized.select("template", "license", "size", low.cast("int").alias("low"), high.cast("int").alias("high"), F.explode(bigrams(F.col("text"))).alias("gram"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))


def _within(n: Column, bounds: list) -> Column:
    """Whether ``n`` lies in one of the bounds, merged where they meet."""
    merged: list[list[int]] = []
    for low, high in sorted((b["low"], b["high"]) for b in bounds):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    inside = F.lit(False)
    for low, high in merged:
        inside = inside | n.between(low, high)
    return inside


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, license string, text string")


def licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", score: float = SCORE) -> DataFrame:
    """(id_col, line, license, template, dice): the best template of each unit that reaches ``score``.

    A unit is a line, numbered from 0, or the whole text of several lines, as line -1. ``templates`` has template (a
    number), license and text; ties go to the least template. Units and templates of fewer than two words match nothing, nor do
    null or empty texts. Rows equal in id and text count as one. Empty tables give an empty result. Other columns are not read.
    """
    grams = stored(template_grams(templates, score))
    bounds = grams.select("low", "high").distinct().collect()  # one row a size of template at most
    rows = docs.select(row_key(docs, id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = F.split("text", "\n")
    whole = F.when(F.size(lines) > 1, F.col("text"))
    units = rows.select("row", "id", F.posexplode(F.concat(F.array(whole), lines)).alias("at", "unit"))
    sized = units.select("row", "id", (F.col("at") - 1).alias("line"), "unit", bigram_count(F.col("unit")).alias("n")).where(_within(F.col("n"), bounds))
    met = sized.select("row", "id", "line", "n", F.posexplode(bigrams(F.col("unit"))).alias("pos", "gram")).join(broadcast_if_small(grams, 100_000), "gram")
    same = met.where("n BETWEEN low AND high").groupBy("row", "id", "line", "n", "template", "license", "size", "times", "gram").agg(
        F.count_distinct("pos").alias("here"))  # rows equal in id and text count once
    both = same.groupBy("row", "id", "line", "n", "template", "license", "size").agg(F.sum(F.least("here", "times")).alias("shared"))
    both = both.withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("size")))
    best = F.max_by(F.struct("template", "license", "dice"), F.struct("dice", -F.col("template")))
    return both.where(F.col("dice") >= score).groupBy("row", "id", "line").agg(best.alias("b")).select(
        F.col("id").alias(id_col), "line", F.col("b.license").alias("license"), F.col("b.template").alias("template"), F.col("b.dice").alias("dice"))
