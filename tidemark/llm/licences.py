"""Licence scan: normalised lines against licence templates by Dice coefficient over word bigrams. SQL functions only."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, whole_text

THRESHOLD = 0.8

# Usual notices of public licences and the texts of three short ones.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """(licence, number within it, distinct word bigrams of the normalised text), all on the driver: a short list."""
    out = []
    for licence, texts in templates.items():
        for i, t in enumerate(texts):
            w = re.sub("[^a-z0-9]+", " ", t.lower()).strip().split(" ")
            out.append((licence, i, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))))
    return [r for r in out if r[2]]


def line_bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def licence_hits(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, template, dice) for every line of every text that reaches ``threshold`` with a template.

    Dice is 2 * common / (a + b) on distinct bigrams, so only sizes between b * t / (2 - t) and b * (2 - t) / t can reach t:
    a line outside all templates' sizes is dropped, and each template is tried only on lines within its own. A line's
    words bound its bigrams from above, which drops most lines before any bigram is built. All of it is one narrow stage.
    """
    rows = template_rows(templates)
    low = min(len(b) for _, _, b in rows) * threshold / (2 - threshold)
    high = max(len(b) for _, _, b in rows) * (2 - threshold) / threshold
    lines = docs.select("doc_id", F.explode(F.split(whole_text(), "\n")).alias("line"))
    norm = F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " "))
    lines = lines.select("doc_id", norm.alias("norm")).where(F.length(F.regexp_replace("norm", "[a-z0-9]+", "")) >= low)   # blanks = words - 1
    # A long line needs at least ``low`` bigrams of a template; a template's rarest word need not be there, so all count.
    lines = lines.select("doc_id", F.explode(F.array(line_bigrams(F.split("norm", " ")))).alias("b")).where(F.size("b").between(low, high))

    def one(licence: str, i: int, bigrams: list[str]) -> Column:
        m, n = len(bigrams), F.size("b")
        within = n.between(m * threshold / (2 - threshold), m * (2 - threshold) / threshold)
        dice = 2.0 * F.size(F.array_intersect("b", F.array(*map(F.lit, bigrams)))) / (n + m)
        return F.when(within, F.struct(F.lit(licence).alias("licence"), F.lit(i).alias("template"), dice.alias("dice")))

    hits = F.filter(F.array(*[one(*r) for r in rows]), lambda x: x["dice"] >= threshold)
    return lines.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.licence", "h.template", "h.dice")


def licence_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, licence (best match; ties by name), dice, n_hits (line and template pairs), licences (sorted).

    Null and empty texts, and texts without a matching line, have a null licence, n_hits 0 and an empty list. Rows that
    share a doc_id all carry the hits of that doc_id. Nothing but hits is shuffled, never a text.
    """
    hits = licence_hits(docs, templates, threshold)
    per_doc = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"),
                                         F.sort_array(F.collect_set("licence")).alias("licences"),
                                         F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("best"))
    per_doc = per_doc.select(F.col("doc_id").alias("doc_id_"), F.col("best.licence").alias("licence"), (-F.col("best.d")).alias("dice"), "n_hits", "licences")
    return (docs.select("doc_id").join(per_doc, F.expr("doc_id <=> doc_id_"), "left")
            .select("doc_id", "licence", F.round("dice", 6).alias("dice"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                    F.concat_ws(",", "licences").alias("licences")))


def op7_licence_scan(spark, sf_dir):
    return licence_scan(table(spark, sf_dir, "documents"))


def scan_sql() -> str:
    values = ",\n  ".join("('{}', {}, [{}])".format(a, i, ", ".join(f"'{g}'" for g in b)) for a, i, b in template_rows())
    return f"""WITH t(licence, template, g) AS (VALUES {values}),
 l AS (SELECT doc_id, string_split(trim(regexp_replace(lower(u.line), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) u),
 b AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM l WHERE len(w) BETWEEN 2 AND 100000),
 h AS (SELECT doc_id, licence, 2.0 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM b, t
  WHERE len(b) BETWEEN len(g) * {THRESHOLD} / (2 - {THRESHOLD}) AND len(g) * (2 - {THRESHOLD}) / {THRESHOLD}),
 d AS (SELECT doc_id, count(*) AS n_hits, max(dice) AS dice, min_by(licence, (-dice, licence)) AS licence,
  string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM h WHERE dice >= {THRESHOLD} GROUP BY 1)
 SELECT doc_id, licence, round(CAST(dice AS DOUBLE), 6) AS dice, coalesce(n_hits, 0) AS n_hits, coalesce(licences, '') AS licences
 FROM documents LEFT JOIN d USING (doc_id)"""
