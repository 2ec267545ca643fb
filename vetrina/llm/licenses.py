"""License scans: word-bigram Dice against licence templates, JVM-side throughout.

A text is compared as a whole, line by line, and by runs of words, so that a notice is found that is wrapped over lines
or has more words around it on its line. Normalising lower-cases A-Z and turns every ASCII sign, and
the signs and blanks of ``SIGN_RANGES`` (typographic quotes, dashes, no-break spaces and the like), into white space. A unit with a bigrams can reach a Dice coefficient of ``least``
with a template of b bigrams only if least / (2 - least) <= a / b <= (2 - least) / least; templates outside these bounds
are not compared.

A run of a template is a stretch of words, over line breaks, whose first and last bigrams are the template's: any other
stretch loses nothing by being cut down to one. It has (2 - least) / least times the template's bigrams at most, repeats
counted. Of the runs of a template with the same start the best stands, of equals the shortest; runs of all templates
that overlap are settled from the best down (of equals the template that comes last by name, then the first start). A
run within a line that matches, or that shares words with a line or text that matches as well or better, is not
reported again. Units are compared, and runs sought, only in texts with one of the words that a template cannot do
without, and runs only with least / (2 - least) of the template's bigrams in the text: nothing that matches lacks them.

Defined cases: null and empty texts match nothing; a unit of one word has no bigrams and matches nothing; bigrams count
once per unit; among equal coefficients the template that comes last by name wins; rows that repeat a doc_id share one
answer over all their units; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common

LEAST = 0.8

#: Notices and short texts of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Code points beyond ASCII that separate words as well: Latin-1 signs, general punctuation, currency signs, the trade mark,
#: ideographic punctuation, the byte order mark.
SIGN_RANGES = [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2122, 0x2122), (0x3000, 0x303F), (0xFEFF, 0xFEFF)]
#: Signs and white space but the line break, each of which separates words, and the upper-case letters.
_BREAKS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum() and chr(c) not in " \n") + "".join(chr(c) for a, b in SIGN_RANGES for c in range(a, b + 1))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = "array<struct<order: double, rank: int, first: int, last: int>>"
_MATCHED = "array<struct<first: int, last: int, dice: double, line: boolean>>"


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct bigrams of each template, which must be ASCII, by name."""
    out = {}
    for name, text in sorted(templates.items()):
        words = re.findall(r"[a-z0-9]+", text.lower())
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
    return out


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """The least and the greatest number of bigrams that can reach ``least`` against ``n``."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def _pairs(words: Column) -> Column:
    """The bigrams in their order, with repeats."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def needed_words(grams: list[str], least: float) -> list[str]:
    """Words of which a unit that reaches ``least`` against ``grams`` has one at least, the longest that there are."""
    left, out = list(grams), []
    while len(left) >= size_bounds(len(grams), least)[0]:
        out.append(max({w for g in left for w in g.split()}, key=lambda w: (len(w), w)))
        left = [g for g in left if out[-1] not in g.split()]
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _may_match(text: Column, known: dict[str, list[str]], least: float) -> Column:
    """Whether ``text`` has, maybe within a longer word, a word that some template needs."""
    some = {w for grams in known.values() for w in needed_words(grams, least)}
    return reduce(operator.or_, (F.contains(text, F.lit(w)) for w in sorted(some) if not any(v != w and v in w for v in some)))


def _has_needed(flat: Column, known: dict[str, list[str]], least: float) -> Column:
    """Whether ``flat``, cleaned words between single or more blanks with one at either end, has a word that some template needs."""
    some = {w for grams in known.values() for w in needed_words(grams, least)}
    return reduce(operator.or_, (F.contains(flat, F.lit(f" {w} ")) for w in sorted(some)))


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with ``value``, behind a generator: filters pushed down would compute it again at every use."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _dice(bigrams: Column, grams: list[str]) -> Column:
    return F.lit(2.0) * F.size(F.array_intersect(bigrams, F.array(*map(F.lit, grams)))) / (F.size(bigrams) + F.lit(len(grams)))


def _best(bigrams: Column, known: dict[str, list[str]], least: float) -> Column:
    """struct(dice, license) of the best template for distinct bigrams; null where their number fits none."""
    found = []
    for name, grams in known.items():
        found.append(F.when(F.size(bigrams).between(*size_bounds(len(grams), least)), F.struct(_dice(bigrams, grams).alias("dice"), F.lit(name).alias("license"))))
    return F.array_max(F.array(*found))


def _runs_of(pairs: Column, grams: list[str], length: int, rank: int, least: float) -> Column:
    """The best run of a template from each start: struct(order, rank, first, last), in words; order is minus the coefficient."""
    low = size_bounds(len(grams), least)[0]
    longest = math.floor(length * (2 - least) / least + 1e-9)
    own = F.array(*map(F.lit, grams))

    def run(start: Column) -> Column:
        piece = F.slice(pairs, start + 1, F.lit(longest))

        def best(piece: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.size(piece)), lambda n: (n >= low) & F.array_contains(own, F.get(piece, n - 1)))
            scored = F.transform(ends, lambda n: _let(F.array_distinct(F.slice(piece, F.lit(1), n)), lambda g: F.struct((-_dice(g, grams)).alias("order"), n.alias("n"))))
            return F.array_min(scored)

        return _let(piece, best)

    def of(hits: Column) -> Column:
        starts = F.filter(hits, lambda s, k: F.get(hits, k + (low - 1)) < s + longest)
        runs = F.transform(starts, lambda s: _let(run(s), lambda r: F.struct(r["order"].alias("order"), F.lit(-rank).alias("rank"), s.alias("first"), (s + r["n"] + 1).alias("last"))))
        return F.filter(runs, lambda r: r["order"] <= -least)

    hits = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.array_contains(own, F.get(pairs, i)))
    enough = F.size(F.array_intersect(pairs, own)) >= low
    return F.when(enough, _let(hits, of)).otherwise(F.expr("array()").cast(_RUNS))


def runs(rows: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """Runs of words that match and are not part of what is reported otherwise: doc_id, license, dice.

    ``rows`` has doc_id and the cleaned text.
    """
    known = template_bigrams(templates)
    rows = _once(rows, F.transform(F.split("_text", "\n"), _words), "_lines")
    rows = _once(rows, _let(F.flatten("_lines"), _pairs), "_pairs")
    lengths = {name: len(re.findall(r"[a-z0-9]+", templates[name].lower())) - 1 for name in known}
    every = [_runs_of(F.col("_pairs"), grams, lengths[name], k, least) for k, (name, grams) in enumerate(known.items())]
    rows = _once(rows, F.array_sort(F.concat(*every)), "_runs").where(F.size("_runs") > 0)

    def matched(first: Column, words: Column, pairs: Column, line: bool) -> Column:
        best = lambda g: F.when(_best(g, known, least)["dice"] >= least, F.array(F.struct(first.alias("first"), (first + F.size(words)).alias("last"), _best(g, known, least)["dice"].alias("dice"), F.lit(line).alias("line"))))
        return F.coalesce(_let(F.array_distinct(pairs), best), F.expr("array()")).cast(_MATCHED)

    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast(_MATCHED).alias("found"))
    step = lambda s, words: F.struct((s["at"] + F.size(words)).alias("at"), F.concat(s["found"], matched(s["at"], words, _pairs(words), True)).alias("found"))
    lines = F.aggregate("_lines", start, step, lambda s: s["found"])
    rows = _once(rows, F.concat(lines, matched(F.lit(0), F.flatten("_lines"), F.col("_pairs"), False)), "_matched")
    overlap = lambda a, b: (a["first"] < b["last"]) & (b["first"] < a["last"])
    known_by = lambda m, r: (m["line"] & (m["first"] <= r["first"]) & (r["last"] <= m["last"])) | (overlap(m, r) & (m["dice"] >= -r["order"]))
    fresh = F.filter("_runs", lambda r: ~F.exists("_matched", lambda m: known_by(m, r)))
    settled = F.aggregate(fresh, F.expr("array()").cast(_RUNS), lambda kept, r: F.when(F.exists(kept, lambda k: overlap(k, r)), kept).otherwise(F.concat(kept, F.array(r))))
    names = F.array(*map(F.lit, known))
    return _once(rows, settled, "_settled").select("doc_id", F.explode("_settled").alias("_run")).select("doc_id", F.get(names, -F.col("_run.rank")).alias("license"), (-F.col("_run.order")).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """What matches: doc_id, unit (0: the whole text of several lines, null: a run of words, else the line's number), license, dice."""
    known = template_bigrams(templates)
    bounds = [size_bounds(len(grams), least) for grams in known.values()]
    fewest, most = min(low for low, _ in bounds), max(high for _, high in bounds)
    clean = F.translate(F.coalesce("text", F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    # Lower case alone is cheap, and keeps every needed word that the cleaned text has.
    some = _once(docs.select("doc_id", "text"), F.lower("text"), "_lower").where(_may_match(F.col("_lower"), known, least))
    texts = _once(some, clean, "_text").drop("text", "_lower")
    texts = _once(texts, F.concat(F.lit(" "), F.translate("_text", "\n", " "), F.lit(" ")), "_flat").where(_has_needed(F.col("_flat"), known, least)).drop("_flat")
    lines = F.split(F.col("_text"), "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.translate("_text", "\n", " ")), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    rows = texts.select("doc_id", F.posexplode(units).alias("unit", "_line")).where(_may_match(F.col("_line"), known, least))
    rows = rows.select("doc_id", "unit", _words(F.col("_line")).alias("_words"))
    # n distinct words make n - 1 distinct bigrams at least: units beyond every template's bounds build none.
    rows = rows.where((F.size("_words") > fewest) & (F.size(F.array_distinct("_words")) <= most + 1))
    rows = rows.select("doc_id", "unit", _bigrams(F.col("_words")).alias("_bigrams"))
    rows = rows.select("doc_id", "unit", _best(F.col("_bigrams"), known, least).alias("_best")).where(F.col("_best.dice") >= least)
    rows = rows.select("doc_id", "unit", F.col("_best.license").alias("license"), F.col("_best.dice").alias("dice"))
    return rows.unionByName(runs(texts, templates, least), allowMissingColumns=True)


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_matches (units and runs that match), license and dice of the best (null if none)."""
    found = scan(docs, templates, least).groupBy(F.col("doc_id").alias("_id"))
    found = found.agg(F.count("*").alias("n_matches"), F.max(F.struct("dice", "license")).alias("_best"))
    rows = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return rows.select("doc_id", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("_best.license").alias("license"), F.round("_best.dice", 6).alias("dice"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(common.table(spark, sf_dir, "documents"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The scan of whole texts and lines in SQL, comparing every unit with every template.

    Runs of words within a text are not in it: it equals ``licenses`` on tables where notices fill lines or texts, as on
    the driver's. Runs are held against a plain search in the tests.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, g))}])" for n, g in template_bigrams(templates).items())
    breaks = " || ".join(f"chr({ord(c)})" for c in _BREAKS)
    return f"""
WITH templates(license, grams) AS (VALUES {rows}),
clean AS (
  SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}' || {breaks}, '{_UPPER.lower()}' || repeat(' ', {len(_BREAKS)})) AS t
  FROM documents),
units AS (
  SELECT doc_id, unnest(CASE WHEN contains(t, chr(10)) THEN list_append(string_split(t, chr(10)), replace(t, chr(10), ' ')) ELSE [t] END) AS line
  FROM clean),
words AS (SELECT doc_id, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM units),
grams AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM words WHERE len(w) > 1),
best AS (
  SELECT doc_id, max({{'dice': dice, 'license': license}}) AS b
  FROM (SELECT row_number() OVER () AS u, doc_id, g FROM grams) JOIN templates ON TRUE,
       LATERAL (SELECT 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice)
  GROUP BY doc_id, u HAVING max(dice) >= {least}),
found AS (SELECT doc_id, count(*) AS n_matches, max(b) AS b FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, b.license AS license, round(b.dice, 6) AS dice
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
