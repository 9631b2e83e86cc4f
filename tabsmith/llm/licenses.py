"""Licence scan by Dice coefficient over word bigrams (operator 9), in column expressions only.

Each line of a text, and the whole text, is normalised (lower case, runs of other
characters than a-z and 0-9 become one space) and compared with licence
templates: ``2 * common / (bigrams of the unit + bigrams of the template)`` over
the sets of word bigrams.  A unit of u words has at most u - 1 bigrams, and a
template of t bigrams can reach the coefficient ``LEAST`` only with
``t * LEAST / (2 - LEAST) <= bigrams <= t * (2 - LEAST) / LEAST``: units too
short for every template, or too long, are never cut into bigrams, and the
others meet the templates of a fitting size only.

``passages`` finds the notices that are no unit of their own: runs of consecutive
words of the whole text, across line ends and within lines, against the notices
and the full-length texts of ``license_texts``.  A run has at most
``t * (2 - LEAST) / LEAST`` bigrams.  The best run begins and ends with a bigram
of the template, so only such runs are compared; from each start all ends are
scored in one pass, since a bigram is new in a run if its previous place lies
before the start.  A text is searched for a template only if it has
``t * LEAST / (2 - LEAST)`` of its bigrams.  Of overlapping passages of one
template the better one stays, then the first.

All comparisons happen within a row: nothing is shuffled, broadcast or exploded,
so copies and frequent lines cost no more than their own text.

Edge rows: null, empty and wordless texts have no licence.  Ties go to the first
template, then to the whole text, then to the first line.  Repeated rows get the
same result; other columns pass through in ``row``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import query, table
from .host_quality import let
from .license_texts import TEXTS
from .shared import quoted

LEAST = 0.8

#: Short notices of common licences: fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
)


def _bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _bounds(t: int, least: float) -> tuple[float, float]:
    return t * least / (2 - least), t * (2 - least) / least


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``row`` (the input row as a struct), ``found`` (licence, dice and unit of every hit, best first), n_units.

    Unit 0 is the whole text, unit i its i-th line.
    """
    sets = [_bigrams(t) for _, t in templates]
    low = min(_bounds(len(s), least)[0] for s in sets)
    high = max(_bounds(len(s), least)[1] for s in sets)
    #: repeated bigrams make a unit longer than its set: the upper bound holds for the set only
    table_ = F.array(*[F.struct(F.lit(-i).alias("rank"), F.lit(name).alias("license"), F.lit(len(s)).alias("size"), F.array(*map(F.lit, s)).alias("grams")) for i, ((name, _), s) in enumerate(zip(templates, sets))])

    def grams(words: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))))

    def dice(unit: Column) -> Column:
        """Hits of one unit, given its set of bigrams and number."""
        g = unit["g"]
        fits = F.filter(table_, lambda t: (F.size(g) >= t["size"] * (least / (2 - least))) & (F.size(g) <= t["size"] * ((2 - least) / least)))
        score = lambda t: F.lit(2.0) * F.size(F.array_intersect(t["grams"], g)) / (F.size(g) + t["size"])
        hits = F.transform(fits, lambda t: F.struct(score(t).alias("dice"), t["rank"].alias("rank"), (-unit["i"]).alias("unit"), t["license"].alias("license")))
        return F.filter(hits, lambda h: h["dice"] >= least)

    def of_units(units: Column) -> Column:
        words = F.transform(units, lambda u, i: F.struct(i.alias("i"), F.split(u, " ").alias("w")))
        # the cheap test on words first; a set of more than `high` bigrams is left out by the second
        words = F.filter(words, lambda u: F.size(u["w"]) - 1 >= low)
        sets_ = F.transform(words, lambda u: F.struct(u["i"].alias("i"), grams(u["w"]).alias("g")))
        sets_ = F.filter(sets_, lambda u: F.size(u["g"]) <= high)
        return F.flatten(F.transform(sets_, dice))

    text = F.coalesce(quoted(text_col), F.lit(""))
    units = F.concat(F.array(normalised(text)), F.transform(F.split(text, "\n", -1), normalised))
    hits = F.sort_array(let(units, of_units), asc=False)
    found = F.transform(hits, lambda h: F.struct(h["license"].alias("license"), h["dice"].alias("dice"), (-h["unit"]).alias("unit")))
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), found.alias("found"))


def passages(docs: DataFrame, text_col: str = "text", templates=TEMPLATES + TEXTS, least: float = LEAST) -> DataFrame:
    """``row`` (the input row as a struct) and ``found``: licence, dice, first word and number of words of every passage.

    The passage with the most bigrams of its template comes first, then the best dice: a whole text before a sentence of it.

    Words are those of the normalised text, from 0.
    """
    sets = [_bigrams(t) for _, t in templates]
    bounds = [_bounds(len(s), least) for s in sets]
    table_ = F.array(*[
        F.struct(F.lit(-i).alias("rank"), F.lit(name).alias("license"), F.lit(len(s)).alias("size"), F.lit(math.ceil(low - 1e-9)).alias("need"),
                 F.lit(math.floor(high + 1e-9)).alias("most"), F.array(*map(F.lit, s)).alias("grams"))
        for i, ((name, _), s, (low, high)) in enumerate(zip(templates, sets, bounds))
    ])
    all_ = F.array(*map(F.lit, dict.fromkeys(g for s in sets for g in s)))

    def grams(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))
        return F.when(F.size(words) >= 2, pairs)

    def linked(g: Column) -> Column:
        """Place, previous place of the same bigram (or -1) and bigram, by place."""
        by_gram = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        last = lambda s, x, k: F.when((k > 0) & (F.get(s, k - 1)["g"] == x["g"]), F.get(s, k - 1)["i"]).otherwise(F.lit(-1))
        return let(by_gram, lambda s: F.sort_array(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), last(s, x, k).alias("prev"), x["g"].alias("g")))))

    def best(marked: Column, start: Column, t: Column) -> Column:
        """The best run from a start: dice, start and end; the shortest of equal ones."""
        new = F.filter(F.slice(marked, start + 1, t["most"]), lambda x: x["prev"] < start)
        ends = F.filter(F.transform(new, lambda x, r: F.struct(x["i"].alias("i"), x["hit"].alias("hit"), (r + 1).alias("n"))), lambda x: x["hit"])
        scored = F.transform(ends, lambda x, k: F.struct((F.lit(2.0) * (k + 1) / (x["n"] + t["size"])).alias("dice"), (-x["i"]).alias("end"), (k + 1).alias("common")))
        return let(F.array_max(scored), lambda x: F.struct(x["dice"].alias("dice"), start.alias("start"), (-x["end"]).alias("end"), x["common"].alias("common")))

    def apart(acc: Column, h: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        added = F.concat(acc, F.array(h))
        better = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(h))
        return F.when(F.size(acc) == 0, added).when(last["end"] < h["start"], added).when(h["dice"] > last["dice"], better).otherwise(acc)

    def of_template(places: Column, t: Column) -> Column:
        marked = F.transform(places, lambda x: F.struct(x["i"].alias("i"), x["prev"].alias("prev"), F.array_contains(t["grams"], x["g"]).alias("hit")))

        def search(m: Column) -> Column:
            hits = F.transform(F.filter(m, lambda x: x["hit"]), lambda x: x["i"])
            starts = let(hits, lambda p: F.filter(p, lambda i, a: F.get(p, a + t["need"] - 1) < i + t["most"]))
            good = F.filter(F.transform(starts, lambda i: best(m, i, t)), lambda h: h["dice"] >= least)
            return F.aggregate(good, F.array().cast("array<struct<dice:double,start:int,end:int,common:int>>"), apart)

        named = lambda h: F.struct(h["common"].alias("common"), h["dice"].alias("dice"), t["rank"].alias("rank"), (-h["start"]).alias("start"), (h["end"] - h["start"] + 2).alias("words"), t["license"].alias("license"))
        return F.transform(let(marked, search), named)

    def of_grams(g: Column) -> Column:
        fits = lambda c: F.filter(table_, lambda t: F.size(F.array_intersect(t["grams"], c)) >= t["need"])
        found = lambda f: F.when(F.size(f) > 0, let(linked(g), lambda w: F.flatten(F.transform(f, lambda t: of_template(w, t)))))
        return let(let(F.array_intersect(g, all_), fits), found)

    words = F.split(normalised(F.coalesce(quoted(text_col), F.lit(""))), " ")
    hits = let(let(words, grams), of_grams)
    found = F.transform(F.sort_array(hits, asc=False), lambda h: F.struct(h["license"].alias("license"), h["dice"].alias("dice"), (-h["start"]).alias("start"), h["words"].alias("words")))
    empty = F.array().cast("array<struct<license:string,dice:double,start:int,words:int>>")
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.coalesce(found, empty).alias("found"))


def _sql() -> str:
    rows = ",\n  ".join("({}, '{}', [{}])".format(i, name, ", ".join(f"'{g}'" for g in _bigrams(t))) for i, (name, t) in enumerate(TEMPLATES))
    return f"""
WITH tpl(k, license, grams) AS (VALUES
  {rows}),
u AS (
  SELECT doc_id, i - 1 AS unit, trim(regexp_replace(lower(([coalesce(text, '')] || string_split(coalesce(text, ''), chr(10)))[i]), '[^a-z0-9]+', ' ', 'g')) AS x
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 2)) AS t(i)),
w AS (SELECT doc_id, unit, string_split(x, ' ') AS w FROM u WHERE contains(x, ' ')),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) <= 400),
h AS (
  SELECT doc_id, unit, k, license, 2.0::DOUBLE * len(list_intersect(tpl.grams, g.g)) / (len(g.g) + len(tpl.grams)) AS dice FROM g, tpl),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k, unit) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM h WHERE dice >= {LEAST})
SELECT d.doc_id, b.license, round(b.dice, 9) AS dice, CAST(b.unit AS BIGINT) AS unit, CAST(coalesce(b.n, 0) AS BIGINT) AS n_hits
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1"""


@query("op9_licenses", _sql())
def op9_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs).select("row.doc_id", F.get("found", F.lit(0)).alias("f"), F.size("found").cast("long").alias("n_hits"))
    return out.select("doc_id", "f.license", F.round("f.dice", 9).alias("dice"), F.col("f.unit").cast("long").alias("unit"), "n_hits")


@query("op9_license_passages")
def op9_license_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = passages(docs).select("row.doc_id", F.get("found", F.lit(0)).alias("f"), F.size("found").cast("long").alias("n_passages"))
    return out.select("doc_id", "f.license", F.round("f.dice", 9).alias("dice"), F.col("f.start").cast("long").alias("start"), F.col("f.words").cast("long").alias("words"), "n_passages")
