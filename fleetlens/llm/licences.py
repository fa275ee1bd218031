"""Licence scans (3), native: normalised text against licence templates by Dice over word bigrams.

A document's units are its lines, its paragraphs of several lines, and the whole text if it has
several paragraphs.  A unit is lower-cased and cut into words of letters and digits; its measure
against a template is the Dice coefficient 2 |A and B| / (|A| + |B|) of their sets of word bigrams.

Two exact filters come first.  A unit at least ``threshold`` similar to a template shares at least
ceil(t / (2 - t) |B|) of its bigrams, so it has one of any |B| - that + 1 of them (those with the
longest words are taken), and the text has the longer word of one of these: one pass over the words
drops most documents, one over a unit's bigrams most units.  Then the size bounds t / (2 - t) |B| <= |A| <=
(2 - t) / t |B| prune the candidate templates.  The templates are a fixed list, constants of the
expressions: no join, no shuffle before the matches are gathered.

``scan`` measures units.  ``notices`` adds the notices that are no unit of their own (behind comment
signs, wrapped, inside a sentence): windows of the document's word sequence, in which every matched
unit is a break.  A window begins and ends with a bigram of the template and has from t / (2 - t) |B|
to (2 - t) / t |B| bigrams, repeated ones counted, in any place; all of them that reach the threshold
count, the best first (ties: equal markers, earlier template, earlier place, shorter), without those that share a word
with a better one.  A text without enough different bigrams of a template has no such window.

The best template names the family; its licence is reported where the matched words have exactly its
``MARKERS`` (version numbers, noncommercial, affero, lesser, ...), and only the family (GNU, BSD, CC, ...)
where they do not: a version that is not listed, a sentence that all variants share.  A unit with one of
the ``DENIALS`` ("not licensed") matches nothing, nor does a window with one inside or up to ``LOOK_BACK`` bigrams before it.

Null and empty texts and units of fewer than two words match nothing.  The best template of a unit
counts; if tied, one whose markers are the unit's, then the earlier listed.  Long texts are read whole.  Rows with a null id are reported
under a null id, repeated rows each.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_A_WORD = r"[^\p{L}\p{N}]+"

#: Notices of public licences, (licence, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                "later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
                "later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                 "option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                 "option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
]

#: Words that tell licences of one family apart.
MARKERS = ["1", "2", "3", "4", "5", "affero", "clause", "lesser", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike"]
#: Families of more than one licence, by the first part of the licence's name.
FAMILIES = {"GPL": "GNU", "LGPL": "GNU", "AGPL": "GNU"}
#: Bigrams that deny what follows.
DENIALS = ["not licensed", "not released", "not under", "never licensed", "never released", "longer licensed", "longer released", "nor licensed"]
LOOK_BACK = 3


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bounds(size: int, threshold: float) -> tuple[int, int, int]:
    """Smallest and largest unit, and the least number of shared bigrams, for a template of ``size`` bigrams."""
    ratio = threshold / (2 - threshold)
    return math.ceil(ratio * size - 1e-9), math.floor(size / ratio + 1e-9), math.ceil(ratio * size - 1e-9)


def _longest(bigram: str) -> str:
    return max(bigram.split(), key=lambda w: (len(w), w))


def _required(grams: list[str], listed: list[tuple[str, str]], shared: int) -> list[str]:
    """Bigrams of which every match has one: those with the longest words; of equal ones those that most
    templates have, so that fewer words are looked for."""
    spread = lambda g: sum(g in template_bigrams(text) for _, text in listed)
    return sorted(grams, key=lambda g: (-len(_longest(g)), -spread(g), g))[:len(grams) - shared + 1]


def template_markers(text: str) -> str:
    return " ".join(sorted(set(re.split(r"[^a-z0-9]+", text.lower())) & set(MARKERS)))


def family(licence: str) -> str:
    first = licence.split("-")[0]
    return FAMILIES.get(first, first)


def _marks(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, MARKERS)))), " ")


def _at(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def _licence(listed: list[tuple[str, str]], at: Column, words: Column) -> Column:
    """The licence of a template where the matched words have exactly its markers, else its family."""
    exact = _marks(words) == _at([template_markers(t) for _, t in listed], at)
    return F.when(exact, _at([n for n, _ in listed], at)).otherwise(_at([family(n) for n, _ in listed], at))


def _denied(grams: Column) -> Column:
    return F.arrays_overlap(grams, F.array(*map(F.lit, DENIALS)))


def _settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row: what stands above an explode is not merged
    with what stands below, where it would be computed again inside each lambda and each filter."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column | str) -> Column:
    return F.split(F.lower(text), NOT_A_WORD)


def _grams(words: Column | str) -> Column:
    """The bigrams in their order; "" where one of the words is a break ("")."""
    pair = lambda a, b: F.when(b.isNotNull(), F.when((a == "") | (b == ""), F.lit("")).otherwise(F.concat(a, F.lit(" "), b)))
    return F.array_compact(F.zip_with(words, F.slice(words, 2, F.size(words)), pair))


def windows(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``scan`` for windows outside the matched units; ``unit`` is window, ``matched`` its words."""
    listed = TEMPLATES if templates is None else templates
    entries, every, must, names = [], set(), set(), set()
    for i, (_, text) in enumerate(listed):
        grams = template_bigrams(text)
        if not grams:
            raise ValueError(f"template {i} has fewer than two words")
        low, high, shared = _bounds(len(grams), threshold)
        ranked = _required(grams, listed, shared)
        every.update(grams)
        must.update(ranked)
        names.update(map(_longest, ranked))
        entries.append(F.struct(F.lit(i).alias("at"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(shared).alias("shared"),
                                F.lit(len(grams)).alias("size"), F.array(*map(F.lit, grams)).alias("grams")))
    entries = F.array(*entries)
    named, must, every = (F.array(*map(F.lit, sorted(x))) for x in (names, must, every))
    common = lambda a, e: F.size(F.array_intersect(a, e["grams"]))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where(F.arrays_overlap(_words("t"), named))
    rows = _settled(rows, "words", F.array_remove(_words("t"), ""))
    rows = _settled(rows, "grams", F.array_intersect(_grams("words"), every)).where(F.arrays_overlap("grams", must))
    rows = _settled(rows, "near", F.transform(F.filter(entries, lambda e: common("grams", e) >= e["shared"]), lambda e: e["at"]))
    rows = rows.where(F.size("near") > 0).select("doc_id", "t", "near")

    def measured(g: Column) -> Column:
        fitting = F.filter(entries, lambda e: (e["low"] <= F.size(g)) & (F.size(g) <= e["high"]))
        return F.exists(fitting, lambda e: F.lit(2.0) * common(g, e) / (F.size(g) + e["size"]) >= threshold)

    def unit(text: Column) -> Column:   # scan reports it
        whole = lambda w: _let(F.array_distinct(_grams(F.array_remove(w, ""))), lambda g: measured(g) & ~_denied(g))
        return _let(_words(text), lambda w: F.when(F.arrays_overlap(w, named), whole(w)).otherwise(False))

    def left(parts: Column, inner) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.when(unit(p), F.array(F.lit(""))).otherwise(inner(p))))

    paragraphs = F.split("t", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*", -1)
    of_lines = lambda p: left(F.split(p, r"\r\n|\r|\n", -1), lambda x: F.array_remove(_words(x), ""))
    rows = rows.where((F.size(paragraphs) == 1) | ~unit(F.col("t")))
    rows = _settled(rows, "words", left(paragraphs, of_lines)).select("doc_id", "near", "words")
    rows = _settled(rows, "grams", _grams("words"))

    def begun(e: Column) -> Column:
        """Where a bigram of the template stands that has enough others of them in reach."""
        at = F.transform("grams", lambda g, i: F.when(F.array_contains(e["grams"], g), F.struct(
            i.alias("at"), F.slice("grams", i + 1, e["high"]).alias("run"))))
        return F.filter(at, lambda s: s.isNotNull() & (common(s["run"], e) >= e["shared"]))

    def ended(e: Column, s: Column) -> Column:
        run = s["run"]
        ends = F.filter(F.sequence(e["low"], F.size(run)), lambda n: F.array_contains(e["grams"], F.element_at(run, n))
                        & ~F.array_contains(F.slice(run, 1, n), F.lit("")))
        dice = lambda r, e: F.lit(-2.0) * common(r, e) / (F.size(F.array_distinct(r)) + e["size"])
        found = F.transform(ends, lambda n: F.struct(_let(F.slice(run, 1, n), lambda r: dice(r, e)).alias("less"),
                                                     e["at"].alias("template"), s["at"].alias("at"), n.alias("n")))
        return F.filter(found, lambda x: x["less"] <= -threshold)

    near = F.filter(entries, lambda e: F.array_contains("near", e["at"]))
    found = F.flatten(F.transform(near, lambda e: F.flatten(F.transform(begun(e), lambda s: ended(e, s)))))
    before = lambda x: F.greatest(x["at"] - LOOK_BACK, F.lit(0))
    found = F.filter(found, lambda x: ~_denied(F.slice("grams", before(x) + 1, x["at"] + x["n"] - before(x))))
    marks = [template_markers(text) for _, text in listed]
    vague = lambda x: _marks(F.slice("words", x["at"] + 1, x["n"] + 1)) != _at(marks, x["template"])
    rows = _settled(rows, "found", F.transform(found, lambda x: F.struct(x["less"], vague(x).alias("vague"), x["template"], x["at"], x["n"])))
    rows = _settled(rows.where(F.size("found") > 0), "found", F.array_sort("found"))
    apart = lambda a, x: (a["at"] + a["n"] < x["at"]) | (x["at"] + x["n"] < a["at"])
    best = F.aggregate("found", F.filter("found", lambda x: F.lit(False)),
                       lambda kept, x: F.when(F.forall(kept, lambda a: apart(a, x)), F.concat(kept, F.array(x))).otherwise(kept))
    rows = _settled(rows, "found", F.array_sort(F.transform(best, lambda x: F.struct(x["at"], x["n"], x["template"], x["less"]))))
    rows = rows.select("doc_id", "words", F.posexplode("found").alias("number", "x"))
    rows = rows.withColumn("words", F.slice("words", F.col("x.at") + 1, F.col("x.n") + 1))
    return rows.select("doc_id", F.lit("window").alias("unit"), "number", _licence(listed, F.col("x.template"), F.col("words")).alias("licence"),
                       F.col("x.template").alias("template"), (-F.col("x.less")).alias("dice"), F.array_join("words", " ").alias("matched"))


def notices(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The matched units (``scan``) and the matched windows outside of them."""
    given = (docs, templates, threshold, id_col, text_col)
    return scan(*given).unionByName(windows(*given))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, number, licence, template, dice, matched): the best template of every unit that has one.

    ``unit`` is line, paragraph or text, ``number`` counts them from 0 in the document, ``template``
    is the position in the list, ``matched`` the unit's text.
    """
    listed = TEMPLATES if templates is None else templates
    entries, must, names = [], set(), set()
    for i, (_, text) in enumerate(listed):
        grams = template_bigrams(text)
        if not grams:
            raise ValueError(f"template {i} has fewer than two words")
        low, high, shared = _bounds(len(grams), threshold)
        ranked = _required(grams, listed, shared)
        must.update(ranked)
        names.update(map(_longest, ranked))
        entries.append(F.struct(F.lit(i).alias("at"), F.lit(low).alias("low"), F.lit(high).alias("high"),
                                F.lit(len(grams)).alias("size"), F.lit(template_markers(text)).alias("marks"), F.array(*map(F.lit, grams)).alias("grams")))
    named = F.array(*map(F.lit, sorted(names)))
    words = lambda text: F.split(F.lower(text), NOT_A_WORD)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where(F.arrays_overlap(words("t"), named))

    def units(kind: str, parts: Column, wanted: Column) -> Column:
        return F.filter(F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), p.alias("matched"))),
                        lambda u: wanted(u["matched"]))

    lines = F.split("t", r"\r\n|\r|\n", -1)
    paragraphs = F.split("t", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*", -1)
    several = lambda p: p.rlike(r"[\r\n]")
    every = F.concat(units("line", lines, lambda p: F.lit(True)), units("paragraph", paragraphs, several),
                     F.when(F.size(paragraphs) > 1, units("text", F.array("t"), lambda p: F.lit(True))).otherwise(F.array()))
    found = rows.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.*")
    found = _settled(found, "words", words("matched")).where(F.arrays_overlap("words", named))
    found = _settled(found, "words", F.array_remove("words", ""))
    pair = lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))
    grams = F.zip_with("words", F.slice("words", 2, F.size("words")), pair)
    found = _settled(found, "grams", F.array_distinct(F.array_compact(grams)))
    found = found.where(F.arrays_overlap("grams", F.array(*map(F.lit, sorted(must)))) & ~_denied(F.col("grams")))
    size = F.size("grams")
    fitting = F.filter(F.array(*entries), lambda e: (e["low"] <= size) & (size <= e["high"]))
    measured = F.transform(fitting, lambda e: F.struct(
        (F.lit(2.0) * F.size(F.array_intersect("grams", e["grams"])) / (size + e["size"])).alias("dice"),
        (F.col("marks") == e["marks"]).alias("exact"), (-e["at"]).alias("at")))
    found = _settled(found, "marks", _marks(F.col("words")))
    found = _settled(found, "best", F.array_max(measured)).where(F.col("best.dice") >= threshold)
    return found.select("doc_id", "unit", "number", _licence(listed, -F.col("best.at"), F.col("words")).alias("licence"),
                        (-F.col("best.at")).alias("template"), F.col("best.dice").alias("dice"), "matched")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same rows, gathered by document and licence, as DuckDB SQL."""
    row = lambda i, name, text, grams: (f"({i}, {_literal(name)}, {_literal(family(name))}, {_literal(template_markers(text))}, "   # noqa: E731
                                        f"{_bounds(len(grams), 0.8)[1]}, [{', '.join(map(_literal, grams))}])")
    values = ", ".join(row(i, name, text, template_bigrams(text)) for i, (name, text) in enumerate(TEMPLATES))
    markers, denials = (", ".join(map(_literal, x)) for x in (MARKERS, DENIALS))
    return rf"""
WITH templates(place, name, family, marks, most, wanted) AS (VALUES {values}),
docs AS (
  SELECT doc_id, text, regexp_split_to_array(text, '(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*') AS paragraphs FROM documents),
units AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS u FROM docs
  UNION ALL SELECT doc_id, u FROM (SELECT doc_id, unnest(paragraphs) AS u FROM docs) WHERE regexp_matches(u, '[\r\n]')
  UNION ALL SELECT doc_id, text FROM docs WHERE len(paragraphs) > 1),
worded AS (SELECT row_number() OVER () AS unit, doc_id, list_filter(regexp_split_to_array(lower(u), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM units),
grams AS (
  SELECT unit, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g,
    array_to_string(list_sort(list_distinct(list_filter(w, lambda x: list_contains([{markers}], x)))), ' ') AS own
  FROM worded WHERE len(w) >= 2),
measured AS (
  SELECT unit, doc_id, CASE WHEN own = marks THEN name ELSE family END AS licence, own = marks AS exact, place, 2.0::DOUBLE * len(list_intersect(g, wanted)) / (len(g) + len(wanted)) AS dice
  FROM grams JOIN templates ON len(g) <= most AND list_has_any(g, wanted) AND NOT list_has_any(g, [{denials}])),
best AS (
  SELECT * FROM measured WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dice DESC, exact DESC, place) = 1)
SELECT doc_id, licence, count(*) AS n_units, max(dice) AS best_dice FROM best GROUP BY doc_id, licence
"""
