"""Licence notices that are no unit of their own: windows against brute force, headers, sentences."""

import math
import random
import re

from fleetlens.llm import catalog, licences

GRAMS = [set(licences.template_bigrams(t)) for _, t in licences.TEMPLATES]


def split(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def dices(a):
    return [2 * len(a & b) / (len(a) + len(b)) for b in GRAMS]


def is_unit(text):
    w = split(text)
    return max(dices(set(zip_words(w)))) >= 0.8 and not denied(zip_words(w))


def denied(grams):
    return any(g in licences.DENIALS for g in grams)


def exact(k, words):
    marks = [{m for m in licences.MARKERS if m in w} for w in (split(licences.TEMPLATES[k][1]), words)]
    return marks[0] == marks[1]


def named(k, words):
    """The licence of template k for a match of these words, or its family."""
    name = licences.TEMPLATES[k][0]
    return name if exact(k, words) else "GNU" if name.split("-")[0] in ("GPL", "LGPL", "AGPL") else name.split("-")[0]


def zip_words(w):
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def slow_windows(text):
    parts = re.split(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*", text)
    if len(parts) > 1 and is_unit(text):
        return []
    words = []
    for p in parts:
        for line in [p] if is_unit(p) else re.split(r"\r\n|\r|\n", p):
            words += [None] if is_unit(line) else split(line)
    found = []
    for at in range(len(words)):
        for k, b in enumerate(GRAMS):
            for n in range(math.ceil(len(b) / 1.5 - 1e-9), math.floor(len(b) * 1.5 + 1e-9) + 1):
                w = words[at:at + n + 1]
                if len(w) < n + 1 or None in w:
                    break
                g = zip_words(w)
                before = words[max(at - 3, 0):at]
                before = before[len(before) - before[::-1].index(None):] if None in before else before
                if g[0] in b and g[-1] in b and not denied(zip_words(before + w)) and (dice := 2 * len(set(g) & b) / (len(set(g)) + len(b))) >= 0.8:
                    found.append((-dice, not exact(k, w), k, at, n))
    kept = []
    for x in sorted(found):
        if all(a[3] + a[4] < x[3] or x[3] + x[4] < a[3] for a in kept):
            kept.append(x)
    kept.sort(key=lambda x: x[3])
    return [(i, named(k, words[at:at + n + 1]), k, -less, " ".join(words[at:at + n + 1])) for i, (less, _, k, at, n) in enumerate(kept)]


def wrapped(text, prefix, width):
    w = text.split()
    return "\n".join(prefix + " ".join(w[i:i + width]) for i in range(0, len(w), width))


MIT, GPL = licences.TEMPLATES[4][1], licences.TEMPLATES[6][1]


def test_headers_and_sentences_are_reported(spark):
    rows = [(1, "/*\n * Copyright (c) 2020 A. Body and others, all of them, everywhere.\n *\n" + wrapped(MIT, " * ", 9)
             + "\n *\n * The above notice shall be included in all copies or substantial portions of the Software.\n"
             + wrapped(" ".join(f"word{i}" for i in range(90)), " * ", 9) + "\n */\nint main() {}"),
            (2, "# tool, a small program that reads tables and writes charts, one at a time\n#\n" + wrapped(GPL, "# ", 11)
             + "\n#\n# This program is distributed in the hope that it will be useful, but without any warranty.\n"
             + wrapped(" ".join(f"word{i}" for i in range(90)), "# ", 9) + "\nimport os"),
            (3, "This small tool reads tables and writes charts. Released under the MIT License."),
            (4, "Released under the MIT License."), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.notices(docs).collect()
    assert sorted((r.doc_id, r.unit, r.licence) for r in got) == [
        (1, "window", "MIT"), (2, "window", "GPL-3.0"), (3, "window", "MIT"), (4, "line", "MIT")]
    assert {r.matched for r in got if r.doc_id == 3} == {"released under the mit license"}
    assert licences.notices(docs.limit(0)).count() == 0


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        pieces = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(licences.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["", "License", "zzz", "THE", "the", "not", "2", "NC"])
            text = " ".join(w)
            text = rng.choice([text, wrapped(text, "// ", 6), wrapped(text, " * ", 8), rng.choice(["some words before ", "this is not "]) + text + " and more after", text.upper()])
            pieces += [text, rng.choice(["other words here", "x " * 30, "", "under the license"])]
        rows.append((i, rng.choice(["\n", " ", "\n\n", "\r\n"]).join(pieces)))
    rows += [(80, rows[3][1]), (80, rows[3][1]), (None, rows[5][1]), (81, "Released under the MIT Released under the MIT License. " * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, unit string, template int")
    want = sorted((str(d), *x) for d, t in rows for x in slow_windows(t))
    found = licences.notices(docs).collect()
    got = sorted((str(r.doc_id), r.number, r.licence, r.template, r.dice, r.matched) for r in found if r.unit == "window")
    assert len(want) > 40 and got == want
    assert len(found) - len(got) == licences.scan(docs).count()


def test_query_reports_a_notice_inside_a_line(spark, scratch):
    spark.createDataFrame([(3, "It reads tables. Released under the MIT License.")], "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    got = catalog.QUERIES["op3_licence_scan"](spark, scratch).collect()
    assert [tuple(r[c] for c in ("doc_id", "licence", "n_units", "best_dice")) for r in got] == [(3, "MIT", 1, 1.0)]


OPENING = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}Public License as "
           "published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
CC = "This work is licensed under a Creative Commons Attribution{} {} International License."


def test_near_licences_are_told_apart(spark):
    cases = [(CC.format("", "4.0"), "CC-BY-4.0"), (CC.format("-NonCommercial", "4.0"), "CC-BY-NC-4.0"), (CC.format("-NoDerivatives", "4.0"), "CC-BY-ND-4.0"),
             (CC.format("-NonCommercial-NoDerivatives", "4.0"), "CC-BY-NC-ND-4.0"), (CC.format("-NonCommercial-ShareAlike", "4.0"), "CC-BY-NC-SA-4.0"),
             (CC.format("-NoDerivs", "3.0"), "CC"), (CC.format("", "3.0"), "CC"),
             (OPENING.format("General ", "2"), "GPL-2.0"), (OPENING.format("General ", "3"), "GPL-3.0"), (OPENING.format("Affero General ", "3"), "AGPL-3.0"),
             (OPENING.format("Lesser General ", "2.1"), "LGPL-2.1"), (OPENING.format("Lesser General ", "3"), "LGPL-3.0"), (OPENING.format("General ", "1"), "GNU"),
             (licences.TEMPLATES[10][1], "BSD"), ("Released under the 2-Clause BSD License.", "BSD-2-Clause"),
             ("This project is not licensed under the MIT License.", None), ("It is no longer released under the MIT License, sorry.", None),
             ("\n".join(["Released under the MIT License."] * 100), "MIT")]
    rows = [(i, text) for i, (text, _) in enumerate(cases)] + [(100 + i, "# a tool\n" + wrapped(text, "# ", 7) + "\n# by me") for i, (text, _) in enumerate(cases)]
    found = {}
    for r in licences.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.licence)
    assert [found.get(i) for i in range(len(cases))] == [None if x is None else {x} for _, x in cases]
    assert [found.get(100 + i) for i in range(len(cases) - 1)] == [None if x is None else {x} for _, x in cases[:-1]]
