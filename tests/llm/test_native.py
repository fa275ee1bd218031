"""Licence scan and decontamination: brute force on edge rows, the oracles on the tables."""

import random
import re

import duckdb
import pytest

from fleetlens.llm import catalog, contamination, licences
from .test_licence_windows import exact, named

SF = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def slow_shingles(text):
    w = split(text or "")
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_contained(docs, items, threshold=0.8):
    classes = {}
    for i, t in items:
        if i is not None and t is not None and split(t):
            classes.setdefault(tuple(split(t)), []).append(i)
    out = {}
    for w, ids in classes.items():
        s = slow_shingles(" ".join(w))
        for d, t in docs:
            n = len(s & slow_shingles(t))
            if d is not None and n >= round(threshold * len(s), 9):
                out[d, min(ids)] = max(n, out.get((d, min(ids)), (0,) * 4)[3] if (d, min(ids)) in out else 0), len(ids), len(s)
                n_max = out[d, min(ids)]
                out[d, min(ids)] = (min(ids), n_max[1], n_max[2], n_max[0])
    return sorted((d, *v) for (d, _), v in out.items())


def contamination_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(40)]
    items += [(40, items[7][1].upper() + "!"), (41, None), (42, ""), (43, "... --"), (None, items[8][1]), (7, items[7][1])]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.choice([0, 3, 30, 300, 3000]))]
        for _ in range(rng.randint(0, 3)):
            p = items[rng.randrange(40)][1].split()
            cut = rng.choice([0, 0, 1, 2, 5, 8])
            body[(at := rng.randint(0, len(body))):at] = p[cut // 2:len(p) - cut + cut // 2]
        docs.append((i, " ".join(body)))
    docs += [(60, docs[5][1]), (61, None), (62, ""), (None, items[3][1]), (5, items[9][1]), (63, items[0][1].title() + ". ")]
    return docs, items


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contained_items_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", limit)
    docs, items = contamination_rows()
    d = spark.createDataFrame([(*r, 1, "h") for r in docs], "doc_id long, text string, item_id int, words string")
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    got = contamination.contained_items(d, q).collect()
    want = slow_contained(docs, items)
    assert len(want) > 20
    assert sorted((r.doc_id, r.item_id, r.n_items, r.n_shingles, r.n_found) for r in got) == want
    assert all(r.containment == r.n_found / r.n_shingles for r in got)


def test_contamination_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert contamination.contained_items(d, q).count() == 0
    assert contamination.contained_items(some, q).count() == 0
    assert contamination.contained_items(d, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def slow_licences(rows):
    out = []
    for d, t in rows:
        if t is None:
            continue
        parts = re.split(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*", t)
        units = [("line", i, u) for i, u in enumerate(re.split(r"\r\n|\r|\n", t))]
        units += [("paragraph", i, u) for i, u in enumerate(parts) if re.search(r"[\r\n]", u)]
        units += [("text", 0, t)] if len(parts) > 1 else []
        for kind, i, u in units:
            w = split(u)
            a = {f"{x} {y}" for x, y in zip(w, w[1:])}
            best = max(((2 * len(a & set(b)) / (len(a) + len(b)), exact(k, w), -k) for k, b in enumerate(licences.template_bigrams(x) for _, x in licences.TEMPLATES)))
            if best[0] >= 0.8 and not a & set(licences.DENIALS):
                out.append((str(d), kind, i, named(-best[2], w), best[0]))
    return sorted(out)


def test_licences_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(100):
        text = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(licences.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(["", "License", "zzz", "THE", "3", "not"])
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), "\n")
            text.append(rng.choice([" ".join(w), " ".join(w).upper(), "nothing to see here", "", "x " * 400]))
        rows.append((i, rng.choice(["\n", "\r\n", "\n\n", "\n \n\n", " "]).join(text)))
    rows += [(90, None), (91, ""), (92, "license"), (None, "Released under the MIT License."), (93, "Released under the MIT License."), (93, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, licence string, dice double")
    got = licences.scan(docs)
    assert got.columns == ["doc_id", "unit", "number", "licence", "template", "dice", "matched"]
    want = slow_licences(rows)
    assert len(want) > 50 and sorted((str(r.doc_id), r.unit, r.number, r.licence, r.dice) for r in got.collect()) == want
    assert licences.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got and got == sorted(result.fetchall())


def test_native_queries_run_no_python(spark):
    for name in ("op3_licence_scan", "op6_decontaminate"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
