"""Substring dedup against a brute-force version."""

import hashlib
import random

from fleetlens.llm import catalog, substrings


def slow(rows, window):
    """[(doc_id, text)] -> sorted [(doc_id, n_words, n_removed, kept)]."""
    first = {}
    for i, t in rows:
        ws = (t or "").encode().split()
        for p in range(len(ws) - window + 1):
            k = tuple(ws[p:p + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = set()
        for p in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[p:p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((str(i), len(ws), len(gone), kept.decode()))
    return sorted(out)


def random_rows(seed, n=40):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefé") + rng.choice("xyz") for _ in range(k)] for k in (12, 13, 14, 30, 60, 200)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                ws += p[rng.randrange(5):len(p) - rng.randrange(5)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(ws)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[4][1]), (n + 2, None), (n + 3, ""), (None, rows[3][1]),
             (n + 4, "a " * 500), (n + 5, "a " * 40)]
    rng.shuffle(rows)
    return rows


def test_lengths():
    assert substrings.lengths(13) == [7, 13] and substrings.lengths(50) == [7, 13, 25, 50] and substrings.lengths(5) == [5]


def test_dedup_equals_brute_force(spark):
    for seed, window in ((1, 13), (2, 13), (3, 4), (4, 30)):
        rows = random_rows(seed)
        docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, found int, k1 string").repartition(5)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs, window).collect())
        assert got == slow(rows, window)


def test_small_chunks(spark, monkeypatch):
    """Every document combined alone: all sharing is found by the shuffle."""
    rows = random_rows(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs).collect()) == slow(rows, 13)


def test_longest_repeats(spark):
    rows = random_rows(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    length = 13
    while True:
        seen = {}
        for i, t in rows:
            ws = (t or "").split()
            for p in range(len(ws) - length + 1):
                if i is not None:
                    seen.setdefault(tuple(ws[p:p + length]), set()).add(i)
        alive = {i for s in seen.values() if len(s) > 1 for i in s}
        if not alive:
            break
        want.update(dict.fromkeys(alive, length))
        length *= 2
    assert {r.doc_id: r.longest for r in substrings.longest_repeats(docs).collect()} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(empty).count() == 0 and substrings.longest_repeats(empty).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.QUERIES["op2_substring_dedup"](spark, sf).collect()
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in slow(rows, 13)]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
