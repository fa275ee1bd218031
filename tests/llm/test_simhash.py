"""SimHash near-dedup against a brute-force version."""

import random

import numpy as np
import xxhash

from fleetlens.llm import catalog, simhash
from fleetlens.llm.graph import components


def slow_print(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(pairs):
    """[(id, fingerprint)] -> ids' smallest reachable id."""
    prints = sorted({p for _, p in pairs})
    low = {p: min((i for i, q in pairs if q == p and i is not None), default=None) for p in prints}
    near = {p: [q for q in prints if (p ^ q).bit_count() <= 3] for p in prints}
    out = {}
    for p in prints:
        seen, todo = {p}, [p]
        while todo:
            for q in near[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        out[p] = min((low[q] for q in seen if low[q] is not None), default=None)
    return out


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for text in [None, "", "  \t\n", "One", "one TWO", "É é x y", *(" ".join(rng.choice("abcdé") for _ in range(n)) for n in (3, 4, 50, 999))]:
        assert simhash.fingerprint(None if text is None else text.encode()) == slow_print(text)


def test_spark_hash_is_the_same_xxh64(spark):
    words = ["", "a", "abc d ef", "é" * 40, "x" * 31]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").collect()
    assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.w.encode(), 42) for r in got)


def test_bucket_links_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for i, j in rng.integers(0, 63, (12, 2))]))
    rng.shuffle(prints)
    bucket = np.sort(rng.integers(0, 3, len(prints)))
    hi, root = simhash.bucket_links(prints, bucket, 3)
    parent = {i: i for i in range(len(prints))}
    for h, r in zip(hi, root):
        assert bucket[h] == bucket[r]
        parent[int(h)] = int(r)
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if bucket[i] == bucket[j] and int(prints[i] ^ prints[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert [parent[i] for i in range(len(prints))] == label


def test_near_duplicates_with_hot_buckets(spark):
    """A chain and a dense group of near fingerprints, with every bucket divided to the last level."""
    rng = random.Random(5)
    words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(400)]
    texts = [" ".join(words)]
    for _ in range(60):
        w = words[:]
        w[rng.randrange(400)] = "x" + str(rng.randrange(9))
        texts.append(" ".join(w))
    texts += ["one two three", "one two three", "", None, " ", "lonely words stand here"]
    rows = [(i + 10, t, "k", i) for i, t in enumerate(texts)] + [(None, texts[0], "k", 1), (None, "no one else", "k", 2), (10, texts[0], "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, root long")
    want = slow_components([(i, slow_print(t)) for i, t, *_ in rows])
    for split_at in (4, 4096):
        got = simhash.near_duplicates(docs, split_at=split_at).collect()
        assert sorted((str(r.doc_id), r.fingerprint % 2**64, str(r.component_id)) for r in got) == sorted(
            (str(i), slow_print(t), str(want[slow_print(t)])) for i, t, *_ in rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(200).selectExpr("id * 7 % 201 a", "(id + 1) * 7 % 201 b")
    got = components(links.union(spark.createDataFrame([(5, None), (900, 900), (901, 902), (902, 901)], "a long, b long"))).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(201)} | {(901, 901), (902, 901)} and len(got) == 203


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = slow_components([(r.doc_id, slow_print(r.text)) for r in rows])
    got = catalog.QUERIES["op1_simhash_near_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (r.doc_id, f"{slow_print(r.text):016x}", want[slow_print(r.text)]) for r in rows)
