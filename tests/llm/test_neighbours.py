"""Approximate nearest neighbours: recall and scores against brute force, edge rows."""

import math

import numpy as np

from fleetlens.llm import catalog, neighbours


def brute(ids, vectors, queries, k):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = {}
    for i, q in zip(ids, unit):
        if i in queries:
            score = unit @ q
            order = sorted((-round(s, 12), j) for j, s in zip(ids, score) if j != i)[:k]
            out[i] = [j for _, j in order]
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def gathered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_chi2():
    assert abs(neighbours.chi2_cdf(15.507, 8) - 0.95) < 1e-4 and abs(neighbours.chi2_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = catalog.QUERIES["op4_nearest_neighbours"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = np.array([r.embedding for r in rows], float)
    ids = [r.vec_id for r in rows]
    want = brute(ids, vectors, {i for i in ids if i % 50 == 0}, 5)
    assert recall(gathered(got), want) >= 0.95
    at = {i: v for i, v in zip(ids, vectors)}
    for r in got:
        a, b = at[r.query_id], at[r.vec_id]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_many_blocks_and_a_hot_vector(spark, monkeypatch):
    """A third of the rows are one vector: its cell is split, ties go to the smaller id."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    vectors = centres[rng.integers(0, 12, 2000)] + 0.4 * rng.normal(size=(2000, 24))
    vectors[:700] = vectors[0]
    rng.shuffle(vectors)
    docs = spark.createDataFrame([(i, v.tolist(), "x", 0.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, v string, score double")
    got = gathered(neighbours.nearest(docs.repartition(7), lambda c: c % 20 == 0).collect())
    want = brute(range(2000), vectors, set(range(0, 2000, 20)), 5)
    assert recall(got, want) >= 0.95
    same = [i for i, v in enumerate(vectors) if (v == vectors[[i for i in range(2000) if (vectors == vectors[i]).all(axis=1).sum() > 9][0]]).all()]
    for q in same:
        if q % 20 == 0:
            assert got[q] == [i for i in same if i != q][:5]


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, None]),
            (None, [1.0, 0.0]), (8, [1.0]), (9, []), (2, [0.0, 3.0]), (2, [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(docs, lambda c: c >= 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (1, 1, 0, 1.0), (1, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0)]
    assert neighbours.nearest(docs.limit(0), lambda c: c >= 0).count() == 0
    assert neighbours.nearest(docs.where("vec_id = 0"), lambda c: c >= 0).count() == 0


def test_extreme_components_equal_brute_force(spark):
    """Every vector is stretched by a power of ten from 1e-300 to 1e300: cosines stay those of the originals."""
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(200, 6))
    power = rng.integers(-300, 300, 200)
    stretched = [[float(f"{c:.15e}".split("e")[0]) * 10.0 ** (int(f"{c:.15e}".split("e")[1]) + int(p)) for c in v] for v, p in zip(plain, power)]
    docs = spark.createDataFrame(list(enumerate(stretched)), "vec_id long, embedding array<double>")
    rows = neighbours.nearest(docs, lambda c: c % 4 == 0, confidence=0.999).collect()
    assert recall(gathered(rows), brute(range(200), plain, set(range(0, 200, 4)), 5)) == 1
    unit = plain / np.linalg.norm(plain, axis=1)[:, None]
    assert all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-9 for r in rows)
    small = spark.createDataFrame([(0, [5e-324, 0.0]), (1, [1.7e308, 1.7e308]), (2, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(small, lambda c: c == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2] and all(abs(r.score - math.sqrt(0.5)) < 1e-15 for r in got)


def test_every_length_is_searched(spark, monkeypatch):
    """Vectors of three lengths mixed, in many blocks: neighbours are those of the query's own length."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=(3, 8, 17)[i % 3]).tolist()) for i in range(600)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = gathered(neighbours.nearest(docs.repartition(5), lambda c: c % 10 == 0).collect())
    want = {}
    for j in range(3):
        mine = [(i, v) for i, v in rows if i % 3 == j]
        want |= brute([i for i, _ in mine], np.array([v for _, v in mine]), set(range(0, 600, 10)), 5)
    assert len(got) == 60 and recall(got, want) >= 0.95
    monkeypatch.setattr(neighbours, "SAMPLE", 1)                 # two of the lengths are not in the sample
    assert recall(gathered(neighbours.nearest(docs, lambda c: c % 10 == 0).collect()), want) >= 0.95


def test_less_is_verified_with_less_confidence():
    """On clustered vectors the stopping test holds early; more projections and less confidence verify less."""
    rng = np.random.default_rng(10)
    x = neighbours._unit(rng.normal(size=(80, 64))[rng.integers(0, 80, 4000)] + 0.2 * rng.normal(size=(4000, 64)))
    share = {}
    for m, confidence in ((8, 0.95), (8, 0.5), (16, 0.5)):
        project = neighbours.directions(64, m)
        block = neighbours.Block(np.arange(4000), x, project)
        hits = 0
        for q in range(0, 4000, 100):
            ids, _ = block.search(x[q], x[q] @ project, 6, 4.0, neighbours.chi2_quantile(confidence, m))
            hits += len(set(ids.tolist()) & set(np.argsort(-(x @ x[q]), kind="stable")[:6].tolist()))
        share[m, confidence] = block.verified / (40 * 4000)
        assert hits >= 0.9 * 40 * 6
    assert share[8, 0.5] < share[8, 0.95] < 0.7
