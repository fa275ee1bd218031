"""Quality classifier: the estimator on a known mixture, edge rows, held-out quality."""

import numpy as np

from fleetlens.llm import catalog, quality

SF = "/root/testdata/sf0.1"


def test_features_of_pieces(monkeypatch):
    text = "Some Text, 123 with mañana!\n".encode() * 50
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 17)
    np.testing.assert_allclose(quality.features(text), whole, rtol=1e-5)
    assert np.isfinite(quality.features(None)).all() and np.array_equal(quality.features(None), quality.features(b""))


def test_risk_finds_the_negatives_in_the_unlabelled():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(2000, 5)), rng.normal(size=(2000, 5)) + np.array([3, 0, 0, 0, 0])
    positive, unlabelled = good[:800], np.concatenate([good[800:], bad[:300]])
    w, b = quality.minimise(positive, unlabelled, 0.8)
    assert (quality.sigmoid(good @ w + b) >= 0.5).mean() > 0.9 and (quality.sigmoid(bad @ w + b) < 0.5).mean() > 0.8


def test_edge_rows(spark):
    rows = [(1, "fine words here"), (2, None), (3, ""), (None, "no id"), (1, "fine words here"), (4, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality.learn(docs, labels).score(docs).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    none = quality.learn(docs, labels.limit(0))
    assert {r.score for r in none.score(docs).collect()} == {0.5} and none.score(docs.limit(0)).count() == 0
    empty = quality.learn(docs.limit(0), labels)
    assert {r.score for r in empty.score(docs).collect()} == {0.5}


def test_held_out_quality(spark):
    got = catalog.QUERIES["op10_quality"](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert len(held) > 800
    assert np.mean([r.predicted == 1 for r in held if r.quality == 1]) > 0.98
    assert np.mean([r.predicted == 0 for r in held if r.quality == 0]) > 0.93
