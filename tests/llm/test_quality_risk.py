"""Quality classifier: risk and gradient against plain versions, sums over all rows, the prior from positives and unlabelled."""

import zlib

import numpy as np

from fleetlens.llm import quality
from fleetlens.llm.common import texts

SF = "/root/testdata/sf0.001"


def slow_risk(w, positive, unlabelled, prior):
    """(pi R_p(+), R_u(-) - pi R_p(-)), a row at a time."""
    def loss(x, y):
        return sum(np.log1p(np.exp(-y * (x[i] @ w[:-1] + w[-1]))) for i in range(len(x))) / len(x)

    return prior * loss(positive, 1), loss(unlabelled, -1) - prior * loss(positive, -1)


def test_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(size=(40, 4)) + 0.5, rng.normal(size=(90, 4))
    signs = set()
    for prior in (0.3, 0.95):
        for _ in range(6):
            w = rng.normal(size=5)
            signs.add(slow_risk(w, positive, unlabelled, prior)[1] >= 0)
            one = np.c_[unlabelled, np.ones(90)]
            got = quality.step_gradient(w, np.c_[positive, np.ones(40)], quality.negative_sums(one, w) / 90, prior)

            def goal(w, sign=slow_risk(w, positive, unlabelled, prior)[1] >= 0, prior=prior):
                plus, minus = slow_risk(w, positive, unlabelled, prior)
                return plus + minus if sign else -minus

            want = [(goal(w + 1e-6 * e) - goal(w - 1e-6 * e)) / 2e-6 for e in np.eye(5)]
            np.testing.assert_allclose(got, want, atol=1e-6)
    assert signs == {True, False}


def test_sums_cover_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 7)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r.text or "").encode() for r in docs.select("text").collect()]
    x = np.stack([quality.features(t) for t in data]).astype(float)
    rows = texts(docs.repartition(5)).selectExpr("cast(crc32(coalesce(text, cast('' as binary))) % 2 as int) as half", "text")
    blocks = quality._blocks(rows)
    np.testing.assert_allclose(quality._sum(blocks, lambda x: x.sum(axis=0, dtype=float), quality.WIDTH), x.sum(axis=0), rtol=1e-5)
    odd = np.array([zlib.crc32(t) % 2 for t in data])
    assert quality._sum(blocks.where("half = 1"), lambda x: np.array([len(x)]), 1)[0] == odd.sum()
    w = np.random.default_rng(1).normal(size=quality.WIDTH + 1) / 10
    want = quality.negative_sums(np.c_[x, np.ones(len(x))], w)
    got = quality._sum(blocks, lambda x: quality.negative_sums(quality._one(x), w), quality.WIDTH + 2)
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-4)
    assert quality._sum(blocks.limit(0), lambda x: np.array([len(x)]), 1)[0] == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.85):
        positive, unlabelled = rng.normal(2, 1, 4000), np.r_[rng.normal(2, 1, int(20000 * share)), rng.normal(-2, 1, int(20000 * (1 - share)))]
        counts = [np.histogram(np.clip(v, -10, 10), quality.EDGES)[0] for v in (unlabelled, positive)]
        assert abs(quality.best_ratio(*counts) - share) < 0.04
    assert quality.best_ratio(np.zeros(200), np.zeros(200)) == 0.5


def test_labels_zero_do_not_matter_and_repeated_ids_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 6)
    monkeypatch.setattr(quality, "PRIOR_STEPS", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = docs.orderBy("doc_id").limit(1)
    docs = docs.union(one).union(one)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40)], "doc_id long, quality int")
    zeros = spark.createDataFrame([(i, 0) for i in range(40, 60)], "doc_id long, quality int")
    a, b = quality.learn(docs, labels), quality.learn(docs, labels.union(zeros))
    assert abs(a.prior - b.prior) < 1e-9
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-6)
    few = quality.learn(docs, labels, max_positives=5)
    assert np.isfinite(few.weights).all() and 0 < few.prior < 1
