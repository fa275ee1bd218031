"""Kneser-Ney scores against a dictionary version; the model beats the base on held-out texts."""

import math
import os
import random
from collections import Counter

import numpy as np

from fleetlens.llm import catalog, kneser_ney


class Slow:
    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for t in texts:
            ws = self.cut(t)
            self.c.update(ws)
            self.b.update(zip([" end", *ws], ws))
        self.t = Counter(w for _, w in self.b)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d2 = kneser_ney.discounts([sum(x == k for x in self.b.values()) for k in (1, 2, 3, 4)])
        self.d1 = kneser_ney.discounts([sum(x == k for x in self.t.values()) for k in (1, 2, 3, 4)])

    @staticmethod
    def cut(t):
        return [w.decode() for w in (t or "").encode().lower().split()] + [" end"]

    def low(self, w):
        if not self.b:
            return 1 / (self.v + 1)
        left = sum(self.d1[min(x, 3)] for x in self.t.values()) / len(self.b)
        x = self.t[w]
        return max(0, x - self.d1[min(x, 3)]) / len(self.b) + left / (self.v + 1)

    def p(self, u, w):
        if not self.c[u]:
            return self.low(w)
        x = self.b[u, w]
        left = sum(self.d2[min(y, 3)] for (a, _), y in self.b.items() if a == u)
        return max(0, x - self.d2[min(x, 3)]) / self.c[u] + left / self.c[u] * self.low(w)

    def score(self, t):
        ws = self.cut(t)
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in ws)
        return len(ws), sum(self.c[w] > 0 for w in ws), self.n, base, sum(math.log10(self.p(u, w)) for u, w in zip([" end", *ws], ws))


def test_packing():
    for x in ([], [0], [5, 5, 9], [1, 2**63, 2**64 - 1]):
        assert kneser_ney.unpack(kneser_ney.pack(np.array(x, np.uint64))).tolist() == x


def test_scores_equal_the_dictionary_version(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 500)
    rng = random.Random(3)
    vocabulary = ["The", "the", "of", "é"] + [chr(97 + i) * 2 for i in range(20)]
    text = lambda: " ".join(rng.choices(vocabulary, weights=range(24, 0, -1), k=rng.randint(0, 30)))
    rows = [(i, text()) for i in range(150)] + [(150, None), (151, ""), (3, "same id"), (None, "no id the of")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n_tokens int, score double").repartition(4)
    model = kneser_ney.train(docs)
    slow = Slow([t for _, t in rows])
    extra = [(200, "unknown words the the of"), (201, "the"), (202, "zz " * 3000)]
    got = model.score(docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))).collect()
    want = sorted((str(i), *slow.score(t)) for i, t in rows + extra)
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    np.testing.assert_allclose([h[4:] for h in have], [w[4:] for w in want], rtol=1e-9)
    # the probabilities of all known words and of one unknown add to one, after known and unknown contexts
    for u in ("the", "ee", "nowhere"):
        assert abs(sum(slow.p(u, w) for w in [*slow.c, "unknown"]) - 1) < 1e-9
    model.delete()
    assert not os.path.exists(model.folder)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = kneser_ney.train(none)
    assert model.score(none).count() == 0
    got = model.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)


def test_query_beats_the_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["op9_lm_score"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 50 < len(held) < 150
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
