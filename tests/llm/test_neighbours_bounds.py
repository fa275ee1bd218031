"""Nearest neighbours: what a task gets stays bounded when vectors are equal or a cell is asked by many."""

import numpy as np
import pytest

from fleetlens.llm import neighbours


def found(spark, monkeypatch, vectors, asks, rows, **bounds):
    """The neighbours of the even ids; a task with a larger block or more asks of it fails."""
    with monkeypatch.context() as patch:
        for name, value in bounds.items():
            patch.setattr(neighbours, name, value)

        class Watched(neighbours.Block):
            def __init__(self, ids, *rest):
                super().__init__(ids, *rest)
                self.asked = 0
                if len(ids) > rows:
                    raise ValueError(f"block of {len(ids)} rows")

            def search(self, *given):
                self.asked += 1
                if self.asked > asks:
                    raise ValueError(f"more than {asks} asks")
                return super().search(*given)

        patch.setattr(neighbours, "Block", Watched)
        docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        out = {}
        for r in sorted(neighbours.nearest(docs, lambda c: c % 2 == 0, k=3).collect(), key=lambda r: (r.query_id, r.rank)):
            out.setdefault(r.query_id, []).append(r.vec_id)
        return out


def test_equal_vectors_are_one_ask(spark, monkeypatch):
    vectors = np.random.default_rng(3).normal(size=(60, 6))
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 900, axis=0)])
    got = found(spark, monkeypatch, vectors, asks=31, rows=64)
    same = [0, *range(60, 960)]
    assert len(got) == 480 and all(got[q] == [i for i in same if i != q][:3] for q in same if q % 2 == 0)


def test_asks_of_a_cell_are_dealt_out(spark, monkeypatch):
    vectors = np.random.default_rng(4).normal(size=(1200, 6))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got = found(spark, monkeypatch, vectors, asks=110, rows=300, BLOCK=150, ASKS=50)
    want = {q: [int(i) for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:3] for q in range(0, 1200, 2)}
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.95 * 3 * len(want)
    with pytest.raises(Exception, match="more than 110 asks"):
        found(spark, monkeypatch, vectors, asks=110, rows=300, BLOCK=150, ASKS=10**6)
