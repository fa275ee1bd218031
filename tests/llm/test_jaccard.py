"""N-gram Jaccard join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from fleetlens.llm import jaccard
from fleetlens.llm.jaccard import Law

LAW = Law(85, 100)
SCHEMA = "doc_id long, text string, n int, k1 string, h int, key int, c int"


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def slow(rows, num=85, den=100, k=4):
    classes, sets = defaultdict(list), [shingles(t, k) for _, t in rows]
    for (doc, _), s in zip(rows, sets):
        if s:
            classes[s].append(doc)
    keys = list(classes)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            same = len(a & keys[j])
            if same and den * same >= num * (len(a) + len(keys[j]) - same):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, s in enumerate(keys):
        ids = [x for x in classes[s] if x is not None] + ([low[find(i)]] if low.get(find(i)) is not None else [])
        low[find(i)] = min(ids, default=None)
    at = {s: find(i) for i, s in enumerate(keys)}
    return sorted(map(str, ((doc, len(s), low[at[s]] if s else doc) for (doc, _), s in zip(rows, sets))))


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    return sorted(map(str, (tuple(r) for r in jaccard.join(frame, **more).collect())))


def edited(rng, seq, edits):
    seq = list(seq)
    for _ in range(edits):
        p = rng.randrange(len(seq))
        kind = rng.random()
        if kind < 0.6:
            seq[p] = f"w{rng.randrange(900)}"
        elif kind < 0.8:
            del seq[p]
        else:
            seq.insert(p, f"v{rng.randrange(900)}")
        seq = seq or ["x"]
    return seq


def made(rng, bases, copies, sizes):
    rows = []
    for b in range(bases):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice(sizes))]
        for _ in range(copies):
            rows.append((len(rows) * 3 % 1009, " ".join(edited(rng, base, rng.randint(0, 1 + len(base) // 30)))))
    return rows


def test_equals_all_pairs_on_near_copies_at_the_threshold(spark):
    rng = random.Random(11)
    rows = made(rng, 40, 6, [3, 5, 9, 14, 25, 40, 60, 90, 140, 400]) + made(rng, 1, 120, [80])
    passage = " ".join(f"common{i}" for i in range(30))
    rows += [(5000 + i, f"{passage} " + " ".join(f"w{rng.randrange(900)}" for _ in range(30))) for i in range(60)]
    rows += [(9000, None), (9001, ""), (9002, " \t "), (9003, "One"), (9004, "oNE"), (None, "one"), (9005, "É x y z w"), (9006, "é x y z w"),
             (9007, "a b c"), (9008, "a b c d"), (9009, "long word " * 40000), (9009, "long word " * 40000), (None, rows[3][1]), (None, "nobody else has this")]
    want = slow(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, split_at=16) == want
    assert len({x.rsplit(", ", 1)[1] for x in want}) < len(rows) - 100


def test_other_thresholds_and_lengths(spark):
    rng = random.Random(12)
    rows = made(rng, 25, 5, [4, 12, 30, 70])
    assert got(spark, rows, shingle=2, num=6, den=10) == slow(rows, 6, 10, 2)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("law", [LAW, Law(6, 10)])
def test_bands_cover_all_sizes_and_reach_one_below(law):
    for s in range(1, 3000):
        low, high = law.band(s)
        assert low <= s <= high
        if law.smallest(s) < low:
            assert law.band(low - 1)[0] <= law.smallest(s) and law.below(s) == law.band(low - 1)
        assert all(law.segments(band) > most for _, band, most in law.places(s))


def test_apart_is_the_exact_bound():
    for s in range(1, 60):
        for t in range(1, s + 1):
            similar = [same for same in range(t + 1) if 100 * same >= 85 * (s + t - same)]
            most = max((s + t - 2 * same for same in similar), default=-1)
            assert most <= LAW.apart(s, t) and (most < 0 or LAW.apart(s, t) - most < 2)


def test_allocation_covers_every_similar_pair():
    """By brute force: whatever the costs, two sets at most H apart agree on a segment within its v."""
    rng = random.Random(3)
    for _ in range(300):
        m, most = rng.randint(2, 12), rng.randint(0, 10)
        most = min(most, m - 1)
        found = [{"segment": s, "kind": 0, "full": rng.randint(1, 9), "less": rng.randint(0, 3)} for s in range(m) if rng.random() < 0.6]
        found += [{"segment": s, "kind": 1, "full": rng.randint(1, 9), "less": 0} for s in range(0, m, jaccard.DELETIONS) if rng.random() < 0.4]
        v = jaccard.allocate(found, m, most)
        free = {s: int(s % jaccard.DELETIONS == 0) for s in range(m) if s not in v}
        assert sum(x + 1 for x in (v | free).values()) > most
        assert all(x < 1 or s % jaccard.DELETIONS == 0 for s, x in v.items())


def test_keys_and_bitmaps():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    band = LAW.band(len(h))
    m = LAW.segments(band)
    keys = jaccard.segment_keys(h, band, m)
    segment, deleted = jaccard.deletion_keys(h, band, m)
    at = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    for drop in (0, 7, 120):
        fewer = np.delete(h, drop)
        other = jaccard.segment_keys(fewer, band, m)
        assert (other != keys).nonzero()[0].tolist() == [int(at[drop])]
        assert (int(at[drop]) % jaccard.DELETIONS != 0) or other[int(at[drop])] in deleted[segment == int(at[drop])]
        a, b = (np.frombuffer(jaccard.bitmap(x, 256), np.uint64) for x in (h, fewer))
        assert np.bitwise_count(a ^ b).sum() == 1


def test_unrelated_long_sets_are_not_sent_to_be_verified(spark, monkeypatch):
    """They meet by empty segments, and the short bitmaps of sets that may differ in hundreds of tokens let them pass."""
    rng = random.Random(21)
    rows = []
    for b in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(3600 + 20 * b)]
        rows += [(10 * b + i, " ".join(edited(rng, base, 8))) for i in range(3)]
    sent, verify = [], jaccard.verified

    def recorded(pairs, sets, law):
        sent.extend((r.a, r.b) for r in pairs.collect())
        return verify(pairs, sets, law)

    monkeypatch.setattr(jaccard, "verified", recorded)
    assert got(spark, rows) == slow(rows)
    assert 24 <= len(sent) <= 36


def test_screen_keeps_every_similar_pair(spark):
    """Sets of all sizes, next to the bound and of neighbouring bands: what is similar stays, what is unrelated leaves."""
    rng = np.random.default_rng(8)
    near, similar, unrelated = [], [], []
    for n in [1, 2, 7, 13, 60, 300, 485, 486, 2000, 3200, 9000]:
        h = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        same, mine = h[rng.permutation(len(h))[:n]], len(near)
        most = max((d for d in range(n + 1) if 100 * (n - d) >= 85 * n), default=0)      # a subset of n - d tokens is as far as may be
        sets = [np.sort(same), np.sort(same[:n - most]), np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))]
        near += [(mine + i, len(x), bytearray(jaccard.bitmap(x, LAW.sketch_bits(len(x))))) for i, x in enumerate(sets)]
        similar.append((mine, mine + 1))
        unrelated.append((mine, mine + 2))
    near = spark.createDataFrame(near, "c long, n long, sketch binary")
    pairs = spark.createDataFrame(similar + unrelated, "a long, b long")
    assert sorted((r.a, r.b) for r in jaccard.screened(pairs, near, LAW).collect()) == similar


def test_sketches_of_other_sizes_are_folded():
    rng = np.random.default_rng(9)
    h = np.unique(rng.integers(0, 2**63, 700, dtype=np.uint64))
    assert jaccard.sketches_apart(jaccard.bitmap(h, 4096), jaccard.bitmap(h, 256)) == 0
    assert jaccard.sketches_apart(jaccard.bitmap(h[3:], 64), jaccard.bitmap(h, 1 << 14)) in (1, 3)
    assert jaccard.sketches_apart(jaccard.bitmap(h[:0], 64), jaccard.bitmap(h[:1], 128)) == 1
