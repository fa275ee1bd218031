"""The streaming fold of R1 on its own: any cut into Arrow batches and micro-batches, a very long session."""

import datetime as dt
import random
import tracemalloc

import numpy as np
import pandas as pd

from fleetlens.streaming import sessions as S

T0 = pd.Timestamp("2026-01-01")
COLUMNS = ["session_id", "arrival_ts", "seq", "model", "answered", "done", "prompt_eval_count", "eval_count", "eval_duration"]


class State:
    """What the fold uses of a group state."""
    hasTimedOut = False

    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        self.at = ms


def frame(rows):
    return pd.DataFrame(rows, columns=COLUMNS).astype({"answered": bool, "done": bool, "arrival_ts": "datetime64[us]"})


def plain(rows):
    """R1 a chunk at a time."""
    start = model = first = None
    counts = [None] * 3
    for k, (_, ts, _, m, answered, done, *new) in enumerate(rows):
        if k == 0:
            start, model = ts, m
        if answered and first is None:
            first = ts
        counts = [o if n is None else n for o, n in zip(counts, new)]
        if done:
            yield (start, model, first, *counts, ts)


def test_fold_equals_a_chunk_at_a_time():
    rng = random.Random(5)
    for _ in range(150):
        rows = []
        for i in range(rng.randrange(1, 30)):
            count = lambda: rng.choice([None, None, rng.randrange(100)])
            rows.append(("s", T0 + dt.timedelta(seconds=i // 3), i, rng.choice(["m", "n", None]), rng.random() < 0.4, rng.random() < 0.3,
                         count(), count(), count()))
        state, got, at = State(), [], 0
        while at < len(rows):                       # micro-batches in order, rows and Arrow batches within them in any order
            part = rows[at:at + rng.randrange(1, 12)]
            at += len(part)
            rng.shuffle(part)
            cut = rng.randrange(1, len(part) + 1)
            pdfs = [frame(p) for p in (part[:cut], part[cut:]) if p]
            for f in S._fold(1000)(("s",), iter(pdfs), state):
                got += [tuple(None if pd.isna(v) else v for v in r[1:]) for r in f.itertuples(index=False, name=None)]
        assert got == list(plain(rows))
        assert state.get[6] == rows[-1][1]


def test_a_million_chunks_in_one_micro_batch():
    def batches():
        for b in range(100):
            n = np.arange(b * 10_000, (b + 1) * 10_000)
            yield pd.DataFrame({"session_id": "s", "arrival_ts": T0 + pd.to_timedelta(n, unit="us"), "seq": n, "model": "m", "answered": True,
                                "done": n == 999_999, "prompt_eval_count": None, "eval_count": np.where(n == 999_999, 7.0, np.nan), "eval_duration": None})
    tracemalloc.start()
    (out,) = list(S._fold(1000)(("s",), batches(), State()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1 and out["_completion"].iloc[0] == 7 and out["_first_token"].iloc[0] == T0
    assert peak < 30_000_000
