import datetime as dt
import math
import random

from fleetlens.operators.series import downsample, ordered_index, trend


def _series(spark, counts, seed=1, spread_s=7200):
    """Rows for several devices; device 0 is hot. Times collide on purpose (ties broken by id)."""
    rng = random.Random(seed)
    rows, i = [], 0
    base = dt.datetime(2024, 1, 1)
    for dev, n in counts.items():
        for _ in range(n):
            rows.append((i, base + dt.timedelta(seconds=rng.randrange(spread_s)), dev, rng.randrange(100)))
            i += 1
    return rows, spark.createDataFrame(rows, "id long, timestamp timestamp, gpu_id int, v int")


def _brute_positions(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    pos = {}
    for dev, rs in by.items():
        rs.sort(key=lambda r: (r[1], r[0]))
        for k, r in enumerate(rs):
            pos[r[0]] = (k, len(rs))
    return by, pos


def test_ordered_index_matches_brute_force_with_hot_key(spark):
    rows, df = _series(spark, {0: 3000, 1: 40, 2: 1})
    _, pos = _brute_positions(rows)
    # Blocks cut to 100 rows and fixed one-minute blocks.
    got = {r["id"]: (r["idx"], r["n"]) for r in ordered_index(df, block_rows=100).collect()}
    assert got == pos
    got = {r["id"]: (r["idx"], r["n"]) for r in ordered_index(df, block_seconds=60, block_rows=None).collect()}
    assert got == pos


def _uneven(spark):
    """One device: an even series, one row of 1970, 900 rows at one instant, 900 within one second, 300 without a time."""
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(seconds=2 * i) for i in range(1500)] + [dt.datetime(1970, 1, 1, 1)]
    times += [base + dt.timedelta(seconds=777)] * 900 + [base + dt.timedelta(seconds=5000, microseconds=i) for i in range(900)] + [None] * 300
    random.Random(4).shuffle(times)
    rows = [(i, t, 0, i % 7) for i, t in enumerate(times)]
    return rows, spark.createDataFrame(rows, "id long, timestamp timestamp, gpu_id int, v int")


def test_blocks_stay_small_however_the_rows_lie(spark):
    from pyspark.sql import functions as F
    from fleetlens.operators.series import partitioning_columns, with_blocks
    rows, df = _uneven(spark)
    blocks = with_blocks(df, ["gpu_id"], "timestamp", ["id"], 600, 100).groupBy(*partitioning_columns(["gpu_id"])).count()
    assert blocks.agg(F.max("count")).first()[0] <= 100
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want = {r[0]: (k, len(rows)) for k, r in enumerate(order)}
    assert {r["id"]: (r["idx"], r["n"]) for r in ordered_index(df, block_seconds=600, block_rows=100).collect()} == want


def _brute_downsample(rs, max_points):
    n = len(rs)
    if n <= max_points:
        return [r[0] for r in rs]
    step = math.ceil(n / max_points)
    return [r[0] for k, r in enumerate(rs) if k % step == 0]


def test_downsample_sizes(spark):
    for n in (200, 201, 401):
        rows, df = _series(spark, {7: n}, seed=n)
        by, _ = _brute_positions(rows)
        want = sorted(_brute_downsample(by[7], 200))
        got = sorted(r["id"] for r in downsample(df, 200, block_rows=50).collect())
        assert got == want, n


def _brute_trend(values):
    n = len(values)
    s = max(5, math.floor(n * 0.1))
    recent = values[-s:]
    prev = values[max(0, n - 2 * s):max(0, n - s)]
    r = sum(recent) / len(recent)
    p = sum(prev) / len(prev) if prev else r
    change = (r - p) / p * 100 if p > 0 else 0
    return r, p, change, "up" if change > 5 else "down" if change < -5 else "neutral"


def test_trend_matches_brute_force(spark):
    for n in (1, 5, 7, 10, 100):
        rows, df = _series(spark, {3: n}, seed=n)
        by, _ = _brute_positions(rows)
        want = _brute_trend([r[3] for r in by[3]])
        got = trend(df, ["v"], block_rows=7).collect()[0]
        assert (got["recent_avg"], got["previous_avg"]) == (want[0], want[1]), n
        assert abs(got["change_percent"] - want[2]) < 1e-9 and got["trend"] == want[3], n


def test_trend_edges(spark):
    base = dt.datetime(2024, 1, 1)

    def run(values):
        df = spark.createDataFrame([(i, base + dt.timedelta(seconds=i), 0, v) for i, v in enumerate(values)],
                                   "id long, timestamp timestamp, gpu_id int, v int")
        return trend(df, ["v"]).collect()[0]

    assert run([0] * 5 + [10] * 5)["trend"] == "neutral"            # previous mean 0 -> change 0
    five = run([100] * 5 + [105] * 5)
    assert five["change_percent"] == 5.0 and five["trend"] == "neutral"   # exactly +5 is not up
    assert run([100] * 5 + [94] * 5)["trend"] == "down"


def test_ordered_index_keeps_null_times_and_keys(spark):
    rows = [(1, None, 0, 5), (2, dt.datetime(2024, 1, 1), 0, 6), (3, dt.datetime(2024, 1, 1), None, 7),
            (4, None, None, 8), (5, dt.datetime(2024, 1, 2), None, 9)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, gpu_id int, v int")
    got = {r["id"]: (r["idx"], r["n"]) for r in ordered_index(df).collect()}
    # Nulls first in time order; a null key is a group of its own.
    assert got == {1: (0, 2), 2: (1, 2), 4: (0, 3), 3: (1, 3), 5: (2, 3)}


def test_row_sized_blocks_with_sparse_long_span(spark):
    # Two rows fifty years apart: the block width is clamped to the span (no BIGINT overflow).
    rows = [(1, dt.datetime(1990, 1, 1), 0, 1), (2, dt.datetime(2040, 1, 1), 0, 2), (3, dt.datetime(2024, 1, 1), 1, 3)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, gpu_id int, v int")
    got = {r["id"]: (r["idx"], r["n"]) for r in ordered_index(df).collect()}
    assert got == {1: (0, 2), 2: (1, 2), 3: (0, 1)}
