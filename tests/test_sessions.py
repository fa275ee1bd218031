import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.rollups import histogram
from fleetlens.operators.sessions import best_model, session_totals, track_sessions
from fleetlens.schemas import LLM_CHUNKS
from fleetlens.streaming.sessions import track_sessions_stream

T0 = dt.datetime(2024, 1, 1)


def _chunks(spark, rows):
    return spark.createDataFrame(rows, LLM_CHUNKS)


def _c(sid, seq, sec, response=None, done=False, ec=None, ed=None, pc=None, model="llama2"):
    return (sid, seq, T0 + dt.timedelta(seconds=sec), model, response, ec, ed, pc, done)


def test_reference_session(spark):
    rows = [_c("session1", 0, 0, "Hello", False, 1, 100000000, 10), _c("session1", 1, 1, " world!", True, 3, 300000000, 10)]
    got = track_sessions(_chunks(spark, rows)).collect()
    assert len(got) == 1
    s = got[0]
    assert (s["completion_tokens"], s["prompt_tokens"], s["total_tokens"]) == (3, 10, 13)
    assert s["tokens_per_second"] == 10.0 and s["time_per_output_token_ms"] == 100.0
    assert s["time_to_first_token_ms"] == 0


EDGE = [
    # eval_ns 0: tps 0, tpot null
    _c("a", 0, 0, "x", True, 5, 0, 2),
    # completion 0: tpot null
    _c("b", 0, 0, "x", True, 0, 10, 2),
    # no response at all: ttft null; first chunk at 0, done at 3
    _c("c", 0, 0, None, False, None, None, 4), _c("c", 1, 3, None, True, 2, 1000, None),
    # empty response counts as a token, at second 2
    _c("d", 0, 0, None), _c("d", 1, 2, ""), _c("d", 2, 5, None, True, 1, 10),
    # no done: no row
    _c("e", 0, 0, "x"),
    # two dones: two rows; state survives the first
    _c("f", 0, 0, "x", True, 1, 100, 7), _c("f", 1, 4, None, False, None, None, None),
    _c("f", 2, 9, "y", True, 4, 400, None),
]


def _by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["id"], []).append(r.asDict())
    for v in out.values():
        v.sort(key=lambda d: d["end_time"])
    return out


def test_edge_sessions(spark):
    got = _by_id(track_sessions(_chunks(spark, EDGE)).collect())
    assert sorted(got) == ["a", "b", "c", "d", "f"]
    a, b, c, d = got["a"][0], got["b"][0], got["c"][0], got["d"][0]
    assert a["tokens_per_second"] == 0.0 and a["time_per_output_token_ms"] is None
    assert b["time_per_output_token_ms"] is None and b["tokens_per_second"] == 0.0
    assert c["time_to_first_token_ms"] is None and c["prompt_tokens"] == 4 and c["completion_tokens"] == 2
    assert d["time_to_first_token_ms"] == 2000
    f1, f2 = got["f"]
    assert (f1["completion_tokens"], f1["prompt_tokens"]) == (1, 7)
    assert (f2["completion_tokens"], f2["prompt_tokens"], f2["start_time"]) == (4, 7, T0)
    assert f2["time_to_first_token_ms"] == 0


def test_streaming_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="fleetlens-chunks-")
    # "g" gets nothing in the middle trigger: its state must survive the idle trigger.
    df = _chunks(spark, EDGE + [_c("g", 0, 0, None, False, None, None, 3), _c("g", 1, 9, "z", True, 2, 20, None)])
    # Files land in arrival order (one per time slice); rows are shuffled inside each file.
    for lo, hi in ((0, 3), (3, 6), (6, 60)):
        part = df.where((F.col("arrival_ts") >= F.lit(T0 + dt.timedelta(seconds=lo)))
                        & (F.col("arrival_ts") < F.lit(T0 + dt.timedelta(seconds=hi))))
        part.orderBy(F.rand(lo)).coalesce(1).write.mode("append").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(LLM_CHUNKS).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "in"))
    out = track_sessions_stream(stream)
    q = (out.writeStream.format("memory").queryName("sessions_stream_test").outputMode("append")
         .option("checkpointLocation", os.path.join(src, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = spark.sql("SELECT * FROM sessions_stream_test").collect()
    batch = track_sessions(df).collect()
    norm = lambda rows: sorted(tuple(sorted(r.asDict().items())) for r in rows)
    assert norm(streamed) == norm(batch)


def test_panel_and_histogram(spark):
    sessions = track_sessions(_chunks(spark, EDGE))
    tot = session_totals(sessions).collect()[0]
    assert tot["total_sessions"] == 6
    empty = session_totals(sessions.limit(0)).collect()
    assert empty == []
    h = histogram(spark.createDataFrame([("m", 1.0), ("m", 5.0), ("m", 600.0), ("m", None)],
                                        "model string, v double"), "v", (1.0, 5.0, 500.0))
    got = {r["le"]: r["bucket_count"] for r in h.collect()}
    assert got == {"1": 1, "5": 2, "500": 2, "+Inf": 3}
    tie = spark.createDataFrame([("a:1", 10.0, T0), ("b:2", 10.0, T0 + dt.timedelta(seconds=5))],
                                "model string, tokens_per_second double, start_time timestamp")
    assert best_model(tie).collect()[0]["model_base"] == "b"


@pytest.mark.parametrize("name", ["llm_sessions"])
def test_fixture_sessions_have_one_row_per_done(spark, name):
    from fleetlens.plans import catalog
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() == df.select("id").distinct().count()


def _brute_sessions(rows):
    """Reference fold in arrival order: one emission per done chunk."""
    out = []
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for sid, rs in by.items():
        rs.sort(key=lambda r: (r[2], r[1]))
        start, model, ft, pc, cc, ed = rs[0][2], rs[0][3], None, None, None, None
        for (_, _, ts, _, resp, ec, edur, pce, done) in rs:
            if ft is None and resp is not None:
                ft = ts
            pc = pce if pce is not None else pc
            cc = ec if ec is not None else cc
            ed = edur if edur is not None else ed
            if done:
                p, c, e = pc or 0, cc or 0, ed or 0
                out.append((sid, start, ts, model, p, c, p + c, c * 1e9 / e if e > 0 else 0.0,
                            None if ft is None else int((ft - start).total_seconds() * 1000),
                            e / 1e6 / c if c > 0 and e > 0 else None))
    return sorted(out, key=repr)


def test_hot_session_many_dones_matches_brute_force(spark):
    import random
    rng = random.Random(3)
    rows = []
    for sid, n in (("hot", 1500), ("s1", 20), ("s2", 3)):
        for seq in range(n):
            sec = rng.randrange(1800)               # a hot session spread over 30 one-minute blocks
            rows.append((sid, seq, T0 + dt.timedelta(seconds=sec), "m" if seq else "first",
                         None if rng.random() < 0.5 else "t", rng.choice([None, seq]),
                         rng.choice([None, 0, seq * 1000]), rng.choice([None, 7, seq]), rng.random() < 0.05))
    got = track_sessions(_chunks(spark, rows), block_seconds=60).collect()
    got = sorted((tuple(r) for r in got), key=repr)
    assert got == _brute_sessions(rows)


def test_session_start_from_request_time(spark):
    rows = [_c("r", 0, 2, "Hi", False, 1, 10, 3), _c("r", 1, 5, None, True, 2, 20, None)]
    df = _chunks(spark, rows).withColumn("request_ts", F.lit(T0))
    s = track_sessions(df, start_col="request_ts").collect()[0]
    assert s["start_time"] == T0 and s["time_to_first_token_ms"] == 2000
    assert track_sessions(df).collect()[0]["time_to_first_token_ms"] == 0


def test_drain_stream_into_table_equals_batch(spark):
    from fleetlens.sinks.tables import read_sessions
    from fleetlens.streaming.sessions import drain_sessions
    src = tempfile.mkdtemp(prefix="fleetlens-drain-")
    df = _chunks(spark, EDGE)
    for lo, hi in ((0, 3), (3, 6), (6, 60)):
        part = df.where((F.col("arrival_ts") >= F.lit(T0 + dt.timedelta(seconds=lo)))
                        & (F.col("arrival_ts") < F.lit(T0 + dt.timedelta(seconds=hi))))
        part.coalesce(1).write.mode("append").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(LLM_CHUNKS).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "in"))
    table = os.path.join(src, "llm_sessions")
    q = drain_sessions(spark, track_sessions_stream(stream), table, os.path.join(src, "ckpt"), available_now=True)
    q.awaitTermination(300)
    stored = read_sessions(spark, table).drop("start_date").collect()
    # The table holds one row per id: the K2 merge of its emissions ("f" has two).
    from fleetlens.sinks.tables import merge_sessions
    batch = track_sessions(df)
    want = merge_sessions(batch.limit(0), batch).collect()
    norm = lambda rows: sorted(tuple(sorted(r.asDict().items())) for r in rows)
    assert norm(stored) == norm(want)


def test_bad_time_argument_is_named(spark):
    from fleetlens.operators.sessions import sessions_between
    df = track_sessions(_chunks(spark, EDGE))
    with pytest.raises(ValueError, match="start_date"):
        sessions_between(df, "2024-01-01", "2024-01-02T00:00:00Z")
    with pytest.raises(ValueError, match="end_date"):
        sessions_between(df, "2024-01-01T00:00:00Z", "yesterday")


def test_row_sized_session_blocks_match(spark):
    rows = [_c("h", i, i // 10, "t" if i % 3 else None, i % 50 == 49, i, i * 10, 5) for i in range(500)]
    df = _chunks(spark, rows)
    fixed = sorted(map(tuple, track_sessions(df).collect()))
    sized = sorted(map(tuple, track_sessions(df, block_rows=25).collect()))
    assert fixed == sized and len(fixed) == 10


def test_snapshot_constant_labels(spark):
    from fleetlens import fixtures
    from fleetlens.operators.metrics import gpu_gauges
    from fleetlens.operators.processes import process_events
    from fleetlens.operators.rollups import metric_snapshot
    sf = "/root/testdata/sf0.001"
    snap = metric_snapshot(gpu_gauges(fixtures.view(spark, sf, "gpu_metrics")), track_sessions(_chunks(spark, EDGE)),
                           process_events(fixtures.view(spark, sf, "process_samples"),
                                          fixtures.view(spark, sf, "os_processes"), library_roots=["/opt/lib/common"]),
                           constant_labels={"service.name": "svc", "host.name": "h1"})
    rows = snap.select("metric", F.to_json("labels").alias("l")).collect()
    assert rows and all('"host.name":"h1"' in r["l"] and '"service.name":"svc"' in r["l"] for r in rows)
    one = [r["l"] for r in rows if r["metric"] == "gpm_gpu_power_watts"][0]
    assert one.index("gpu_id") < one.index("gpu_name") < one.index("host.name") < one.index("service.name")


def test_done_on_every_chunk_and_a_burst(spark):
    """600 chunks of one session within a second, each one done: no window over the session, same rows as brute force."""
    base = dt.datetime(2024, 1, 1)
    rows = [("hot", i, base + dt.timedelta(microseconds=1000 * (i // 3)), "m", "x" if i > 4 else None, i if i % 5 else None,
             i * 1000 if i % 7 else None, 3 if i == 9 else None, True) for i in range(600)]
    got = sorted(track_sessions(_chunks(spark, rows), block_rows=50).collect(), key=lambda r: (r["end_time"], r["completion_tokens"]))
    assert len(got) == 600 and {r["start_time"] for r in got} == {base}
    counts, prompt, want = 0, 0, []
    for r in rows:
        counts, prompt = r[5] if r[5] is not None else counts, r[7] if r[7] is not None else prompt
        want.append((r[2], counts, prompt))
    assert sorted((r["end_time"], r["completion_tokens"], r["prompt_tokens"]) for r in got) == sorted(want)
