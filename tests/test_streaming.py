import datetime as dt
import os

from pyspark.sql import functions as F

from fleetlens.operators.rollups import export_windows
from fleetlens.schemas import DEVICE_SAMPLES, GPU_METRICS
from fleetlens.streaming.ingest import export_stream, start_ingest

T0 = dt.datetime(2024, 1, 1)


def test_ingest_stream_writes_metrics_and_events(spark, scratch):
    src = os.path.join(scratch, "samples")
    procs = [(11, "python3", 5 * 1048576), (12, None, None)]
    rows = [
        (T0, 0, "A", 70, 10, 1, 2, 50, 100000, procs, []),
        (T0, 1, None, 90, 10, 1, 2, None, None, [(11, "python3", 1048576)], []),
        (T0 + dt.timedelta(seconds=2), 0, "A", 10, 10, 1, 2, 50, 100000, [(12, "x", 3 * 1048576)], []),
    ]
    spark.createDataFrame(rows, DEVICE_SAMPLES).write.parquet(src)
    os_procs = spark.createDataFrame([(11, "python3", "python3 train.py", None), (12, "Game.exe", "Game.exe", None)],
                                     "pid long, name string, command_line string, exe_path string")
    stream = spark.readStream.schema(DEVICE_SAMPLES).parquet(src)
    q = start_ingest(spark, stream, os_procs, os.path.join(scratch, "m"), os.path.join(scratch, "e"),
                     os.path.join(scratch, "ckpt"), available_now=True)
    q.awaitTermination(300)
    m = spark.read.parquet(os.path.join(scratch, "m"))
    assert m.count() == 3
    assert {r["name"] for r in m.collect()} == {"A", "GPU 1"}
    ev = {(r["timestamp"], r["pid"]): r for r in spark.read.parquet(os.path.join(scratch, "e")).collect()}
    # Tick T0: pid 11 is on GPU 0 and GPU 1; GPU 1 (inserted last) wins with its 1 MiB.
    assert ev[(T0, 11)]["gpu_memory_mb"] == 1 and ev[(T0, 11)]["category"] == "ml_training"
    # pid 12 at T0 (memory unavailable -> 0) on GPU 0 with util 70: an .exe above 60 is gaming.
    assert ev[(T0, 12)]["gpu_memory_mb"] == 0 and ev[(T0, 12)]["category"] == "gaming"
    # At T0+2s GPU 0 runs at 10: not gaming.
    assert ev[(T0 + dt.timedelta(seconds=2), 12)]["category"] == "general_compute"


def test_export_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "metrics")
    rows = [(i, T0 + dt.timedelta(seconds=3 * i), i % 2, f"GPU {i % 2}", i, i, i, i, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, GPU_METRICS)
    df.write.parquet(src)
    stream = spark.readStream.schema(GPU_METRICS).parquet(src)
    q = (export_stream(stream).writeStream.format("memory").queryName("export_test").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = spark.sql("SELECT * FROM export_test").collect()
    batch = export_windows(df).collect()
    # The last open period is only emitted once the watermark passes it.
    assert 0 < len(streamed) <= len(batch)
    b = {(r["window_start"], r["gpu_id"]): r for r in batch}
    for r in streamed:
        assert r == b[(r["window_start"], r["gpu_id"])]


def _ingested(spark, path, batches):
    from fleetlens.streaming.ingest import _write_batch
    for b, day in batches:
        rows = [(10 * b + i, T0 + dt.timedelta(days=day, seconds=10 * b + i), 0, "G", 1, 1, 1, 1, 1, 1) for i in range(3)]
        _write_batch(spark.createDataFrame(rows, GPU_METRICS), path, b)


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_compact_day_is_exact_and_idempotent(spark, scratch):
    from fleetlens.sinks.compaction import compact_closed_days, compact_day, read_ingested
    path = os.path.join(scratch, "m")
    _ingested(spark, path, [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)])
    before = _ids(spark.read.parquet(path))
    assert compact_day(spark, path, T0.date(), sort=("gpu_id",)) == 4
    after = spark.read.parquet(path)
    assert _ids(after) == _ids(read_ingested(spark, path)) == before
    assert after.where((F.col("date") == T0.date()) & (F.col("batch_id") >= 0)).count() == 0
    assert compact_day(spark, path, T0.date()) == 0          # nothing left to do
    _ingested(spark, path, [(5, 0), (6, 0), (7, 1), (8, 2)])   # late batches of the day
    assert compact_closed_days(spark, path, T0.date() + dt.timedelta(days=2)) == 4
    assert _ids(spark.read.parquet(path)) == sorted(before + [10 * b + i for b in (5, 6, 7, 8) for i in range(3)])


def test_compact_day_survives_a_crash_at_any_step(spark, scratch, monkeypatch):
    from fleetlens.sinks.compaction import compact_day, read_ingested
    from test_sinks import Died, _dies_at
    for step in range(1, 30):
        path = os.path.join(scratch, f"m{step}")
        _ingested(spark, path, [(0, 0), (1, 0), (2, 0), (3, 1)])
        before = _ids(spark.read.parquet(path))
        with monkeypatch.context() as m:
            count = _dies_at(m, step)
            try:
                compact_day(spark, path, T0.date())
            except Died:
                pass
        assert _ids(read_ingested(spark, path)) == before          # readers see every row once, also now
        _ingested(spark, path, [(4, 0)])                            # a late batch meanwhile
        compact_day(spark, path, T0.date())
        assert _ids(spark.read.parquet(path)) == sorted(before + [40, 41, 42])
        if count["n"] < step:
            break
    assert step < 29


def test_export_counters_stream_matches_batch_for_closed_periods(spark, scratch):
    from fleetlens.operators.rollups import export_counters
    from fleetlens.schemas import LLM_SESSIONS
    from fleetlens.streaming.ingest import export_counters_stream
    rows = [(f"s{i}", T0 + dt.timedelta(seconds=i), T0 + dt.timedelta(seconds=5 * i + 1), f"m{i % 2}",
             1, i, 1 + i, 1.0, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, LLM_SESSIONS)
    src = os.path.join(scratch, "sessions")
    df.write.parquet(src)
    stream = spark.readStream.schema(LLM_SESSIONS).parquet(src)
    q = (export_counters_stream(stream).writeStream.format("memory").queryName("counters_test")
         .outputMode("append").option("checkpointLocation", os.path.join(scratch, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = spark.sql("SELECT * FROM counters_test").collect()
    batch = {(r["window_start"], r["model"]): r for r in export_counters(df).collect()}
    assert 0 < len(streamed) <= len(batch)
    for r in streamed:
        assert r == batch[(r["window_start"], r["model"])]


def _process(pid, mem):
    return (pid, None, mem)


def test_ingest_by_host_and_poll_with_a_growing_process_table(spark, scratch):
    """Two hosts share pids; one pid is on two GPUs whose clocks differ; a process lands after the first batch."""
    from fleetlens.schemas import HOST_SAMPLES, PROCESS_SNAPSHOTS
    src, snaps = os.path.join(scratch, "samples"), os.path.join(scratch, "snaps")
    us = dt.timedelta(microseconds=350)

    def land(rows, table):
        spark.createDataFrame(rows, HOST_SAMPLES).coalesce(1).write.mode("append").parquet(src)
        spark.createDataFrame(table, PROCESS_SNAPSHOTS).coalesce(1).write.mode("append").parquet(snaps)

    def run():
        stream = spark.readStream.schema(HOST_SAMPLES).option("maxFilesPerTrigger", 1).parquet(src)
        q = start_ingest(spark, stream, lambda s: s.read.schema(PROCESS_SNAPSHOTS).parquet(snaps), os.path.join(scratch, "m"),
                         os.path.join(scratch, "e"), os.path.join(scratch, "ckpt"), available_now=True)
        q.awaitTermination(300)
        assert q.exception() is None

    mib = 1 << 20
    land([(T0, 0, "A", 10, 1, 1, 2, 50, 1000, [_process(7, 2 * mib)], [], "a", 1),
          (T0 + us, 1, "A", 20, 1, 1, 2, 50, 1000, [_process(7, 3 * mib)], [], "a", 1),
          (T0, 0, "B", 90, 1, 1, 2, 50, 1000, [_process(7, 1024 * mib)], [], "b", 1)],
         [(7, "python3", "python3 train.py", None, "a", 1), (7, "ollama", "ollama serve", None, "b", 1)])
    run()
    land([(T0 + dt.timedelta(seconds=2), 0, "A", 5, 1, 1, 2, 50, 1000, [_process(7, 2 * mib), _process(8, mib)], [], "a", 2)],
         [(7, "python3", "python3 train.py", None, "a", 2), (8, "blender", "blender", None, "a", 2)])
    run()
    got = sorted((r["host"], r["pid"], r["gpu_memory_mb"], r["gpu_utilization"], r["category"], r["timestamp"])
                 for r in spark.read.parquet(os.path.join(scratch, "e")).collect())
    later = T0 + dt.timedelta(seconds=2)
    assert got == [("a", 7, 2, 5, "ml_training", later), ("a", 7, 3, 20, "ml_training", T0 + us), ("a", 8, 1, 5, "general_compute", later),
                   ("b", 7, 1024, 90, "llm_inference", T0)]


def test_reconcile_takes_late_chunks(spark, scratch):
    """Whatever the stream stored, sessions equal the batch over all landed chunks, also when the start day moves."""
    from fleetlens.operators.sessions import track_sessions
    from fleetlens.schemas import LLM_CHUNKS
    from fleetlens.sinks.tables import read_sessions, upsert_sessions
    from fleetlens.streaming.sessions import reconcile_sessions
    late = dt.datetime(2023, 12, 31, 23, 59)
    on_time = [("s", 1, T0, "m", "x", 5, 100, None, False), ("s", 2, T0 + dt.timedelta(seconds=1), "m", "y", 9, 200, None, True),
               ("t", 1, T0, "m", "x", 1, 10, None, True)]
    path = os.path.join(scratch, "sessions")
    upsert_sessions(spark, track_sessions(spark.createDataFrame(on_time, LLM_CHUNKS)), path)
    chunks = spark.createDataFrame([("s", 0, late, "m", None, None, None, 4, False), *on_time], LLM_CHUNKS)
    for _ in range(2):
        reconcile_sessions(spark, chunks, path)
        got = sorted(map(str, read_sessions(spark, path).drop("start_date").collect()))
        assert got == sorted(map(str, track_sessions(chunks).collect()))


def test_process_and_histogram_streams_equal_batch_for_closed_periods(spark, scratch):
    from fleetlens.operators.rollups import TPS_BUCKETS, export_process_gauges, export_tps_histogram
    from fleetlens.schemas import LLM_SESSIONS, PROCESS_EVENTS
    from fleetlens.streaming.ingest import export_histogram_stream, export_process_stream
    ev = [(T0 + dt.timedelta(seconds=2 * (i // 3)), i, "n", ("gaming", "ml_training")[i % 2], i, 1, None, None, 0) for i in range(120)]
    se = [(f"s{i}", T0, T0 + dt.timedelta(seconds=3 * i), f"m{i % 2}", 1, i, 1 + i, float(i), None, None) for i in range(40)]
    for name, rows, schema, stream_of, batch_of in (
            ("ev", ev, PROCESS_EVENTS, export_process_stream, export_process_gauges),
            ("se", se, LLM_SESSIONS, lambda s: export_histogram_stream(s, "tokens_per_second", TPS_BUCKETS), export_tps_histogram)):
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(os.path.join(scratch, name))
        q = (stream_of(spark.readStream.schema(schema).parquet(os.path.join(scratch, name))).writeStream.format("memory")
             .queryName(f"{name}_test").outputMode("append").option("checkpointLocation", os.path.join(scratch, f"c{name}"))
             .trigger(availableNow=True).start())
        q.awaitTermination(300)
        got = {str(r) for r in spark.sql(f"SELECT * FROM {name}_test").collect()}
        assert got and got <= {str(r) for r in batch_of(df).select(*spark.table(f"{name}_test").columns).collect()}


def _polled(spark, scratch, steps):
    """Events after ingest batches of ([(poll, gpu, pid)], snapshots landed so far [(pid, poll)]); a step may name its batch."""
    from fleetlens.schemas import HOST_SAMPLES, PROCESS_SNAPSHOTS
    from fleetlens.sinks.compaction import read_ingested
    from fleetlens.streaming.ingest import ingest_batch
    m, e = os.path.join(scratch, "m"), os.path.join(scratch, "e")
    for batch, rows, procs, hold in steps:
        samples = [(T0 + dt.timedelta(seconds=2 * poll), gpu, "A", 10 * gpu, 1, 1, 2, 50, 1000, [_process(pid, (gpu + 1) << 20)], [], "a", poll)
                   for poll, gpu, pid in rows]
        table = spark.createDataFrame([(pid, "python3", "python3 train.py", None, "a", poll) for pid, poll in procs], PROCESS_SNAPSHOTS)
        ingest_batch(spark, spark.createDataFrame(samples, HOST_SAMPLES), batch, table, m, e, hold_batches=hold)
    read = read_ingested(spark, e)
    return sorted((r.poll_id, r.pid, r.gpu_memory_mb, r.gpu_utilization) for r in read.collect()), e


def test_a_poll_in_pieces_is_one_classification(spark, scratch):
    procs = [(7, 1), (8, 1), (7, 2)]
    steps = [(0, [(1, 0, 7), (2, 0, 7)], procs, 64), (1, [(1, 1, 7), (1, 2, 8)], procs, 64)]
    got, path = _polled(spark, scratch, steps)
    assert got == [(1, 7, 2, 10), (1, 8, 3, 20), (2, 7, 1, 0)]
    from fleetlens.sinks.compaction import compact_day, read_ingested
    got, _ = _polled(spark, scratch, [(1, steps[1][1], procs, 64)])             # a replay
    assert got == [(1, 7, 2, 10), (1, 8, 3, 20), (2, 7, 1, 0)]
    _polled(spark, scratch, [(2, [(50000, 0, 7)], [*procs, (7, 50000)], 64)])
    compact_day(spark, path, T0.date())
    kept = sorted((r.poll_id, r.pid, r.gpu_memory_mb) for r in read_ingested(spark, path).collect())
    assert kept == [(1, 7, 2), (1, 8, 3), (2, 7, 1), (50000, 7, 1)] and spark.read.parquet(path).where("date = DATE'2024-01-01'").count() == 3


def test_processes_that_land_after_their_poll(spark, scratch):
    steps = [(0, [(1, 0, 7), (1, 1, 8)], [], 64), (1, [(2, 0, 7)], [(7, 1)], 64), (2, [(3, 0, 9)], [(7, 1), (8, 1), (7, 2)], 64)]
    got, _ = _polled(spark, scratch, steps)
    assert got == [(1, 7, 1, 0), (1, 8, 2, 10), (2, 7, 1, 0)]


def test_a_poll_closes_after_the_held_batches(spark, scratch):
    steps = [(0, [(1, 0, 7)], [], 2), (1, [(2, 0, 7)], [], 2), (2, [(3, 0, 7)], [], 2), (3, [(4, 0, 7)], [(7, 1), (7, 3), (7, 4)], 2)]
    got, path = _polled(spark, scratch, steps)
    assert got == [(3, 7, 1, 0), (4, 7, 1, 0)]
    assert sorted(os.listdir(os.path.join(path, "_polls")))[0] != "batch_id=0"
