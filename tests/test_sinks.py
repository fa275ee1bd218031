import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.schemas import GPU_METRICS, LLM_SESSIONS, WEEKLY_SUMMARIES
from fleetlens.sinks import archive as A
from fleetlens.sinks import files
from fleetlens.sinks import tables as T
from fleetlens.sources.stored import read_archive

T0 = dt.datetime(2024, 1, 1)


def test_parquet_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, "Alice", 10.5), (2, "Bob", 20.3), (3, "Charlie", 30.1)],
                               "id long, name string, value double")
    df.write.parquet(os.path.join(scratch, "rt"))
    back = read_archive(spark, os.path.join(scratch, "rt"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def _session(i, start_s, end_s, model, prompt, completion, tps=1.0):
    return (i, T0 + dt.timedelta(seconds=start_s), T0 + dt.timedelta(seconds=end_s), model, prompt, completion,
            prompt + completion, tps, None, None)


def test_upsert_keeps_first_start_model_prompt(spark, scratch):
    path = os.path.join(scratch, "sessions")
    T.upsert_sessions(spark, spark.createDataFrame([_session("x", 0, 5, "m1", 10, 3), _session("y", 0, 6, "m1", 1, 1)],
                                                   LLM_SESSIONS), path)
    T.upsert_sessions(spark, spark.createDataFrame([_session("x", 0, 9, "m2", 99, 7, 2.0)], LLM_SESSIONS), path)
    rows = {r["id"]: r for r in T.read_sessions(spark, path).collect()}
    x = rows["x"]
    assert (x["model"], x["prompt_tokens"]) == ("m1", 10)              # kept from the first write
    assert (x["completion_tokens"], x["total_tokens"], x["tokens_per_second"]) == (7, 106, 2.0)  # replaced
    assert x["end_time"] == T0 + dt.timedelta(seconds=9)
    assert rows["y"]["completion_tokens"] == 1 and len(rows) == 2
    # Replaying the same batch changes nothing.
    T.upsert_sessions(spark, spark.createDataFrame([_session("x", 0, 9, "m2", 99, 7, 2.0)], LLM_SESSIONS), path)
    assert sorted(map(tuple, T.read_sessions(spark, path).collect())) == sorted(map(tuple, rows.values()))


def test_upsert_weekly(spark, scratch):
    path = os.path.join(scratch, "weekly")
    wk = dt.date(2024, 1, 1)
    first = spark.createDataFrame([(wk, dt.date(2024, 1, 8), "gaming", 0, 50.0, 90, 100, 3),
                                   (wk, dt.date(2024, 1, 8), "ml_training", 0, 10.0, 20, 5, 1)], WEEKLY_SUMMARIES)
    T.upsert_weekly_summaries(spark, first, path)
    second = spark.createDataFrame([(wk, dt.date(2024, 1, 8), "gaming", 0, 60.0, 95, 200, 4)], WEEKLY_SUMMARIES)
    T.upsert_weekly_summaries(spark, second, path)
    rows = {r["category"]: r for r in T.read_weekly(spark, path).collect()}
    assert rows["gaming"]["event_count"] == 4 and rows["ml_training"]["event_count"] == 1


def _metrics(spark, times):
    rows = [(i, t, 0, "GPU 0", 1, 2, 3, 4, 5, 6) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, GPU_METRICS)


def _live(spark, table):
    return sorted(r["id"] for r in spark.read.parquet(table).collect())


def _archived(spark, arch, day):
    return sorted(r["id"] for r in spark.read.parquet(A.archive_path(arch, "gpu_metrics", day)).collect())


NOW = dt.datetime(2024, 1, 17, 12, tzinfo=dt.timezone.utc)


def test_archive_then_trim_exactly(spark, scratch):
    table, arch = os.path.join(scratch, "gpu_metrics"), os.path.join(scratch, "archive")
    times = [dt.datetime(2024, 1, 9, 23, 59, 59), dt.datetime(2024, 1, 10, 0, 0, 0), dt.datetime(2024, 1, 10, 15)]
    T.append_gpu_metrics(_metrics(spark, times), table)
    report = A.maintain(spark, {"gpu_metrics": table}, arch, 7, NOW).collect()[0]
    # Cutoff date 2024-01-10: only the row before midnight is archived and deleted.
    assert (report["archived"], report["deleted"], report["archives"]) == (1, 1, 1)
    assert _live(spark, table) == [1, 2] and _archived(spark, arch, "2024-01-09") == [0]
    listing = A.list_archives(spark, arch).collect()
    assert [r["archive"] for r in listing] == ["gpu_metrics_2024-01-09.parquet"]
    assert A.archive_size(spark, arch) == listing[0]["bytes"] > 0
    log = spark.read.parquet(A.log_path(arch)).collect()
    assert [(r["archive_date"], r["table_name"], r["records_archived"]) for r in log] == [(dt.date(2024, 1, 9), "gpu_metrics", 1)]
    # A rerun archives nothing; a late row of an archived day becomes its next batch.
    assert A.maintain(spark, {"gpu_metrics": table}, arch, 7, NOW).collect()[0]["archived"] == 0
    T.append_gpu_metrics(_metrics(spark, [dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 9, 5)]).where("id = 1").withColumn("id", F.lit(77).cast("long")), table)
    assert A.maintain(spark, {"gpu_metrics": table}, arch, 7, NOW).collect()[0]["archived"] == 1
    assert _archived(spark, arch, "2024-01-09") == [0, 77] and _live(spark, table) == [1, 2]


class Died(Exception):
    pass


def _dies_at(monkeypatch, step: int):
    """Every folder step (move, delete, marker) counts; the given one fails before it happens."""
    count = {"n": 0}
    for name in ("move", "delete", "write_text"):
        real = getattr(files.Folders, name)

        def run(self, *args, real=real):
            count["n"] += 1
            if count["n"] == step:
                raise Died
            return real(self, *args)
        monkeypatch.setattr(files.Folders, name, run)
    return count


def test_archive_survives_a_crash_at_any_step(spark, scratch, monkeypatch):
    for trim in (("gpu_metrics",), ()):
        for step in range(1, 40):
            table, arch = os.path.join(scratch, f"t{len(trim)}{step}"), os.path.join(scratch, f"a{len(trim)}{step}")
            T.append_gpu_metrics(_metrics(spark, [dt.datetime(2024, 1, d, 3) for d in (5, 5, 6, 12)]), table)
            with monkeypatch.context() as m:
                count = _dies_at(m, step)
                try:
                    A.maintain(spark, {"gpu_metrics": table}, arch, 7, NOW, trim=trim)
                except Died:
                    pass
            A.maintain(spark, {"gpu_metrics": table}, arch, 7, NOW, trim=trim)
            assert _archived(spark, arch, "2024-01-05") == [0, 1] and _archived(spark, arch, "2024-01-06") == [2]
            assert _live(spark, table) == ([3] if trim else [0, 1, 2, 3])
            if count["n"] < step:
                break
        assert step < 39


def test_kept_table_is_archived_again_only_when_a_day_changed(spark, scratch):
    table, arch = os.path.join(scratch, "gpu_metrics"), os.path.join(scratch, "archive")
    T.append_gpu_metrics(_metrics(spark, [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6)]), table)
    cut = dt.date(2024, 1, 10)
    assert [(d, n) for d, n, _ in A.archive(spark, table, "gpu_metrics", cut, arch)] == [("2024-01-05", 1), ("2024-01-06", 1)]
    assert A.archive(spark, table, "gpu_metrics", cut, arch) == []
    T.append_gpu_metrics(_metrics(spark, [dt.datetime(2024, 1, 6, 1)]), table)
    assert [(d, n) for d, n, _ in A.archive(spark, table, "gpu_metrics", cut, arch)] == [("2024-01-06", 2)]


def test_retain_deletes_whole_days(spark, scratch):
    table = os.path.join(scratch, "gpu_metrics")
    T.append_gpu_metrics(_metrics(spark, [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5)]), table)
    assert A.retain(spark, table, dt.date(2024, 1, 3)) == 1 and _live(spark, table) == [1, 2]
    assert A.retain(spark, table, dt.date(2024, 1, 3)) == 0


def test_hourly_upkeep(spark, scratch):
    from fleetlens.plans.jobs import hourly_upkeep
    from fleetlens.schemas import PROCESS_EVENTS
    metrics = os.path.join(scratch, "gpu_metrics")
    events = os.path.join(scratch, "process_events")
    T.append_gpu_metrics(_metrics(spark, [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 16)]), metrics)
    ev = [(dt.datetime(2024, 1, 15, 9), 1, "python3", "ml_training", 10, 50, "python3 train.py", None, 0),
          (dt.datetime(2024, 1, 16, 9), 2, "ollama", "llm_inference", 20, 70, "ollama serve", None, 0),
          (dt.datetime(2024, 1, 2, 9), 3, "ollama", "llm_inference", 5, 10, "ollama serve", None, 0)]
    T.append_process_events(spark.createDataFrame(ev, PROCESS_EVENTS), events)
    weekly = os.path.join(scratch, "weekly")
    now = dt.datetime(2024, 1, 17, 12, tzinfo=dt.timezone.utc)
    report = {r["table"]: r for r in hourly_upkeep(spark, {"gpu_metrics": metrics, "process_events": events},
                                                    os.path.join(scratch, "archive"), weekly, 7, now).collect()}
    assert report["gpu_metrics"]["deleted"] == 1 and report["process_events"]["archived"] == 1
    rows = {r["category"]: r for r in T.read_weekly(spark, weekly).collect()}
    # Only the current week (Monday 2024-01-15) is summarised.
    assert set(rows) == {"ml_training", "llm_inference"}
    assert rows["llm_inference"]["event_count"] == 1 and rows["llm_inference"]["week_start"] == dt.date(2024, 1, 15)


def test_panels(spark):
    from fleetlens import fixtures
    from fleetlens.operators.sessions import track_sessions
    from fleetlens.plans.jobs import chart_panel, session_panel
    g = fixtures.view(spark, "/root/testdata/sf0.001", "gpu_metrics")
    chart = chart_panel(g, 1, 720, "2024-01-31T00:00:00Z")
    arr = chart["arrays"].collect()[0]
    assert len(arr["labels"]) == len(arr["utilization_gpu"]) <= 400
    assert {r["metric"] for r in chart["trend"].collect()} == {"utilization_gpu", "utilization_memory",
                                                               "temperature", "power_usage"}
    s = track_sessions(fixtures.view(spark, "/root/testdata/sf0.001", "llm_chunks"))
    panel = session_panel(s, "2024-01-02T00:00:00Z")
    assert panel["totals"].collect()[0]["total_sessions"] == s.count()
    assert len(panel["recent"].collect()) == 10
