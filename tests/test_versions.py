"""Upserted tables: crashes before every folder step, replays, late writers, plans of a drain."""

import datetime as dt
import os

import pytest

from fleetlens.schemas import LLM_SESSIONS
from fleetlens.sinks import archive as A
from fleetlens.sinks import files
from fleetlens.sinks import tables as T

T0 = dt.datetime(2024, 1, 1)


def session(i, day, end_s, model="m", completion=1, prompt=1):
    start = T0 + dt.timedelta(days=day)
    return (i, start, start + dt.timedelta(seconds=end_s), model, prompt, completion, prompt + completion, 1.0, None, None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), LLM_SESSIONS)


def stored(spark, path, **more):
    return {r.id: (r.model, r.completion_tokens, r.start_date.day) for r in T.read_sessions(spark, path, **more).collect()}


class Stop(Exception):
    pass


def stopping(monkeypatch, at):
    """From now on the ``at``-th step that changes a folder raises, before it is made."""
    left = [at]
    for name in ("make", "move", "delete", "write_text", "claim"):
        real = getattr(files.Folders, name)

        def step(self, *args, real=real):
            left[0] -= 1
            if left[0] < 0:
                raise Stop
            return real(self, *args)

        monkeypatch.setattr(files.Folders, name, step)


def test_a_crash_before_every_step_of_an_upsert_and_a_fold_loses_and_doubles_nothing(spark, scratch):
    first = frame(spark, session("a", 0, 5, "m1"), session("b", 0, 5), session("c", 1, 5))
    second = frame(spark, session("a", 0, 9, "m2", 7), session("d", 1, 3))
    before = {"a": ("m1", 1, 1), "b": ("m", 1, 1), "c": ("m", 1, 2)}
    after = before | {"a": ("m1", 7, 1), "d": ("m", 1, 2)}
    finished = 0
    for at in range(60):
        path = os.path.join(scratch, str(at))
        T.upsert_sessions(spark, first, path, "drain", 0)
        T.fold_sessions(spark, path)
        T.upsert_sessions(spark, frame(spark), path, "drain", 1)
        with pytest.MonkeyPatch.context() as m:
            stopping(m, at)
            try:
                T.upsert_sessions(spark, second, path, "drain", 2)
                T.fold_sessions(spark, path)
                finished += 1
            except Stop:
                pass
        assert stored(spark, path) in (before, after)
        assert stored(spark, path, days=[dt.date(2024, 1, 1)]) in ({k: v for k, v in x.items() if v[2] == 1} for x in (before, after))
        T.upsert_sessions(spark, second, path, "drain", 2)         # the stream's replay
        for _ in range(2):
            assert stored(spark, path) == after
            T.fold_sessions(spark, path)
        assert stored(spark, path) == after
        if finished:
            break
    assert finished == 1 and at > 8


def test_an_old_batch_is_not_replayed_and_the_log_stays_short(spark, scratch):
    path = os.path.join(scratch, "t")
    for batch in range(6):
        T.upsert_sessions(spark, frame(spark, session("a", 0, batch, "m", batch)), path, "drain", batch)
        T.fold_sessions(spark, path)
    T.upsert_sessions(spark, frame(spark, session("a", 0, 99, "m", 99)), path, "drain", 5)
    T.upsert_sessions(spark, frame(spark, session("a", 0, 99, "m", 99)), path, "drain", 3)
    assert stored(spark, path) == {"a": ("m", 5, 1)}
    assert len(os.listdir(os.path.join(path, "_log"))) < 24 and len(os.listdir(os.path.join(path, "base", "day=2024-01-01"))) <= 2


def test_a_write_that_ends_after_a_later_one_was_folded_still_counts(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "t")
    real = files.Folders.move

    def slow(self, source, target):
        if ".done.slow" in target:
            monkeypatch.setattr(files.Folders, "move", real)
            T.upsert_sessions(spark, frame(spark, session("b", 0, 1)), path, "fast")
            T.fold_sessions(spark, path)
        return real(self, source, target)

    monkeypatch.setattr(files.Folders, "move", slow)
    T.upsert_sessions(spark, frame(spark, session("a", 0, 1)), path, "slow")
    assert set(stored(spark, path)) == {"a", "b"}
    T.fold_sessions(spark, path)
    T.fold_sessions(spark, path)
    assert set(stored(spark, path)) == {"a", "b"}


def test_replacing_rows_move_a_session_to_another_day(spark, scratch):
    path = os.path.join(scratch, "t")
    T.upsert_sessions(spark, frame(spark, session("a", 3, 5, "old"), session("b", 3, 5)), path)
    T.fold_sessions(spark, path)
    T.replace_sessions(spark, frame(spark, session("a", 1, 5, "new", 4)), path)
    T.upsert_sessions(spark, frame(spark, session("a", 1, 9, "newer", 5)), path)
    for _ in range(3):
        assert stored(spark, path) == {"a": ("new", 5, 2), "b": ("m", 1, 4)}
        T.fold_sessions(spark, path)


def test_a_drain_writes_its_own_rows_only(spark, scratch):
    """An upsert reads nothing of the table: it also works on days that cannot be read."""
    path = os.path.join(scratch, "t")
    T.upsert_sessions(spark, frame(spark, *(session(f"s{i}", i % 3, 5) for i in range(30))), path)
    T.fold_sessions(spark, path)
    plan = T.sessions_table(spark, path)
    files_before = {os.path.join(d, f) for d, _, fs in os.walk(os.path.join(path, "base")) for f in fs}
    T.upsert_sessions(spark, frame(spark, session("s1", 1, 9, completion=8)), path, "drain", 0)
    assert files_before == {os.path.join(d, f) for d, _, fs in os.walk(os.path.join(path, "base")) for f in fs}
    delta = plan.state().deltas
    assert len(delta) == 1 and spark.read.parquet(f"{path}/deltas/seq={delta[0]}").count() == 1
    text = T.read_sessions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_a_broken_table_is_not_taken_for_none(spark, scratch):
    path = os.path.join(scratch, "t")
    T.upsert_sessions(spark, frame(spark, session("a", 0, 5), session("b", 0, 5)), path)
    T.fold_sessions(spark, path)
    day = os.path.join(path, "base", "day=2024-01-01")
    broken = os.path.join(day, os.listdir(day)[0], "part-broken.parquet")
    with open(broken, "wb") as f:
        f.write(b"not parquet")
    T.upsert_sessions(spark, frame(spark, session("c", 0, 5)), path)
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET|FAILED_READ"):
        T.fold_sessions(spark, path)
    os.replace(broken, os.path.join(scratch, "aside"))
    assert set(stored(spark, path)) == {"a", "b", "c"}


def test_archive_of_an_upserted_table_follows_late_writes(spark, scratch):
    path, to = os.path.join(scratch, "llm_sessions"), os.path.join(scratch, "archive")
    T.upsert_sessions(spark, frame(spark, session("a", 0, 5), session("b", 4, 5)), path)
    assert [(d, n) for d, n, _ in A.archive(spark, path, "llm_sessions", dt.date(2024, 1, 3), to)] == [("2024-01-01", 1)]
    assert A.archive(spark, path, "llm_sessions", dt.date(2024, 1, 3), to) == []
    T.upsert_sessions(spark, frame(spark, session("c", 0, 5)), path)
    assert [(d, n) for d, n, _ in A.archive(spark, path, "llm_sessions", dt.date(2024, 1, 3), to)] == [("2024-01-01", 2)]


def test_reconcile_reads_only_changed_days(spark, scratch):
    from fleetlens.operators.sessions import track_sessions
    from fleetlens.schemas import LLM_CHUNKS
    from fleetlens.streaming.sessions import reconcile_landed
    from pyspark.sql import functions as F

    chunks, path = os.path.join(scratch, "chunks"), os.path.join(scratch, "sessions")

    def land(*rows):
        spark.createDataFrame(list(rows), LLM_CHUNKS).withColumn("date", F.to_date("arrival_ts")).write.mode("append").partitionBy("date").parquet(chunks)

    at = lambda day, s: T0 + dt.timedelta(days=day, seconds=s)
    rows = [(f"s{d}", 1, at(d, 0), "m", "x", 5, 100, None, False) for d in range(5)] + [(f"s{d}", 2, at(d, 1), "m", "y", 9, 200, None, True) for d in range(5)]
    land(*rows)
    assert reconcile_landed(spark, chunks, path) == 5 and reconcile_landed(spark, chunks, path) == 0
    late = ("s2", 0, at(1, 86399), "early", None, None, None, 4, False)
    land(late)
    assert reconcile_landed(spark, chunks, path) == 1
    want = track_sessions(spark.createDataFrame([*rows, late], LLM_CHUNKS)).collect()
    assert sorted(map(str, T.read_sessions(spark, path).drop("start_date").collect())) == sorted(map(str, want))


def test_weekly_state_reads_new_batches_only_and_equals_the_summary(spark, scratch):
    from pyspark.sql import functions as F

    from fleetlens.operators.rollups import weekly_summary
    from fleetlens.plans.jobs import weekly_state
    from fleetlens.schemas import PROCESS_EVENTS
    from fleetlens.sinks.compaction import compact_day, read_ingested
    from fleetlens.streaming.ingest import _write_batch

    path, state, week = os.path.join(scratch, "e"), os.path.join(scratch, "state"), dt.date(2024, 1, 1)

    def land(batch, *rows, again=None):
        ev = [(T0 + dt.timedelta(days=d), pid, "p", cat, 10 + pid, 7 * pid % 100, "c", None, 1) for d, pid, cat, _ in rows]
        out = spark.createDataFrame(ev, PROCESS_EVENTS).withColumn("host", F.lit("a")).withColumn("poll_id", F.col("pid"))
        _write_batch(out.withColumn("written_batch", F.lit(batch).cast("long")), path, batch)
        if again:
            spark.createDataFrame([("a", p) for p in again], "host string, poll_id long").write.parquet(f"{path}/_superseded/batch_id={batch}")

    def same():
        got = sorted(map(str, weekly_state(spark, path, state, week).collect()))
        assert got == sorted(map(str, weekly_summary(read_ingested(spark, path), "2024-01-01").collect())) and got
        return got

    land(0, (0, 1, "gaming", 0), (1, 2, "gaming", 0), (6, 3, "ml_training", 0))
    land(1, (0, 4, "gaming", 0), (8, 5, "gaming", 0))
    land(2, (2, 6, "other", 0))
    first = same()
    mark = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(state) for f in fs if f.endswith(".parquet")}
    assert same() == first
    land(3, (0, 7, "llm_inference", 0))
    same()
    assert mark.items() <= {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(state) for f in fs if f.endswith(".parquet")}.items()
    land(4, (0, 1, "llm_inference", 0), again=[1])          # the poll of pid 1 written anew
    same()
    compact_day(spark, path, week)
    same()
    land(5, (0, 9, "gaming", 0))
    same()


def test_upkeep_reconciles_folds_and_sums_late_rows(spark, scratch):
    from pyspark.sql import functions as F

    from fleetlens.operators.sessions import track_sessions
    from fleetlens.plans.jobs import hourly_upkeep
    from fleetlens.schemas import LLM_CHUNKS

    tables = {"llm_sessions": os.path.join(scratch, "llm_sessions")}
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("s", 1, at(0), "m", "x", 5, 100, None, False), ("s", 2, at(1), "m", "y", 9, 200, None, True)]
    T.upsert_sessions(spark, track_sessions(spark.createDataFrame(rows, LLM_CHUNKS)), tables["llm_sessions"], "drain", 0)
    late = ("s", 3, at(5), "m", "z", 50, 900, 7, True)                # the stream had dropped it
    chunks = spark.createDataFrame([*rows, late], LLM_CHUNKS)
    chunks.withColumn("date", F.to_date("arrival_ts")).write.partitionBy("date").parquet(os.path.join(scratch, "chunks"))
    for _ in range(2):
        hourly_upkeep(spark, tables, os.path.join(scratch, "archive"), os.path.join(scratch, "weekly"), 7,
                      dt.datetime(2024, 1, 17, 12, tzinfo=dt.timezone.utc), chunks_path=os.path.join(scratch, "chunks"))
        want = T.merge_sessions(track_sessions(chunks).limit(0), track_sessions(chunks)).collect()
        assert sorted(map(str, T.read_sessions(spark, tables["llm_sessions"]).drop("start_date").collect())) == sorted(map(str, want))
    assert T.sessions_table(spark, tables["llm_sessions"]).state().deltas == ()
