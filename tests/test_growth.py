"""What grows with the input is dealt to many tasks, and written files follow the days, not tasks times days."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.operators.sessions import track_sessions
from fleetlens.plans import catalog
from fleetlens.schemas import LLM_CHUNKS
from fleetlens.sinks import tables as TB
from fleetlens.streaming import ingest as IN
from fleetlens.streaming.sessions import drain_sessions, track_sessions_stream

T0 = dt.datetime(2024, 1, 1)


def files(*path):
    return glob.glob(os.path.join(*path, "*.parquet"))


@pytest.fixture()
def many_tasks(spark):
    """Small shuffles and joins stay as many tasks as large ones have."""
    conf = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def events(spark, folder, n=400):
    kinds = ["click", "view", "purchase", "signup", "error"]
    rows = [(i, T0 + dt.timedelta(minutes=97 * i), i * 7 % 61, kinds[i % 5], 10.0 + i % 90, f'{{"k": {i % 50 + 1}}}') for i in range(n)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    return folder


def test_a_drained_batch_writes_a_file_of_a_day(spark, scratch):
    days = 5
    rows = [(f"s{i}", t, T0 + dt.timedelta(days=i % days, seconds=20 * i + t), "m", "x" if t else None, 2 if t else None, 10 if t else None,
             None if t else 3, t == 2) for i in range(60) for t in range(3)]
    chunks = spark.createDataFrame(rows, "session_id string, seq long, arrival_ts timestamp, model string, response string, eval_count long, "
                                         "eval_duration long, prompt_eval_count long, done boolean")
    chunks = chunks.select(*[F.col(f.name).cast(f.dataType) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LLM_CHUNKS])
    chunks.repartition(4).write.parquet(f"{scratch}/chunks")
    stream = spark.readStream.schema(LLM_CHUNKS).parquet(f"{scratch}/chunks")
    query = drain_sessions(spark, track_sessions_stream(stream), f"{scratch}/sessions", f"{scratch}/checkpoint", available_now=True)
    query.awaitTermination()
    assert query.exception() is None
    assert len(files(scratch, "sessions", "deltas", "seq=*", "day=*")) == days
    stored = TB.read_sessions(spark, f"{scratch}/sessions").drop("start_date").collect()
    assert sorted(map(str, stored)) == sorted(map(str, track_sessions(spark.read.schema(LLM_CHUNKS).parquet(f"{scratch}/chunks")).collect()))


def test_a_micro_batch_of_the_ingest_writes_a_file_of_a_date(spark, scratch):
    rows = spark.range(400).select(F.col("id").alias("gpu_id"), (F.lit(T0) + F.make_dt_interval((F.col("id") % 3).cast("int"))).alias("timestamp"))
    IN._write_batch(rows.repartition(8), f"{scratch}/m", 0)
    assert len(files(scratch, "m", "date=*", "batch_id=0")) == 3
    assert spark.read.parquet(f"{scratch}/m").count() == 400


def test_landings_of_the_ingest_are_written_and_read_by_many_tasks(spark, scratch, monkeypatch, many_tasks):
    monkeypatch.setattr(catalog, "_scratch", lambda spark, name: f"{scratch}/{name}")
    given = events(spark, f"{scratch}/given")
    catalog.QUERIES["ingest"](spark, given).count()
    assert all(len(files(scratch, "ingest", "rows", f"landed-{n}")) > 1 for n in range(3))
    landed = spark.read.parquet(*[f"{scratch}/ingest/rows/landed-{n}" for n in range(4)])
    assert landed.count() == spark.read.parquet(f"{given}/events.parquet").count()


def test_landings_of_an_export_are_written_by_many_tasks(spark, scratch, monkeypatch, many_tasks):
    config.prepare(spark)
    monkeypatch.setattr(catalog, "_scratch", lambda spark, name: f"{scratch}/{name}")
    given = events(spark, f"{scratch}/given")
    late = catalog.QUERIES["export_process_10s_late"](spark, given)
    assert sorted(map(str, late.collect())) == sorted(map(str, catalog.QUERIES["export_process_10s"](spark, given).select(*late.columns).collect()))
    assert all(len(files(scratch, "late-p", "rows", f"landed-{n}")) > 1 for n in range(3))
