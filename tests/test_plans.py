"""Plan shape: pruning reaches the scan, no cross joins, no Python in batch queries."""

import datetime as dt
import os

import pytest

import __spark_entry__ as E
from fleetlens.operators.metrics import recent_metrics, series_stats
from fleetlens.operators.sessions import sessions_between
from fleetlens.schemas import GPU_METRICS, LLM_SESSIONS
from fleetlens.sinks.archive import archive_split
from fleetlens.sinks.tables import append_gpu_metrics, fold_sessions, read_sessions, upsert_sessions

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _metrics_table(spark, scratch):
    path = os.path.join(scratch, "gpu_metrics")
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20, i % 24), i % 3, "GPU", 1, 2, 3, 4, 5, 6) for i in range(200)]
    append_gpu_metrics(spark.createDataFrame(rows, GPU_METRICS), path)
    return spark.read.parquet(path)


def test_time_range_prunes_partitions_and_pushes_filter(spark, scratch):
    table = _metrics_table(spark, scratch)
    df = recent_metrics(table, 48, "2024-01-20T12:00:00Z")
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(date" in plan and ">= 2024-01-18" in plan
    assert "GreaterThanOrEqual(timestamp," in plan
    assert all(r["timestamp"] >= dt.datetime(2024, 1, 18, 12) for r in df.collect())


def test_archive_selection_prunes_partitions(spark, scratch):
    table = _metrics_table(spark, scratch)
    plan = _plan(archive_split(table, "gpu_metrics", dt.date(2024, 1, 5)))
    assert "PartitionFilters" in plan and "< 2024-01-05" in plan


def test_session_range_prunes_start_date(spark, scratch):
    path = os.path.join(scratch, "sessions")
    rows = [(f"s{i}", dt.datetime(2024, 1, 1 + i % 10), None, "m", 1, 1, 2, 1.0, None, None) for i in range(30)]
    upsert_sessions(spark, spark.createDataFrame(rows, LLM_SESSIONS), path)
    fold_sessions(spark, path)
    df = sessions_between(read_sessions(spark, path), "2024-01-03T00:00:00Z", "2024-01-04T00:00:00Z")
    plan = _plan(df)
    assert "PartitionFilters" in plan and "start_date" in plan
    assert {r["start_time"].day for r in df.collect()} == {3, 4}


def test_column_pruning(spark):
    from fleetlens import fixtures
    from fleetlens.operators.metrics import gpu_count
    plan = _plan(gpu_count(fixtures.view(spark, SF, "gpu_metrics")))
    # A device count reads the one column gpu_id derives from, nothing else.
    assert "ReadSchema: struct<user_id:bigint>" in plan
    plan = _plan(series_stats(fixtures.view(spark, SF, "gpu_metrics"), metrics=("utilization_gpu",)))
    read = plan[plan.index("ReadSchema:"):].split("\n")[0]
    assert "props" not in read and "event_type" not in read


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_join_or_python(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)


def test_cluster_sizing_keeps_explicit_settings(spark):
    from fleetlens import config
    before = {k: spark.conf.get(k, None) for k in config.CLUSTER_CONF}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))   # the cluster's own choice
        config.apply_cluster_sizing(spark)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(64 * 1024 * 1024)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(256 * 1024 * 1024)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_latest_values_are_hash_aggregates(spark):
    """No raw row is sorted for its first partial aggregate."""
    from fleetlens import fixtures
    from fleetlens.operators import metrics as M
    from fleetlens.operators import rollups as R
    g = fixtures.view(spark, "/root/testdata/sf0.001", "gpu_metrics")
    events = g.selectExpr("timestamp", "name", "'gaming' AS category", "id AS pid", "memory_used AS gpu_memory_mb")
    for df in (M.series_stats(g), M.gpu_gauges(g), R.export_windows(g), R.process_memory(events), R.category_gauges(events),
               R.export_process_gauges(events)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    # W3 has text columns: only the rows that match the newest order are aggregated by sorting
    plan = M.latest_per_gpu(g)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("Join") and "HashAggregate" in plan
