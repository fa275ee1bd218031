"""End-to-end jobs composed from the operators (one lazy plan each, or a short
sequence of writes).  No loop lives here: a scheduler calls these."""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.functions.display import as_instant
from fleetlens.functions.gpu import memory_view
from fleetlens.operators import metrics as M
from fleetlens.operators import rollups as R
from fleetlens.operators import series as S
from fleetlens.operators import sessions as SS
from fleetlens.sinks import archive as A
from fleetlens.sinks import tables as T
from fleetlens.schemas import PROCESS_EVENTS, WEEKLY_PARTS
from fleetlens.sinks.compaction import SUPERSEDED, compact_closed_days, hidden_batches, read_ingested, without_superseded
from fleetlens.sinks.files import Folders
from fleetlens.streaming.sessions import reconcile_landed

# Leading sort columns of the stored tables (then time), for row-group pruning.
SORT_COLUMNS = {"gpu_metrics": ("gpu_id",), "process_events": ("category",)}


def weekly_state(spark: SparkSession, events_path: str, state_path: str, week: _dt.date) -> DataFrame:
    """A1 of the week that begins on ``week`` over an ingest table, kept up batch by batch.

    ``state_path`` holds A1's parts per (date, batch_id), a few rows each.  A run lists the batch folders
    of the week (metadata), reads only those that have no parts yet, and drops parts whose batch is gone
    (compacted: the compacted batch counts instead).  Batches whose polls a later batch has written anew
    are read again, so late and split polls count once.
    """
    events_path, state_path = events_path.rstrip("/"), state_path.rstrip("/")
    fs, own = Folders(spark, events_path), Folders(spark, state_path)
    days = [(week + _dt.timedelta(days=n)).isoformat() for n in range(7)]
    hidden = hidden_batches(spark, events_path)
    there = {(d, int(b.split("=", 1)[1])) for d in days for b in fs.folders(f"{events_path}/date={d}", "batch_id=")}
    there = {(d, b) for d, b in there if not hidden(d, b)}
    have = {(d, int(b.split("=", 1)[1])) for d in days for b in own.folders(f"{state_path}/date={d}", "batch_id=")}
    notes = fs.folders(f"{events_path}/{SUPERSEDED}", "batch_id=")
    seen_file = f"{state_path}/_seen"
    seen = set(json.loads(own.read_text(seen_file))) if own.exists(seen_file) else set()
    fresh = sorted(int(n.split("=", 1)[1]) for n in notes if n not in seen)
    again = set()
    if fresh and have:
        polls = spark.read.parquet(*[f"{events_path}/{SUPERSEDED}/batch_id={b}" for b in fresh])
        keys = polls.columns
        old = spark.read.parquet(events_path).where(F.col("date").isin([_dt.date.fromisoformat(d) for d in days]))
        touched = old.join(polls.distinct(), keys, "left_semi").select(F.col("date").cast("string"), F.col("batch_id").cast("long")).distinct()
        again = {(r[0], r[1]) for r in touched.collect()}
    missing = sorted((there - have) | (again & there))
    for d, b in sorted((have - there) | (again & have)):
        own.delete(f"{state_path}/date={d}/batch_id={b}")
    if missing:
        rows = spark.read.option("basePath", events_path).parquet(*[f"{events_path}/date={d}/batch_id={b}" for d, b in missing])
        parts = R.weekly_parts(without_superseded(spark, events_path, rows), by=("date", "batch_id"))
        # a batch without a counted event has parts too: an empty folder
        parts.write.mode("append").partitionBy("date", "batch_id").parquet(state_path)
        for d, b in missing:
            own.make(f"{state_path}/date={d}/batch_id={b}")
    own.write_text(seen_file, json.dumps(sorted(notes)))
    kept = [f"{state_path}/date={d}/batch_id={b}" for d, b in sorted(there)]
    if not kept:
        return R.weekly_summary(spark.createDataFrame([], PROCESS_EVENTS))
    parts = spark.read.schema(WEEKLY_PARTS).parquet(*kept)
    return R.weekly_from_parts(parts.where(F.col("week_start") == F.lit(week)))


def hourly_upkeep(spark: SparkSession, tables: Mapping[str, str], archive_dir: str, weekly_path: str,
                  retention_days: int, now, archival: bool = True, compact: bool = True, chunks_path: str | None = None) -> DataFrame:
    """What a scheduler runs every hour.

    1. Sessions with chunks in days that have changed (``chunks_path``: landed chunks by ``date``) are
       reconciled, and the upserts of the hour folded into the session table (``tables["llm_sessions"]``);
    2. the current week's workload summary (A1 over process_events) is upserted into ``weekly_path``
       (K4), over an ingest table from the batches that are new since the last run;
    3. the closed days' micro-batch partitions are compacted, also of days that an earlier run missed;
    4. storage maintenance (K9).

    Returns the maintenance report.  Every step converges when run again, also after a run that died.
    """
    config.prepare(spark)
    inst = as_instant(now, "now")
    if (sessions := tables.get("llm_sessions")) is not None:
        if chunks_path is not None:
            reconcile_landed(spark, chunks_path, sessions)
        T.fold_sessions(spark, sessions)
    monday = (inst - _dt.timedelta(days=inst.weekday())).date()
    if (events := tables.get("process_events")) is not None:
        batched = any(Folders(spark, events).folders(f"{events.rstrip('/')}/{d}", "batch_id=") for d in Folders(spark, events).folders(events, "date="))
        if batched:
            summary = weekly_state(spark, events, f"{weekly_path.rstrip('/')}_parts", monday)
        else:
            summary = R.weekly_summary(read_ingested(spark, events), week=monday.isoformat())
        T.upsert_weekly_summaries(spark, summary, weekly_path)
    if compact:
        for table, path in tables.items():
            if table != "llm_sessions" and "batch_id" in spark.read.parquet(path).columns:
                compact_closed_days(spark, path, inst.date(), SORT_COLUMNS.get(table, ()))
    return A.maintain(spark, tables, archive_dir, retention_days, now, enabled=archival)


def chart_panel(metrics: DataFrame, gpu_id: int, hours: float, now) -> dict[str, DataFrame]:
    """One GPU's chart over the last ``hours``: downsampled arrays, full-series
    statistics and trend, all from one range scan (T1 -> P2 -> A8, A9, W1, W2)."""
    scan = M.recent_metrics(metrics, hours, now, order=False).where(F.col("gpu_id") == F.lit(gpu_id))
    return {
        "arrays": M.chart_arrays(scan, S.max_points_for_range(hours)),
        "stats": M.series_stats(memory_view(scan)),
        "trend": S.trend(scan, M.CHART_METRICS),
    }


def session_panel(sessions: DataFrame, now) -> dict[str, DataFrame]:
    """E3 (batch side): the rolling 24 h panel: totals, per-model stats, best model, newest ten."""
    window = SS.rolling_sessions(sessions, now)
    return {
        "totals": SS.session_totals(window),
        "models": SS.model_stats(window),
        "best": SS.best_model(window),
        "recent": SS.recent_sessions(window, 10),
    }
