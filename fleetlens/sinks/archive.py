"""Archival and retention (K5-K9), one closed date partition at a time.

A table is a folder of date partitions (``date=D`` or ``start_date=D``).  Dates
before a cutoff are archived to ``{archive_dir}/{table}_{D}.parquet`` once:

* A table that is trimmed has its partition first moved to a folder readers do
  not see (``_archiving/``, one atomic rename), then copied into the archive as
  batch 0, 1, ..., then deleted.  Rows of that date that arrive later form a new
  partition and, in their turn, the next batch.  A job that dies is finished by
  the next one, which finds the moved folder and copies it over the same batch.
* A table that is kept has the archive of a date rewritten only when the
  partition has changed since (its signature, bytes and number of files, is kept
  in a marker written after the copy).

So no row is deleted before it is archived, none is archived twice, and the
history is not copied again with every cutoff.  All steps work on folders; no
list of files is collected.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.functions.display import as_instant
from fleetlens.operators.pruning import before_date
from fleetlens.schemas import ARCHIVE_LOG
from fleetlens.sinks.compaction import MANIFESTS, compact_day, without_superseded
from fleetlens.sinks.files import Folders
from fleetlens.sinks.tables import sessions_table
from fleetlens.sinks.versions import LOG

# Archived tables and their time columns.
ARCHIVE_TIME_COLUMNS = {"gpu_metrics": "timestamp", "process_events": "timestamp", "llm_sessions": "start_time"}
PARTITION_COLUMNS = {"llm_sessions": "start_date"}
MOVED = "_archiving"


def cutoff_date(now, days: int) -> _dt.date:
    """date(now - days) in UTC."""
    return (as_instant(now, "now") - _dt.timedelta(days=days)).date()


def archive_path(archive_dir: str, table: str, day: str) -> str:
    return f"{archive_dir.rstrip('/')}/{table}_{day}.parquet"


def log_path(archive_dir: str) -> str:
    """K6: the log is a table next to the archive folder, not an archive."""
    return f"{archive_dir.rstrip('/')}_log"


def _closed(fs: Folders, path: str, column: str, cutoff: _dt.date) -> list[str]:
    """Days before the cutoff that have a partition (the rows without a time stay)."""
    days = [n.split("=", 1)[1] for n in fs.folders(path, f"{column}=")]
    return [d for d in days if d[:1].isdigit() and d < cutoff.isoformat()]


def archive(spark: SparkSession, path: str, table: str, cutoff: _dt.date, archive_dir: str,
            trim: bool = False) -> list[tuple[str, int, str]]:
    """K5: archive every date partition before the cutoff; with ``trim`` they leave the table.

    Returns (day, rows, archive path) of what was archived now.
    """
    path = path.rstrip("/")
    fs, column = Folders(spark, path), PARTITION_COLUMNS.get(table, "date")
    to = Folders(spark, archive_dir)
    done = []
    if fs.exists(f"{path}/{LOG}"):
        return _archive_keyed(spark, path, table, cutoff, archive_dir)
    for day in _closed(fs, path, column, cutoff):
        if fs.exists(f"{path}/{MANIFESTS}/date={day}"):
            compact_day(spark, path, _dt.date.fromisoformat(day))      # finish what was begun
    if trim:
        for day in _closed(fs, path, column, cutoff):
            n = len(to.folders(archive_path(archive_dir, table, day), "batch="))
            moved = f"{path}/{MOVED}/{day}"
            taken = len(fs.folders(moved, "batch="))
            fs.move(f"{path}/{column}={day}", f"{moved}/batch={n + taken}")
        for day in fs.folders(f"{path}/{MOVED}"):
            for batch in fs.folders(f"{path}/{MOVED}/{day}", "batch="):
                moved, target = f"{path}/{MOVED}/{day}/{batch}", f"{archive_path(archive_dir, table, day)}/{batch}"
                rows = _copy(spark, path, moved, target)
                fs.delete(moved)
                done.append((day, rows, archive_path(archive_dir, table, day)))
        return done
    for day in _closed(fs, path, column, cutoff):
        source, target = f"{path}/{column}={day}", archive_path(archive_dir, table, day)
        marker, now = f"{archive_dir.rstrip('/')}/_{table}_{day}", fs.signature(f"{path}/{column}={day}")
        if to.exists(marker) and to.read_text(marker) == now:
            continue
        rows = _copy(spark, path, source, f"{target}/batch=0")
        to.write_text(marker, now)
        done.append((day, rows, target))
    return done


def _archive_keyed(spark: SparkSession, path: str, table: str, cutoff: _dt.date, archive_dir: str) -> list[tuple[str, int, str]]:
    """Closed days of an upserted table (kept, never trimmed): archived anew where a write has touched the day."""
    keyed, to, done = sessions_table(spark, path), Folders(spark, archive_dir), []
    for day, now in keyed.signatures().items():
        if not day[:1].isdigit() or day >= cutoff.isoformat():
            continue
        target, marker = archive_path(archive_dir, table, day), f"{archive_dir.rstrip('/')}/_{table}_{day}"
        if to.exists(marker) and to.read_text(marker) == now:
            continue
        keyed.read([day]).write.mode("overwrite").option("compression", "snappy").parquet(f"{target}/batch=0")
        to.write_text(marker, now)
        done.append((day, spark.read.parquet(target).count(), target))
    return done


def _copy(spark: SparkSession, path: str, source: str, target: str) -> int:
    """The rows of one partition, with their batch if they have one, written over ``target``; their number."""
    rows = without_superseded(spark, path, spark.read.option("basePath", source).parquet(source))
    rows.write.mode("overwrite").option("compression", "snappy").parquet(target)
    return spark.read.parquet(target).count()


def archive_log(spark: SparkSession, entries: list[tuple[_dt.date, str, int, str]], archive_dir: str) -> DataFrame:
    """K6: append one ``archive_log`` row per archived table and day."""
    df = spark.createDataFrame(entries, ARCHIVE_LOG)
    if entries:
        df.write.mode("append").parquet(log_path(archive_dir))
    return df


def list_archives(spark: SparkSession, archive_dir: str) -> DataFrame:
    """K7: archives (``*.parquet`` entries of the archive folder), sorted by path,
    with their file count and size.  A Spark listing job; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(archive_dir)
             .select("path", "length"))
    base = archive_dir.rstrip("/")
    rel = F.regexp_extract(F.col("path"), r"^.*?" + _re_escape(base.split("://")[-1]) + r"/([^/]+)", 1)
    return (files.where(rel.endswith(".parquet"))
            .groupBy(rel.alias("archive"))
            .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
            .orderBy("archive"))


def archive_size(spark: SparkSession, archive_dir: str) -> int:
    """K7: bytes of all archives."""
    return int(list_archives(spark, archive_dir).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"])


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def retain(spark: SparkSession, path: str, cutoff: _dt.date, table: str = "gpu_metrics") -> int:
    """K8: delete the date partitions before the cutoff, whole; returns the number of rows deleted."""
    path = path.rstrip("/")
    fs, column = Folders(spark, path), PARTITION_COLUMNS.get(table, "date")
    days = _closed(fs, path, column, cutoff)
    if not days:
        return 0
    rows = spark.read.parquet(path)
    n = rows.where(F.col(column) < F.lit(cutoff)).count()       # partition filter: footers only
    for day in days:
        fs.delete(f"{path}/{column}={day}")
    return n


def maintain(spark: SparkSession, tables: Mapping[str, str], archive_dir: str, retention_days: int, now,
             trim: tuple[str, ...] = ("gpu_metrics",), enabled: bool = True) -> DataFrame:
    """K9: archive every table's dates before date(now - days) and log them; the ``trim`` tables lose
    exactly what was archived.  Returns a report (table, archived, deleted, archives)."""
    config.prepare(spark)
    report, log = [], []
    cut = cutoff_date(now, retention_days)
    for table, path in tables.items() if enabled else ():
        done = archive(spark, path, table, cut, archive_dir, trim=table in trim)
        rows = sum(n for _, n, _ in done)
        report.append((table, rows, rows if table in trim else 0, len(done)))
        log += [(_dt.date.fromisoformat(day), table, n, where) for day, n, where in done]
    archive_log(spark, log, archive_dir)
    return spark.createDataFrame(report, "table string, archived long, deleted long, archives long")


def archive_split(df: DataFrame, table: str, cutoff: _dt.date) -> DataFrame:
    """K5 selection as a query: how many rows an archive at ``cutoff`` takes
    (time before the cutoff date, UTC) and how many stay live."""
    before = before_date(df, ARCHIVE_TIME_COLUMNS[table], cutoff)
    return df.agg(F.lit(table).alias("table_name"), F.lit(cutoff).alias("cutoff"),
                  F.count_if(before).alias("archived_rows"), F.count_if(~before).alias("kept_rows"))


def retention_split(df: DataFrame, days: int, now, table: str = "gpu_metrics") -> DataFrame:
    """K8 selection as a query: rows a retention of ``days`` at ``now`` deletes and keeps."""
    cut = cutoff_date(now, days)
    before = before_date(df, ARCHIVE_TIME_COLUMNS[table], cut)
    return df.agg(F.lit(cut).alias("cutoff"), F.count_if(before).alias("deleted_rows"),
                  F.count_if(~before).alias("kept_rows"))
