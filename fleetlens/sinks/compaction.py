"""Compaction of the ingest tables' per-micro-batch partitions.

The ingest stream (R2) writes each micro-batch into its own
``date=D/batch_id=N`` partition so a replay replaces its own output.  At a 2 s
trigger that is tens of thousands of small partitions a day, so closed days are
compacted.  Batch ids rise, so "all batches up to U" names an input that later
batches never join; the newest batch of the table is left out, as the stream may
still replay it.

1. a manifest ``_compaction/date=D`` names U;
2. the input of many days is written by one job, sorted and in files of a target size, to a
   folder readers do not see, then moved, day by day, to ``date=D/batch_id=-(U + 1)``;
3. a marker beside the manifest says that it is published;
4. the input batches' folders are deleted, then the manifest, then the marker.

A job that dies anywhere is finished by the next one from the manifest: before 3
it writes the same input again over what it had, after 3 it only deletes.
``read_ingested`` reads such a table without double rows at every moment: it
ignores the compacted batch until it is published and the input after that.
Late rows form batches above U and wait for the next compaction of the day.  Rows of polls that a later
batch has written anew (``_superseded``, see ``streaming.ingest``) are left out by readers and by the copy.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.sinks.files import Folders

MANIFESTS = "_compaction"
PUBLISHED = ".published"


def _batches(fs: Folders, day_path: str) -> list[int]:
    return sorted(int(n.split("=", 1)[1]) for n in fs.folders(day_path, "batch_id="))


def _manifests(fs: Folders, path: str) -> dict[str, tuple[int, bool]]:
    """day -> (U, published) of unfinished compactions."""
    names = fs.files(f"{path}/{MANIFESTS}")
    return {n.split("=", 1)[1]: (int(fs.read_text(f"{path}/{MANIFESTS}/{n}")), n + PUBLISHED in names)
            for n in names if n.startswith("date=") and "." not in n}


def hidden_batches(spark: SparkSession, path: str):
    """A predicate of (day, batch_id): folders that readers leave out while the day is being compacted."""
    begun = _manifests(Folders(spark, path), path)

    def hidden(day: str, batch: int) -> bool:
        if day not in begun:
            return False
        up_to, published = begun[day]
        return 0 <= batch <= up_to if published else batch == -(up_to + 1)

    return hidden


SUPERSEDED = "_superseded"


def without_superseded(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """``df`` (rows of the ingest table ``path``) without the output of polls that a later batch has written anew."""
    if "written_batch" not in df.columns or not Folders(spark, path).folders(f"{path}/{SUPERSEDED}", "batch_id="):
        return df
    keys = [c for c in ("host", "poll_id") if c in df.columns]
    later = spark.read.parquet(f"{path}/{SUPERSEDED}").groupBy(*keys).agg(F.max("batch_id").alias("_by"))
    same = [df[k].eqNullSafe(later[k]) for k in keys]
    return df.join(later, [*same, df["written_batch"] < later["_by"]], "left_anti")


def read_ingested(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An ingest table as readers should see it while days are being compacted."""
    path = path.rstrip("/")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    for day, (up_to, published) in _manifests(Folders(spark, path), path).items():
        here = F.col("date") == F.lit(day).cast("date")
        hidden = F.col("batch_id").between(0, up_to) if published else F.col("batch_id") == -(up_to + 1)
        df = df.where(~(here & hidden))
    return without_superseded(spark, path, df)


def compact_days(spark: SparkSession, path: str, days: Sequence[_dt.date], target_bytes: int = 256 * 1024 * 1024,
                 sort: Sequence[str] = ()) -> int:
    """Compact closed days of an ingest table (or finish compactions of them); returns the number of input
    batches.  All days are read and written by one job; each day is then published by itself."""
    config.prepare(spark)
    path = path.rstrip("/")
    fs = Folders(spark, path)
    unfinished, names = _manifests(fs, path), [d.isoformat() for d in days]
    newest = max((max(_batches(fs, f"{path}/{d}"), default=-1) for d in fs.folders(path, "date=")), default=-1)
    begun: dict[str, tuple[int, bool]] = {}
    for day in names:
        manifest = f"{path}/{MANIFESTS}/date={day}"
        if day in unfinished:
            begun[day] = unfinished[day]
            continue
        inputs = [b for b in _batches(fs, f"{path}/date={day}") if 0 <= b < newest]
        if len(inputs) > 1:
            fs.delete(manifest + PUBLISHED)          # of a compaction that ended just before removing it
            fs.write_text(manifest, str(inputs[-1]))
            begun[day] = (inputs[-1], False)
    batches = {day: [b for b in _batches(fs, f"{path}/date={day}") if 0 <= b <= up_to] for day, (up_to, _) in begun.items()}
    _publish(spark, fs, path, {d: begun[d][0] for d in begun if not begun[d][1]}, batches, target_bytes, sort)
    for day in begun:
        manifest = f"{path}/{MANIFESTS}/date={day}"
        for b in batches[day]:
            fs.delete(f"{path}/date={day}/batch_id={b}")
        fs.delete(manifest)
        fs.delete(manifest + PUBLISHED)
    return sum(map(len, batches.values()))


def _publish(spark: SparkSession, fs: Folders, path: str, days: dict[str, int], batches: dict[str, list[int]], target_bytes: int,
             sort: Sequence[str]) -> None:
    """Write the compacted batch of every day aside, in one job, then move and mark them day by day."""
    if not days:
        return
    staging = f"{path}/{MANIFESTS}/staging"
    fs.delete(staging)
    for day, up_to in days.items():
        fs.delete(f"{path}/date={day}/batch_id={-(up_to + 1)}")
    inputs = [f"{path}/date={day}/batch_id={b}" for day in days for b in batches[day]]
    size = sum(int(fs.signature(f"{path}/date={day}").split("-")[0]) for day in days)
    rows = without_superseded(spark, path, spark.read.option("basePath", path).parquet(*inputs)).drop("batch_id")
    order = [c for c in (*sort, "timestamp") if c in rows.columns]
    rows = rows.repartitionByRange(max(1, -(-size // target_bytes), min(len(days), 64)), "date", *order).sortWithinPartitions("date", *order)
    rows.write.mode("overwrite").partitionBy("date").parquet(staging)
    for day, up_to in days.items():
        target = f"{path}/date={day}/batch_id={-(up_to + 1)}"
        if fs.exists(f"{staging}/date={day}"):          # else every row of the day was superseded
            fs.move(f"{staging}/date={day}", target)
        else:
            fs.make(target)
        fs.write_text(f"{path}/{MANIFESTS}/date={day}{PUBLISHED}", "")
    fs.delete(staging)


def compact_day(spark: SparkSession, path: str, day: _dt.date, target_bytes: int = 256 * 1024 * 1024,
                sort: Sequence[str] = ()) -> int:
    """``compact_days`` of one day."""
    return compact_days(spark, path, [day], target_bytes, sort)


#: Days that one job compacts; a backlog takes several.
DAYS_AT_ONCE = 64


def compact_closed_days(spark: SparkSession, path: str, today: _dt.date, sort: Sequence[str] = ()) -> int:
    """Compact every day before ``today`` that has several batches, or an unfinished compaction."""
    path = path.rstrip("/")
    fs = Folders(spark, path)
    days = {n.split("=", 1)[1] for n in fs.folders(path, "date=")} | set(_manifests(fs, path))
    closed = [_dt.date.fromisoformat(d) for d in sorted(days) if d[:1].isdigit() and d < today.isoformat()]
    return sum(compact_days(spark, path, closed[i:i + DAYS_AT_ONCE], sort=sort) for i in range(0, len(closed), DAYS_AT_ONCE))
