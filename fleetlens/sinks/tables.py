"""Table writes on Parquet: appends (K1, K3) and upserts (K2, K4).

Appended tables are directories partitioned by a date column.  Upserted tables are
``versions.KeyedTable``: an upsert writes its own rows as one delta and publishes it by
a rename, readers merge by key, and upkeep folds the deltas into the base.  A job that
dies at any step leaves the table as it was, and no upsert reads or rewrites a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.schemas import LLM_SESSIONS, WEEKLY_SUMMARIES
from fleetlens.sinks.versions import KeyedTable


def append_partitioned(df: DataFrame, path: str, ts: str = "timestamp", date_col: str = "date",
                       sort: tuple[str, ...] = ()) -> None:
    """Append rows partitioned by the UTC date of ``ts``; each task writes its
    rows sorted so row-group statistics prune on (sort keys, time)."""
    out = df.withColumn(date_col, F.to_date(F.col(ts)))
    out = out.sortWithinPartitions(date_col, *sort, ts)
    out.write.mode("append").partitionBy(date_col).parquet(path)


def append_gpu_metrics(metrics: DataFrame, path: str) -> None:
    """K1: append gpu_metrics (the process lists are not stored)."""
    cols = [c for c in metrics.columns if c != "processes"]
    append_partitioned(metrics.select(*cols), path, sort=("gpu_id",))


def append_process_events(events: DataFrame, path: str) -> None:
    """K3: append process_events, keeping the sample's event time."""
    append_partitioned(events, path, sort=("category",))


def merge_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """K2 as a DataFrame merge, keyed by ``id``.

    On conflict end_time, completion_tokens, total_tokens, tokens_per_second,
    time_to_first_token_ms and time_per_output_token_ms take the latest
    version; start_time, model and prompt_tokens keep the first.  Versions:
    existing rows first, then incoming rows by end time.  A grouped aggregate
    (partial + final), so repeated emissions of one id combine map-side.
    """
    cols = LLM_SESSIONS.fieldNames()
    ver_existing = F.struct(F.lit(0).alias("v"), F.col("end_time").alias("e"))
    ver_incoming = F.struct(F.lit(1).alias("v"), F.col("end_time").alias("e"))
    both = (existing.select(*cols, ver_existing.alias("_ver"))
            .unionByName(incoming.select(*cols, ver_incoming.alias("_ver"))))
    kept = ["start_time", "model", "prompt_tokens"]
    replaced = ["end_time", "completion_tokens", "total_tokens", "tokens_per_second",
                "time_to_first_token_ms", "time_per_output_token_ms"]
    merged = both.groupBy("id").agg(
        F.min_by(F.struct(*kept), "_ver").alias("_k"),
        F.max_by(F.struct(*replaced), "_ver").alias("_r"),
    )
    return merged.select("id", *[F.col(f"_k.{c}").alias(c) for c in kept],
                         *[F.col(f"_r.{c}").alias(c) for c in replaced]).select(*cols)


def sessions_table(spark: SparkSession, path: str) -> KeyedTable:
    """K2's table: one row an ``id``, by the day of its start."""
    return KeyedTable(spark, path, LLM_SESSIONS, ["id"], "start_time", kept=("start_time", "model", "prompt_tokens"), order="end_time")


def read_sessions(spark: SparkSession, path: str, days=None) -> DataFrame:
    """The stored sessions (``days``: only those started on these dates), with ``start_date``."""
    return sessions_table(spark, path).read(days, "start_date")


def upsert_sessions(spark: SparkSession, incoming: DataFrame, path: str, writer: str = "upsert", batch: int | None = None) -> None:
    """K2: add versions of sessions.  Of all versions of an id end_time, completion_tokens, total_tokens,
    tokens_per_second, time_to_first_token_ms and time_per_output_token_ms come from the last write (in
    it, from the latest end), start_time, model and prompt_tokens from the first."""
    config.prepare(spark)
    sessions_table(spark, path).append(incoming, writer, batch)


def replace_sessions(spark: SparkSession, incoming: DataFrame, path: str, writer: str = "reconcile") -> None:
    """Stored versions of the incoming ids, under whatever day, give way to the latest incoming one.

    Unlike an upsert this also replaces start, model and prompt count: ``incoming`` was computed from
    all chunks.
    """
    config.prepare(spark)
    latest = merge_sessions(spark.createDataFrame([], LLM_SESSIONS), incoming)
    sessions_table(spark, path).append(latest, writer, replaces=True)


def fold_sessions(spark: SparkSession, path: str, anywhere: bool = False) -> int:
    """Merge what was upserted into the stored days (upkeep); ``anywhere`` also finds versions under another day."""
    config.prepare(spark)
    return sessions_table(spark, path).fold(anywhere)


def merge_weekly(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """K4 as a DataFrame merge: incoming rows replace stored rows with the same
    (week_start, category); other stored rows stay."""
    cols = WEEKLY_SUMMARIES.fieldNames()
    keep = existing.join(incoming.select("week_start", "category"), ["week_start", "category"], "left_anti")
    return keep.select(*cols).unionByName(incoming.select(*cols))


def weekly_table(spark: SparkSession, path: str) -> KeyedTable:
    """K4's table: one row a (week_start, category), by its week."""
    return KeyedTable(spark, path, WEEKLY_SUMMARIES, ["week_start", "category"], "week_start")


def read_weekly(spark: SparkSession, path: str) -> DataFrame:
    return weekly_table(spark, path).read()


def upsert_weekly_summaries(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """K4: rows replace stored rows of the same (week_start, category)."""
    config.prepare(spark)
    table = weekly_table(spark, path)
    table.append(incoming, "upsert")
    table.fold()
