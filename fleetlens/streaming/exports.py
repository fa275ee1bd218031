"""Periodic export (R5) that late rows correct: keyed, replayable tables of export periods.

The streaming aggregates of ``ingest`` answer once, when the watermark passes a period, and miss what
comes later.  Here every micro-batch adds its own part of each period to a ``KeyedTable``: the part is
the batch operator over the rows of the micro-batch, and parts of one period combine when read (the
value of the latest time, or sums).  There is no state and no watermark, so a row counts however late it
is; a replayed micro-batch is not added twice; readers see a period as of the micro-batches done, and
``fold`` (upkeep) merges the parts into the base.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from fleetlens import config
from fleetlens.functions.gpu import MIB
from fleetlens.operators import rollups as R
from fleetlens.schemas import GPU_METRICS
from fleetlens.sinks.versions import KeyedTable

_PERIOD = [StructField("window_start", TimestampType()), StructField("window_end", TimestampType())]
_AT = StructType([StructField("ts", TimestampType()), StructField("id", LongType())])
GAUGE_PARTS = StructType([*_PERIOD, StructField("host", StringType()), StructField("gpu_id", IntegerType()), StructField("name", StringType()),
                          *[f for f in GPU_METRICS if f.name in R.GPU_GAUGE_NAMES], StructField("at", _AT)])
TICK_PARTS = StructType([StructField("timestamp", TimestampType()), StructField("host", StringType()), StructField("category", StringType()),
                         StructField("process_count", LongType()), StructField("memory_bytes", LongType())])
COUNTER_PARTS = StructType([*_PERIOD, StructField("model", StringType()), StructField("total_tokens", LongType()), StructField("sessions", LongType())])
HISTOGRAM_PARTS = StructType([_PERIOD[0], StructField("model", StringType()), StructField("le", StringType()), StructField("bucket_count", LongType()),
                              StructField("sample_sum", DoubleType()), StructField("sample_count", LongType())])


def _with_host(df: DataFrame) -> DataFrame:
    return df if "host" in df.columns else df.withColumn("host", F.lit(None).cast("string"))


def start_export(rows: DataFrame, table: KeyedTable, part: Callable[[DataFrame], DataFrame], checkpoint_location: str,
                 trigger_seconds: int = 10, available_now: bool = False, name: str = "export"):
    """Add ``part`` of every micro-batch of the stream ``rows`` to ``table``."""
    config.prepare(rows.sparkSession)
    writer = (rows.writeStream.option("checkpointLocation", checkpoint_location)
              .foreachBatch(lambda df, batch_id: table.append(part(df), name, batch_id)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()


class GaugeExport:
    """Last GPU gauges per export period and (host, gpu_id, name), as ``rollups.export_windows``."""

    def __init__(self, spark: SparkSession, path: str, every: str = "10 seconds"):
        self.every = every
        self.table = KeyedTable(spark, path, GAUGE_PARTS, ["window_start", "window_end", "host", "gpu_id", "name"], "window_start",
                                order="at", by_order=True)

    def part(self, metrics: DataFrame) -> DataFrame:
        values = list(R.GPU_GAUGE_NAMES)
        at = F.struct(F.col("timestamp").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
        rows = _with_host(metrics).withColumn("at", at)
        return (rows.groupBy(F.window(F.col("at.ts"), self.every).alias("w"), "host", "gpu_id", "name")
                .agg(F.max_by(F.struct(*values), "at").alias("v"), F.max("at").alias("at"))
                .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "host", "gpu_id", "name", "v.*", "at"))

    def read(self) -> DataFrame:
        return self.table.read().drop("at")


class ProcessExport:
    """Process count and memory of the last tick with a category per period and host, as
    ``rollups.export_process_gauges``; ticks are told apart to the microsecond, and a tick may come in pieces."""

    def __init__(self, spark: SparkSession, path: str, every: str = "10 seconds"):
        self.every = every
        self.table = KeyedTable(spark, path, TICK_PARTS, ["timestamp", "host", "category"], "timestamp", summed=("process_count", "memory_bytes"))

    def part(self, events: DataFrame) -> DataFrame:
        return (_with_host(events).groupBy(F.col("timestamp").cast("timestamp").alias("timestamp"), "host", "category")
                .agg(F.count("*").alias("process_count"), F.sum(F.col("gpu_memory_mb") * F.lit(MIB)).cast("long").alias("memory_bytes")))

    def read(self) -> DataFrame:
        return (self.table.read().groupBy(F.window("timestamp", self.every).alias("w"), "host", "category")
                .agg(F.max_by("process_count", "timestamp").alias("process_count"), F.max_by("memory_bytes", "timestamp").alias("memory_bytes"))
                .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "host", "category", "process_count", "memory_bytes"))


class CounterExport:
    """Tokens and sessions per model and period of the session end, as ``rollups.export_counters``."""

    def __init__(self, spark: SparkSession, path: str, every: str = "10 seconds"):
        self.every = every
        self.table = KeyedTable(spark, path, COUNTER_PARTS, ["window_start", "window_end", "model"], "window_start", summed=("total_tokens", "sessions"))

    def part(self, sessions: DataFrame) -> DataFrame:
        ended = sessions.where(F.col("end_time").isNotNull())
        return (ended.groupBy(F.window(F.col("end_time").cast("timestamp"), self.every).alias("w"), "model")
                .agg(F.sum("total_tokens").cast("long").alias("total_tokens"), F.count("*").alias("sessions"))
                .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "model", "total_tokens", "sessions"))

    def read(self) -> DataFrame:
        return self.table.read()


class HistogramExport:
    """Histogram deltas of ``value`` per model and period of the session end, as ``rollups.export_histogram``."""

    def __init__(self, spark: SparkSession, path: str, value: str, buckets: Sequence[float], every: str = "10 seconds"):
        self.value, self.buckets, self.every = value, buckets, every
        self.table = KeyedTable(spark, path, HISTOGRAM_PARTS, ["window_start", "model", "le"], "window_start",
                                summed=("bucket_count", "sample_sum", "sample_count"))

    def part(self, sessions: DataFrame) -> DataFrame:
        return R.export_histogram(sessions, self.value, self.buckets, self.every)

    def read(self) -> DataFrame:
        return self.table.read()
