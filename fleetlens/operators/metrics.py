"""Operators over ``gpu_metrics``: range scans, latest state, series statistics,
chart series, alerts and counts (T1, T3, P4, W3, A2, A8, A9, A12, A13).

Everything per device is a grouped aggregate (partial + final), never a window
over a whole device: ``max_by`` gives the latest value, min/max/avg the stats.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.display import rfc3339
from fleetlens.operators.pruning import time_filter
from fleetlens.functions.gpu import memory_percent, memory_view
from fleetlens.operators.series import DEFAULT_BLOCK_ROWS, DEFAULT_BLOCK_SECONDS, downsample, ordered_index

# The four charted metrics (the memory chart plots utilization_memory).
CHART_METRICS = ("utilization_gpu", "utilization_memory", "temperature", "power_usage")
GAUGE_METRICS = ("utilization_gpu", "memory_used", "memory_total", "temperature", "power_usage")


_FIXED_WIDTH = {"byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "decimal"}
_WHOLE = {"byte", "short", "integer", "long"}


def order_key(df: DataFrame, ts: str = "timestamp", tiebreak: Sequence[str] = ("id",)) -> Column:
    """The order (ts, tie-break) as one fixed-width value, so that aggregates by it are hash aggregates:
    microseconds and a whole-number tie-break packed into a DECIMAL(38,0).  Other tie-breaks give a struct.
    Missing parts come first."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    if not tiebreak:
        return micros
    if len(tiebreak) > 1 or types.get(tiebreak[0]) not in _WHOLE:
        return F.struct(F.col(ts), *[F.col(t) for t in tiebreak])
    low = F.coalesce(F.col(tiebreak[0]).cast("long"), F.lit(-(1 << 63)))
    return (micros.cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def last_by(df: DataFrame, keys: Sequence, columns: Sequence[str], ts: str = "timestamp",
            tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """The ``columns`` of the newest row of every key group.

    Fixed-width columns are ``max_by`` aggregates over a packed order, which hash.  Text and other
    variable-width columns would make Spark sort all rows; for these the newest order per key is found
    by a hash aggregate and joined back, and only the matching rows (one, but for repeated rows) are
    aggregated again.
    """
    keys, columns = list(keys), list(columns)
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    rows = df.withColumn("_fl_o", order_key(df, ts, tiebreak))
    if all(types[c] in _FIXED_WIDTH for c in columns):
        return rows.groupBy(*keys).agg(*[F.max_by(c, "_fl_o").alias(c) for c in columns])
    newest = rows.groupBy(*keys).agg(F.max("_fl_o").alias("_fl_m")).select(*[F.col(k).alias(f"_fl_{i}") for i, k in enumerate(keys)], "_fl_m")
    same = F.col("_fl_o") == F.col("_fl_m")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_fl_{i}"))
    top = rows.join(newest, same).groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_fl_r"))
    return top.select(*keys, *[F.col(f"_fl_r.{c}").alias(c) for c in columns])


def time_range(df: DataFrame, start=None, end=None, ts: str = "timestamp",
               end_inclusive: bool = True) -> DataFrame:
    """Rows with start <= ts (<=|<) end; bounds are validated instants (P10).
    Pushed to the scan, with partition pruning on tables written by the sinks."""
    return time_filter(df, ts, start, end, end_inclusive)


def recent_metrics(df: DataFrame, hours: float, now, ts: str = "timestamp",
                   order: bool = True) -> DataFrame:
    """Rows with ``timestamp >= now - hours``, ascending by time.

    ``now`` is an argument so results repeat.  The bound is a literal, so the
    filter reaches the Parquet scan (row-group pruning), and on a date-partitioned
    table only the partitions from the cutoff's day on are listed.
    """
    cutoff = _as_utc(now) - _dt.timedelta(hours=hours)
    out = time_filter(df, ts, start=cutoff)
    return out.orderBy(F.col(ts), F.col("id")) if order else out


def _as_utc(now) -> _dt.datetime:
    from fleetlens.functions.display import as_instant
    return as_instant(now, "now")


def latest_metrics(df: DataFrame, n: int = 10, ts: str = "timestamp") -> DataFrame:
    """The newest n rows (top-k: TakeOrderedAndProject, no global sort)."""
    return df.orderBy(F.col(ts).desc(), F.col("id").desc()).limit(n)


def latest_per_gpu(df: DataFrame, keys: Sequence[str] = ("gpu_id",), gpu_id: int | None = None,
                   ts: str = "timestamp", tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """The newest row of every device (or of one), with the memory view."""
    if gpu_id is not None:
        df = df.where(F.col("gpu_id") == F.lit(gpu_id))
    others = [c for c in df.columns if c not in keys]
    return memory_view(last_by(df, keys, others, ts, tiebreak).select(*keys, *others))


def gpu_gauges(df: DataFrame, ts: str = "timestamp", tiebreak: Sequence[str] = ("id",),
               keys: Sequence[str] = ()) -> DataFrame:
    """A2: last value per (*keys, gpu_id, name) of utilisation, memory used/total, temperature, power.
    ``keys``: e.g. ("host",), as gpu_id is unique only within a host."""
    return last_by(df, [*keys, "gpu_id", "name"], GAUGE_METRICS, ts, tiebreak)


def series_stats(df: DataFrame, metrics: Sequence[str] = CHART_METRICS, keys: Sequence[str] = ("gpu_id",),
                 ts: str = "timestamp", tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """Min, max, mean and current (last) value per (device, metric) over the full series.

    Aggregated wide (one pass, partial aggregation), unpivoted afterwards on the
    small result.  ``memory_percent`` may be named as a metric; it is derived.
    """
    keys = list(keys)
    if "memory_percent" in metrics and "memory_percent" not in df.columns:
        df = df.withColumn("memory_percent", memory_percent())
    df = df.withColumn("_fl_o", order_key(df, ts, tiebreak))
    aggs = []
    for m in metrics:
        v = F.col(m).cast("double")
        aggs += [F.min(v).alias(f"{m}__min"), F.max(v).alias(f"{m}__max"), F.avg(v).alias(f"{m}__avg"),
                 F.max_by(v, F.col("_fl_o")).alias(f"{m}__cur"), F.count(v).alias(f"{m}__n")]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}__n").alias("n"), F.col(f"{m}__min").alias("min_value"),
                 F.col(f"{m}__max").alias("max_value"), F.col(f"{m}__avg").alias("avg_value"),
                 F.col(f"{m}__cur").alias("current_value"))
        for m in metrics])).alias("_s")).select(*keys, "_s.*")


def chart_series(df: DataFrame, keys: Sequence[str] = ("gpu_id",), ts: str = "timestamp",
                 tiebreak: Sequence[str] = ("id",), block_seconds: int = DEFAULT_BLOCK_SECONDS,
                 block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """A8, long form: one row per point with its 0-based position, the RFC 3339
    label and the five charted values.  Scales with no per-device array."""
    ix = ordered_index(memory_view(df), keys, ts, tiebreak, block_seconds, block_rows=block_rows)
    return ix.select(*keys, F.col("idx"), rfc3339(ts).alias("label"), "utilization_gpu",
                     "utilization_memory", "memory_percent", "temperature", "power_usage")


def chart_arrays(df: DataFrame, max_points: int, keys: Sequence[str] = ("gpu_id",), ts: str = "timestamp",
                 tiebreak: Sequence[str] = ("id",), block_seconds: int = DEFAULT_BLOCK_SECONDS,
                 block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """A8 with W1, array form: per device, parallel arrays of the downsampled
    series.  Each array holds at most ``max_points`` elements, so the per-group
    collection is bounded by construction."""
    keys = list(keys)
    pts = downsample(memory_view(df), max_points, keys, ts, tiebreak, block_seconds, block_rows)
    fields = ["utilization_gpu", "utilization_memory", "memory_percent", "temperature", "power_usage"]
    arr = (pts.groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct(F.col("idx"), rfc3339(ts).alias("label"),
                                                     *[F.col(f) for f in fields]))).alias("_p")))
    def field(name):
        return lambda p: p[name]

    return arr.select(*keys, F.transform("_p", field("label")).alias("labels"),
                      *[F.transform("_p", field(f)).alias(f) for f in fields])


# Configured alert thresholds (defaults).
DEFAULT_TEMPERATURE_THRESHOLD = 85.0
DEFAULT_MEMORY_THRESHOLD = 90.0


def alerts(df: DataFrame, temperature_threshold: float = DEFAULT_TEMPERATURE_THRESHOLD,
           memory_threshold: float = DEFAULT_MEMORY_THRESHOLD) -> DataFrame:
    """One row per threshold breach (strictly above) of temperature or memory percent."""
    m = df.withColumn("memory_percent", memory_percent())
    hit_t = F.col("temperature") > temperature_threshold
    hit_m = F.col("memory_percent") > memory_threshold
    breaches = F.filter(F.array(
        F.when(hit_t, F.struct(F.lit("temperature").alias("metric"),
                               F.col("temperature").cast("double").alias("value"),
                               F.lit(float(temperature_threshold)).alias("threshold"))),
        F.when(hit_m, F.struct(F.lit("memory_percent").alias("metric"),
                               F.col("memory_percent").alias("value"),
                               F.lit(float(memory_threshold)).alias("threshold")))), lambda x: x.isNotNull())
    return (m.where(hit_t | hit_m)
            .select("id", "timestamp", "gpu_id", "name", F.explode(breaches).alias("_a"))
            .select("id", "timestamp", "gpu_id", "name", "_a.metric", "_a.value", "_a.threshold"))


def gpu_count(df: DataFrame, keys: Sequence[str] = ("gpu_id",), approximate: bool = False) -> DataFrame:
    """Number of devices (exact; ``approx_count_distinct`` on request at fleet scale)."""
    if approximate:
        return df.agg(F.approx_count_distinct(F.struct(*keys)).alias("gpu_count"))
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("gpu_count"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))
