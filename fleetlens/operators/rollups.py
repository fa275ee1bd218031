"""Roll-ups of process events and sessions (A1, A3–A7) and the long-form metric
snapshot (A14).

All are grouped aggregates with partial aggregation; the only per-group
"latest" choice is ``max_by``.  Histograms are computed in one pass with one
``count_if`` per bucket bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.gpu import MIB
from fleetlens.operators.metrics import last_by
from fleetlens.operators.pruning import time_filter
from fleetlens.schemas import WORKLOAD_CATEGORIES


def week_start(ts) -> F.Column:
    """Monday of the (UTC) week of a timestamp, as a DATE."""
    return F.to_date(F.date_trunc("week", F.col(ts) if isinstance(ts, str) else ts))


def weekly_summary(events: DataFrame, week: str | None = None,
                   categories: Sequence[str] = WORKLOAD_CATEGORIES) -> DataFrame:
    """A1: per (week, category) event count, mean / max utilisation, summed memory
    and duration.  All weeks at once (one hash aggregate), or only the week
    starting on ``week`` (a Monday, ``YYYY-MM-DD``) with a sargable time filter.
    Weeks without events of a category give no row."""
    df = events.where(F.col("category").isin(list(categories)))
    if week is not None:
        import datetime as _dt
        start = _dt.datetime.fromisoformat(f"{week}T00:00:00+00:00")
        if start.weekday():
            raise ValueError(f"Invalid week: {week} is not a Monday")
        df = time_filter(df, "timestamp", start, start + _dt.timedelta(days=7), end_inclusive=False)
    return (df.groupBy(week_start("timestamp").alias("week_start"), "category")
            .agg(F.sum("duration_secs").cast("long").alias("total_duration_secs"),
                 F.avg("gpu_utilization").alias("avg_gpu_utilization"),
                 F.max("gpu_utilization").alias("max_gpu_utilization"),
                 F.sum("gpu_memory_mb").cast("long").alias("total_gpu_memory_mb"),
                 F.count(F.lit(1)).alias("event_count"))
            .select("week_start", F.date_add("week_start", 7).alias("week_end"), "category",
                    "total_duration_secs", "avg_gpu_utilization", "max_gpu_utilization",
                    "total_gpu_memory_mb", "event_count"))


def weekly_parts(events: DataFrame, by: Sequence[str] = (), categories: Sequence[str] = WORKLOAD_CATEGORIES) -> DataFrame:
    """A1's state per (*by, week, category), which ``weekly_from_parts`` adds up: the parts of disjoint
    sets of events give the summary of all of them."""
    df = events.where(F.col("category").isin(list(categories)))
    return df.groupBy(*by, week_start("timestamp").alias("week_start"), "category").agg(
        F.count("*").alias("events"), F.sum("gpu_utilization").cast("long").alias("utilization"), F.count("gpu_utilization").alias("measured"),
        F.max("gpu_utilization").cast("long").alias("peak"), F.sum("gpu_memory_mb").cast("long").alias("memory_mb"),
        F.sum("duration_secs").cast("long").alias("duration_secs"))


def weekly_from_parts(parts: DataFrame) -> DataFrame:
    """A1 (``weekly_summary``) from its parts."""
    total = lambda c: F.sum(c).cast("long")
    return (parts.groupBy("week_start", "category")
            .agg(total("duration_secs").alias("total_duration_secs"), (F.sum("utilization") / F.nullif(F.sum("measured"), F.lit(0))).alias("avg_gpu_utilization"),
                 F.max("peak").alias("max_gpu_utilization"), total("memory_mb").alias("total_gpu_memory_mb"), total("events").alias("event_count"))
            .select("week_start", F.date_add("week_start", 7).alias("week_end"), "category", "total_duration_secs", "avg_gpu_utilization",
                    "max_gpu_utilization", "total_gpu_memory_mb", "event_count"))


def category_gauges(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A3: process count and memory bytes per category and tick; the gauge keeps
    the value of the last tick in which the category occurred (no reset to 0)."""
    per_tick = (events.groupBy(*keys, "timestamp", "category")
                .agg(F.count(F.lit(1)).alias("process_count"),
                     F.sum(F.col("gpu_memory_mb") * F.lit(MIB)).cast("long").alias("memory_bytes")))
    return per_tick.groupBy(*keys, "category").agg(
        F.max("timestamp").alias("tick"), F.max_by("process_count", "timestamp").alias("process_count"),
        F.max_by("memory_bytes", "timestamp").alias("memory_bytes"))


def process_memory(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A4: last memory (bytes) per (category, process name, pid); the larger of two in one tick."""
    per_tick = events.groupBy(*keys, "category", F.col("name").alias("process_name"), "pid", "timestamp").agg(
        F.max((F.col("gpu_memory_mb") * F.lit(MIB)).cast("long")).alias("memory_bytes"))
    return per_tick.groupBy(*keys, "category", "process_name", "pid").agg(
        F.max("timestamp").alias("tick"), F.max_by("memory_bytes", "timestamp").alias("memory_bytes"))


# Histogram bucket upper bounds.
TPS_BUCKETS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
TTFT_BUCKETS_MS = (10.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)


def _le_label(b: float) -> str:
    return str(int(b)) if float(b).is_integer() else repr(b)


def histogram(df: DataFrame, value: str, buckets: Sequence[float], by: Sequence[str] = ("model",)) -> DataFrame:
    """A5: cumulative ``le`` buckets (inclusive, plus ``+Inf``), sum and count per
    group, in long form (one row per bound).  Null values are not observed."""
    v = F.col(value).cast("double")
    obs = df.where(v.isNotNull())
    aggs = [F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(v).alias("sample_count"), F.sum(v).alias("sample_sum")]
    wide = obs.groupBy(*by).agg(*aggs)
    labels = [(_le_label(b), F.col(f"_b{i}")) for i, b in enumerate(buckets)] + [("+Inf", F.col("sample_count"))]
    return wide.select(*by, "sample_sum", "sample_count", F.explode(F.array(*[
        F.struct(F.lit(lbl).alias("le"), c.cast("long").alias("bucket_count")) for lbl, c in labels
    ])).alias("_h")).select(*by, "_h.le", "_h.bucket_count", "sample_sum", "sample_count")


def tps_histogram(sessions: DataFrame) -> DataFrame:
    """A5: tokens-per-second histogram per model."""
    return histogram(sessions, "tokens_per_second", TPS_BUCKETS)


def ttft_histogram(sessions: DataFrame) -> DataFrame:
    """A5: time-to-first-token histogram per model (null ttft not observed)."""
    return histogram(sessions, "time_to_first_token_ms", TTFT_BUCKETS_MS)


def model_counters(sessions: DataFrame) -> DataFrame:
    """A6 + A7: session count and total tokens per model."""
    return sessions.groupBy("model").agg(F.count(F.lit(1)).alias("session_count"),
                                         F.sum("total_tokens").cast("long").alias("total_tokens"))


# Exported metric names (scrape naming) and label keys.
GPU_GAUGE_NAMES = {
    "utilization_gpu": "gpm_gpu_utilization_percent",
    "memory_used": "gpm_gpu_memory_used_bytes",
    "memory_total": "gpm_gpu_memory_total_bytes",
    "temperature": "gpm_gpu_temperature_celsius",
    "power_usage": "gpm_gpu_power_watts",
}
TPS_HISTOGRAM_NAME = "gpm_llm_tokens_per_second"
TTFT_HISTOGRAM_NAME = "gpm_llm_time_to_first_token_ms"
SESSION_COUNT_NAME = "gpm_llm_session_count"
PROCESS_COUNT_NAME = "gpm_process_count"
PROCESS_MEMORY_NAME = "gpm_process_gpu_memory_bytes"
# Series only the push exporter has.
TOTAL_TOKENS_NAME = "llm.tokens.total"
PROCESS_MEMORY_BY_PID_NAME = "process.gpu_memory.bytes"


def _labels(*pairs) -> str:
    """SQL of a label map with keys in sorted order (so its JSON text is canonical).
    Each pair is (key, SQL expression of the value)."""
    items = sorted(pairs, key=lambda kv: kv[0])
    return "map(" + ", ".join(f"'{k}', CAST({v} AS STRING)" for k, v in items) + ")"


def _model_rollup(sessions: DataFrame, tps_bounds: Sequence[float] = TPS_BUCKETS,
                  ttft_bounds: Sequence[float] = TTFT_BUCKETS_MS) -> DataFrame:
    """Everything A5-A7 need per model in one aggregate (one pass over sessions)."""
    tps, ttft = "CAST(tokens_per_second AS DOUBLE)", "CAST(time_to_first_token_ms AS DOUBLE)"
    aggs = ["count(1) AS session_count", "CAST(sum(total_tokens) AS BIGINT) AS total_tokens",
            f"count({tps}) AS tps_count", f"sum({tps}) AS tps_sum",
            f"count({ttft}) AS ttft_count", f"sum({ttft}) AS ttft_sum"]
    aggs += [f"count_if({tps} <= {float(b)}D) AS tps_b{i}" for i, b in enumerate(tps_bounds)]
    aggs += [f"count_if({ttft} <= {float(b)}D) AS ttft_b{i}" for i, b in enumerate(ttft_bounds)]
    return sessions.groupBy("model").agg(*[F.expr(a) for a in aggs])


def _rows(df: DataFrame, entries) -> DataFrame:
    """Unpivot one wide row per group into (metric, labels, value) rows, as one
    SQL expression.  Entries are (metric, labels SQL, value SQL[, condition SQL
    for the series to exist])."""
    structs = []
    for e in entries:
        m, lbl, v = e[:3]
        keep = e[3] if len(e) > 3 else "true"
        structs.append(f"named_struct('metric', '{m}', 'labels', {lbl}, 'value', CAST({v} AS DOUBLE), "
                       f"'keep', {keep})")
    return (df.select(F.expr(f"explode(array({', '.join(structs)}))").alias("_s"))
            .where("_s.keep").select("_s.metric", "_s.labels", "_s.value"))


# The push exporter's instrument names, and the default histogram bounds of its SDK.
PUSH_GAUGE_NAMES = {
    "utilization_gpu": "gpu.utilization.percent",
    "memory_used": "gpu.memory.used.bytes",
    "temperature": "gpu.temperature.celsius",
    "power_usage": "gpu.power.watts",
}
PUSH_TPS_NAME = "llm.tokens_per_second"
PUSH_TTFT_NAME = "llm.time_to_first_token.ms"
PUSH_PROCESS_COUNT_NAME = "process.count"
PUSH_BUCKETS = (0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)


def _union(parts: list[DataFrame], constant_labels: dict[str, str] | None) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if constant_labels:
        const = F.create_map(*[x for k in sorted(constant_labels) for x in (F.lit(k), F.lit(str(constant_labels[k])))])
        out = out.withColumn("labels", F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.col("labels"), const)))))
    return out


def push_snapshot(gauges: DataFrame, sessions: DataFrame, events: DataFrame, keys: Sequence[str] = (),
                  constant_labels: dict[str, str] | None = None) -> DataFrame:
    """A14 under the push exporter's names: its GPU gauges, the two histograms and the token counter per
    model, and per category the process count and memory, besides the memory per process.  ``keys``
    (e.g. host) become labels of the GPU and process series."""
    own = [(k, f"`{k}`") for k in keys]
    gl = _labels(("gpu_id", "`gpu_id`"), ("gpu_name", "`name`"), *own)
    parts = [_rows(gauges, [(name, gl, f"`{col}`") for col, name in PUSH_GAUGE_NAMES.items()])]
    ml = _labels(("model", "`model`"))
    entries = [(TOTAL_TOKENS_NAME, ml, "total_tokens")]
    for base, pre in ((PUSH_TPS_NAME, "tps"), (PUSH_TTFT_NAME, "ttft")):
        observed = f"{pre}_count > 0"
        les = [(_le_label(b), f"{pre}_b{i}") for i, b in enumerate(PUSH_BUCKETS)] + [("+Inf", f"{pre}_count")]
        entries += [(f"{base}_bucket", _labels(("le", f"'{le}'"), ("model", "`model`")), c, observed) for le, c in les]
        entries += [(f"{base}_sum", ml, f"{pre}_sum", observed), (f"{base}_count", ml, f"{pre}_count", observed)]
    parts.append(_rows(_model_rollup(sessions, PUSH_BUCKETS, PUSH_BUCKETS), entries))
    cl = _labels(("category", "`category`"), *own)
    parts.append(_rows(category_gauges(events, keys), [(PUSH_PROCESS_COUNT_NAME, cl, "process_count"),
                                                       (PROCESS_MEMORY_BY_PID_NAME, cl, "memory_bytes")]))
    pl = _labels(("category", "`category`"), ("pid", "`pid`"), ("process_name", "`process_name`"), *own)
    parts.append(_rows(process_memory(events, keys), [(PROCESS_MEMORY_BY_PID_NAME, pl, "memory_bytes")]))
    return _union(parts, constant_labels)


def metric_snapshot(gauges: DataFrame, sessions: DataFrame, events: DataFrame,
                    constant_labels: dict[str, str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Every gauge, counter and histogram series as (metric, labels, value).

    ``gauges`` is the output of ``operators.metrics.gpu_gauges`` (A2); sessions
    feed A5-A7 through one per-model aggregate, process events A3-A4.  The
    result is a union of small grouped results.  A model's histogram series
    exist only when it has an observation (as for the standalone histograms).
    ``constant_labels`` (e.g. service name, version) join every series' labels,
    ``keys`` (e.g. host) those of the GPU and process series; keys stay sorted.
    """
    own = [(k, f"`{k}`") for k in keys]
    gl = _labels(("gpu_id", "`gpu_id`"), ("gpu_name", "`name`"), *own)
    parts = [_rows(gauges, [(name, gl, f"`{col}`") for col, name in GPU_GAUGE_NAMES.items()])]
    # Every per-model series comes from one projection of one aggregate: one pass over sessions.
    mr = _model_rollup(sessions)
    ml = _labels(("model", "`model`"))
    entries = [(SESSION_COUNT_NAME, ml, "session_count"), (TOTAL_TOKENS_NAME, ml, "total_tokens")]
    for base, pre, buckets in ((TPS_HISTOGRAM_NAME, "tps", TPS_BUCKETS), (TTFT_HISTOGRAM_NAME, "ttft", TTFT_BUCKETS_MS)):
        observed = f"{pre}_count > 0"
        les = [(_le_label(b), f"{pre}_b{i}") for i, b in enumerate(buckets)] + [("+Inf", f"{pre}_count")]
        entries += [(f"{base}_bucket", _labels(("le", f"'{le}'"), ("model", "`model`")), c, observed) for le, c in les]
        entries += [(f"{base}_sum", ml, f"{pre}_sum", observed), (f"{base}_count", ml, f"{pre}_count", observed)]
    parts.append(_rows(mr, entries))
    cg = category_gauges(events, keys)
    cl = _labels(("category", "`category`"), *own)
    parts.append(_rows(cg, [(PROCESS_COUNT_NAME, cl, "process_count"), (PROCESS_MEMORY_NAME, cl, "memory_bytes")]))
    pm = process_memory(events, keys)
    parts.append(_rows(pm, [(PROCESS_MEMORY_BY_PID_NAME,
                             _labels(("category", "`category`"), ("pid", "`pid`"), ("process_name", "`process_name`"), *own),
                             "memory_bytes")]))
    return _union(parts, constant_labels)


def export_windows(metrics: DataFrame, every: str = "10 seconds", ts: str = "timestamp",
                   tiebreak: Sequence[str] = ("id",), keys: Sequence[str] = ()) -> DataFrame:
    """R5 (batch form): per export period and (gpu_id, name), the last value of
    each GPU gauge within the period.  The streaming form adds a watermark."""
    cols = list(GPU_GAUGE_NAMES)
    rows = metrics.withColumn("window_start", F.window(ts, every).start)
    last = last_by(rows, ["window_start", *keys, "gpu_id", "name"], cols, ts, tiebreak)
    return last.select("window_start", (F.col("window_start") + F.expr(f"INTERVAL {every}")).alias("window_end"),
                       *keys, "gpu_id", "name", *cols)


def export_counters(sessions: DataFrame, every: str = "10 seconds") -> DataFrame:
    """R5 counters (delta form): tokens per model summed per export period of the session end."""
    return (sessions.where(F.col("end_time").isNotNull())
            .groupBy(F.window("end_time", every).alias("w"), "model")
            .agg(F.sum("total_tokens").cast("long").alias("total_tokens"), F.count(F.lit(1)).alias("sessions"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "model", "total_tokens", "sessions"))


def export_process_gauges(events: DataFrame, every: str = "10 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """R5 process gauges: per export period and category, the process count and
    memory bytes of the last tick in the period in which the category occurred."""
    per_tick = (events.groupBy(*keys, "timestamp", "category")
                .agg(F.count(F.lit(1)).alias("process_count"),
                     F.sum(F.col("gpu_memory_mb") * F.lit(MIB)).cast("long").alias("memory_bytes")))
    return (per_tick.groupBy(F.window("timestamp", every).alias("w"), *keys, "category")
            .agg(F.max_by("process_count", "timestamp").alias("process_count"), F.max_by("memory_bytes", "timestamp").alias("memory_bytes"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "category",
                    "process_count", "memory_bytes"))


def export_histogram(sessions: DataFrame, value: str, buckets: Sequence[float],
                     every: str = "10 seconds") -> DataFrame:
    """R5 histogram deltas: the histogram of ``value`` over the sessions that
    ended in each export period, per model (cumulative ``le`` buckets, sum, count)."""
    ended = sessions.where(F.col("end_time").isNotNull()).withColumn(
        "window_start", F.window("end_time", every).start)
    return histogram(ended, value, buckets, by=("window_start", "model"))


def export_tps_histogram(sessions: DataFrame, every: str = "10 seconds") -> DataFrame:
    """Tokens-per-second histogram deltas per export period and model."""
    return export_histogram(sessions, "tokens_per_second", TPS_BUCKETS, every)


def export_ttft_histogram(sessions: DataFrame, every: str = "10 seconds") -> DataFrame:
    """Time-to-first-token histogram deltas per export period and model (null ttft not observed)."""
    return export_histogram(sessions, "time_to_first_token_ms", TTFT_BUCKETS_MS, every)
