"""Named queries over the fixture views, each with its DuckDB oracle.

Every query reads the driver's tables (through ``fleetlens.fixtures``), runs the
library operator on the whole of them, and returns a DataFrame whose column
names match the oracle SQL.  Timestamps are handed back as TIMESTAMP_NTZ (UTC
wall clock), the type DuckDB uses for the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config, fixtures
from fleetlens.functions import display
from fleetlens.functions import gpu as gpu_fn
from fleetlens.operators import metrics as M
from fleetlens.operators import series as S

# Fixed parameters of the driver queries.
NOW = "2024-01-31T00:00:00Z"          # the fixture month ends here
RANGE_HOURS = 720                     # 30 days back from NOW: the whole month
MAX_POINTS = S.max_points_for_range(RANGE_HOURS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _out(df: DataFrame) -> DataFrame:
    ltz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ltz}) if ltz else df


def register(name: str, sql: str | None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            config.prepare(spark)
            return _out(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def _round6(df: DataFrame, *cols: str) -> DataFrame:
    """Oracle hygiene: float aggregates whose summation order differs between engines."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _v(spark, sf_dir, name):
    return fixtures.view(spark, sf_dir, name)


def _union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


GM = fixtures.duckdb_cte("gpu_metrics")
MEMPCT_SQL = ("CASE WHEN memory_total > 0 THEN CAST(memory_used AS DOUBLE) / CAST(memory_total AS DOUBLE) * 100.0 "
              "ELSE 0.0 END")
MEMVIEW_SQL = (f"CAST(memory_used AS DOUBLE) / 1048576.0 AS memory_used_mb, "
               f"CAST(memory_total AS DOUBLE) / 1048576.0 AS memory_total_mb, {MEMPCT_SQL} AS memory_percent")
GM_COLS = ('id, "timestamp", gpu_id, name, utilization_gpu, utilization_memory, memory_used, memory_total, '
           'temperature, power_usage')


# ---------------------------------------------------------------- gpu_metrics
@register("recent_metrics", GM + f"""
SELECT {GM_COLS}, {MEMVIEW_SQL}
FROM gpu_metrics WHERE "timestamp" >= TIMESTAMP '2024-01-01 00:00:00'
ORDER BY "timestamp", id""")
def q_recent_metrics(spark, sf_dir):
    """T1 + P2: the last 720 hours before NOW (the whole month), ascending, with the memory view."""
    return gpu_fn.memory_view(M.recent_metrics(_v(spark, sf_dir, "gpu_metrics"), RANGE_HOURS, NOW))


def _stats_sql() -> str:
    parts = []
    for m in M.CHART_METRICS:
        v = f"CAST({m} AS DOUBLE)"
        parts.append(f"""SELECT gpu_id, '{m}' AS metric, count({m}) AS n, min({v}) AS min_value,
  max({v}) AS max_value, avg({v}) AS avg_value, arg_max({v}, ("timestamp", id)) AS current_value
FROM gpu_metrics GROUP BY gpu_id""")
    return GM + _union_all(parts)


@register("series_stats", _stats_sql())
def q_series_stats(spark, sf_dir):
    """Min / max / mean / current of the four charted metrics per GPU, full series."""
    return M.series_stats(_v(spark, sf_dir, "gpu_metrics"))


def _indexed_cte() -> str:
    return GM + """, ix AS (
  SELECT *, row_number() OVER (PARTITION BY gpu_id ORDER BY "timestamp", id) - 1 AS idx,
         count(*) OVER (PARTITION BY gpu_id) AS n
  FROM gpu_metrics)
"""


def _trend_sql() -> str:
    parts = []
    for m in M.CHART_METRICS:
        parts.append(f"""SELECT gpu_id, '{m}' AS metric, max(s) AS sample_size,
  avg(CASE WHEN idx >= n - s THEN {m} END) AS r,
  avg(CASE WHEN idx >= n - 2 * s AND idx < n - s THEN {m} END) AS p
FROM (SELECT *, greatest(5, CAST(floor(n * 0.1) AS BIGINT)) AS s FROM ix) GROUP BY gpu_id""")
    return _indexed_cte() + """, w AS (""" + _union_all(parts) + """),
c AS (SELECT gpu_id, metric, sample_size, r AS recent_avg, coalesce(p, r) AS previous_avg FROM w),
d AS (SELECT *, CASE WHEN previous_avg > 0 THEN (recent_avg - previous_avg) / previous_avg * 100.0 ELSE 0.0 END
          AS change_percent FROM c)
SELECT gpu_id, metric, sample_size, recent_avg, previous_avg, change_percent,
  CASE WHEN change_percent > 5.0 THEN 'up' WHEN change_percent < -5.0 THEN 'down' ELSE 'neutral' END AS trend
FROM d"""


@register("trend", _trend_sql())
def q_trend(spark, sf_dir):
    """Recent vs previous mean of the four charted metrics per GPU."""
    return S.trend(_v(spark, sf_dir, "gpu_metrics"), M.CHART_METRICS)


@register("downsample", _indexed_cte() + f"""
SELECT {GM_COLS}, idx, n FROM ix
WHERE n <= {MAX_POINTS} OR idx % greatest(1, CAST(ceil(n / {float(MAX_POINTS)}) AS BIGINT)) = 0""")
def q_downsample(spark, sf_dir):
    """Each GPU's series thinned to at most 400 points (30-day range)."""
    return S.downsample(_v(spark, sf_dir, "gpu_metrics"), MAX_POINTS)


@register("chart_series", _indexed_cte() + f"""
SELECT gpu_id, idx, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS label,
  utilization_gpu, utilization_memory, {MEMPCT_SQL} AS memory_percent, temperature, power_usage
FROM ix""")
def q_chart_series(spark, sf_dir):
    """A8 long form: every point of every GPU with its position and RFC 3339 label."""
    return M.chart_series(_v(spark, sf_dir, "gpu_metrics"))


@register("latest_per_gpu", GM + f"""
SELECT gpu_id, id, "timestamp", name, utilization_gpu, utilization_memory, memory_used, memory_total,
  temperature, power_usage, {MEMVIEW_SQL}
FROM (SELECT *, row_number() OVER (PARTITION BY gpu_id ORDER BY "timestamp" DESC, id DESC) AS rn FROM gpu_metrics)
WHERE rn = 1""")
def q_latest_per_gpu(spark, sf_dir):
    """Newest row of every GPU with its memory view."""
    return M.latest_per_gpu(_v(spark, sf_dir, "gpu_metrics"))


@register("gpu_gauges", GM + """
SELECT gpu_id, name, utilization_gpu, memory_used, memory_total, temperature, power_usage
FROM (SELECT *, row_number() OVER (PARTITION BY gpu_id, name ORDER BY "timestamp" DESC, id DESC) AS rn
      FROM gpu_metrics) WHERE rn = 1""")
def q_gpu_gauges(spark, sf_dir):
    """A2: last value of the five gauges per (gpu_id, name)."""
    return M.gpu_gauges(_v(spark, sf_dir, "gpu_metrics"))


@register("gpu_count", GM + "SELECT count(DISTINCT gpu_id) AS gpu_count FROM gpu_metrics")
def q_gpu_count(spark, sf_dir):
    """Number of GPUs."""
    return M.gpu_count(_v(spark, sf_dir, "gpu_metrics"))


@register("metric_count", GM + "SELECT count(*) AS row_count FROM gpu_metrics")
def q_metric_count(spark, sf_dir):
    """Number of metric rows."""
    return M.row_count(_v(spark, sf_dir, "gpu_metrics"))


def _sev(col, c, w):
    return f"CASE WHEN {col} > {c} THEN 'critical' WHEN {col} > {w} THEN 'warning' ELSE 'ok' END"


@register("severity", GM + f"""
SELECT id, gpu_id, temperature, utilization_gpu, memory_percent,
  {_sev('temperature', 85, 70)} AS temperature_level,
  {_sev('utilization_gpu', 95, 80)} AS utilization_gpu_level,
  {_sev('memory_percent', 90, 75)} AS memory_percent_level
FROM (SELECT *, {MEMPCT_SQL} AS memory_percent FROM gpu_metrics)""")
def q_severity(spark, sf_dir):
    """Colour class of temperature, utilisation and memory percent for every row."""
    df = _v(spark, sf_dir, "gpu_metrics").select(
        "id", "gpu_id", "temperature", "utilization_gpu", gpu_fn.memory_percent().alias("memory_percent"))
    return gpu_fn.severity_levels(df)


@register("alerts", GM + f"""
SELECT id, "timestamp", gpu_id, name, 'temperature' AS metric, CAST(temperature AS DOUBLE) AS value,
  85.0::DOUBLE AS threshold FROM gpu_metrics WHERE temperature > 85.0
UNION ALL
SELECT id, "timestamp", gpu_id, name, 'memory_percent' AS metric, mp AS value, 90.0::DOUBLE AS threshold
FROM (SELECT *, {MEMPCT_SQL} AS mp FROM gpu_metrics) WHERE mp > 90.0""")
def q_alerts(spark, sf_dir):
    """One row per breach of the temperature (85) or memory (90 %) threshold."""
    return M.alerts(_v(spark, sf_dir, "gpu_metrics"))


@register("gauge_fill", GM + f"""
SELECT id, gpu_id,
  least(CAST(utilization_gpu AS DOUBLE) / 100.0 * 100.0, 100.0) AS utilization_gpu_fill,
  least(memory_percent / 100.0 * 100.0, 100.0) AS memory_percent_fill,
  least(CAST(temperature AS DOUBLE) / 100.0 * 100.0, 100.0) AS temperature_fill,
  least(CAST(power_usage AS DOUBLE) / 350.0 * 100.0, 100.0) AS power_usage_fill
FROM (SELECT *, {MEMPCT_SQL} AS memory_percent FROM gpu_metrics)""")
def q_gauge_fill(spark, sf_dir):
    """P5: fill percentage of the four gauges for every row."""
    df = _v(spark, sf_dir, "gpu_metrics").select(
        "id", "gpu_id", "utilization_gpu", gpu_fn.memory_percent().alias("memory_percent"), "temperature",
        "power_usage")
    return gpu_fn.gauge_fills(df).select("id", "gpu_id", *[f"{m}_fill" for m in gpu_fn.GAUGE_MAX])


# ------------------------------------------------------------ processes
from fleetlens.functions import classify as C  # noqa: E402
from fleetlens.operators import processes as P  # noqa: E402
from fleetlens.operators import rollups as R  # noqa: E402

ROOTS = fixtures.FIXTURE_LIBRARY_ROOTS
PS = fixtures.duckdb_cte("process_samples", "os_processes")


def _any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"strpos({text}, '{w}') > 0" for w in words) + ")"


def _in_lib_sql(exe: str) -> str:
    p = f"regexp_replace(regexp_replace({exe}, '/{{2,}}', '/', 'g'), '(.)/$', '\\1')"
    tests = " OR ".join(f"({p} = '{r}' OR starts_with({p}, '{r}/'))" for r in ROOTS)
    return f"coalesce({tests}, false)"


def _category_sql(name: str, cmd: str, exe: str, util: str) -> str:
    n, c = f"lower(coalesce({name}, ''))", f"lower(coalesce({cmd}, ''))"
    game = (f"(({exe} IS NOT NULL AND ({_in_lib_sql(exe)} OR strpos(lower({exe}), 'game') > 0)) "
            f"OR (ends_with({n}, '.exe') AND coalesce({util}, 0) > 60))")
    return (f"CASE WHEN strpos({n}, 'ollama') > 0 THEN 'llm_inference' "
            f"WHEN {_any_sql(c, C.FRAMEWORK_WORDS)} THEN 'ml_training' "
            f"WHEN strpos({n}, 'python') > 0 AND {_any_sql(c, C.PYTHON_ML_KEYWORDS)} THEN "
            f"(CASE WHEN {_any_sql(c, C.INFERENCE_WORDS)} THEN 'llm_inference' ELSE 'ml_training' END) "
            f"WHEN {game} THEN 'gaming' ELSE 'general_compute' END")


@register("classify", PS + f"""
SELECT id, pid, {_category_sql('name', 'command_line', 'exe_path', 'gpu_utilization')} AS category
FROM process_samples""")
def q_classify(spark, sf_dir):
    """P1a-f + J3: workload category of every sampled process (library root /opt/lib/common)."""
    s = _v(spark, sf_dir, "process_samples")
    return C.classify(s, ROOTS).select("id", "pid", "category")


PE_SQL = PS + f""",
s AS (SELECT *, date_trunc('day', "timestamp") AS tick FROM process_samples),
u AS (SELECT tick, gpu_id, max(gpu_utilization) AS gpu_util FROM s GROUP BY tick, gpu_id),
w AS (SELECT tick, pid,
        arg_max(gpu_id, (gpu_id, -coalesce(used_gpu_memory, 0), id)) AS gpu_id,
        arg_max(coalesce(used_gpu_memory, 0), (gpu_id, -coalesce(used_gpu_memory, 0), id)) AS mem
      FROM s GROUP BY tick, pid),
process_events AS (
  SELECT w.tick AS "timestamp", w.pid, o.name,
    {_category_sql('o.name', 'o.command_line', 'o.exe_path', 'u.gpu_util')} AS category,
    w.mem // 1048576 AS gpu_memory_mb, u.gpu_util AS gpu_utilization, o.command_line, o.exe_path,
    CAST(0 AS BIGINT) AS duration_secs
  FROM w JOIN u ON w.tick = u.tick AND w.gpu_id = u.gpu_id JOIN os_processes o ON w.pid = o.pid)
"""


def _process_events(spark, sf_dir):
    return P.process_events(_v(spark, sf_dir, "process_samples"), _v(spark, sf_dir, "os_processes"),
                            tick_unit="day", library_roots=ROOTS)


@register("process_events", PE_SQL + "SELECT * FROM process_events")
def q_process_events(spark, sf_dir):
    """One classified event per (day tick, pid) found in the OS process table."""
    return _process_events(spark, sf_dir)


@register("weekly_summary", PE_SQL + """
SELECT CAST(date_trunc('week', "timestamp") AS DATE) AS week_start,
  CAST(date_trunc('week', "timestamp") AS DATE) + 7 AS week_end, category,
  CAST(sum(duration_secs) AS BIGINT) AS total_duration_secs, avg(gpu_utilization) AS avg_gpu_utilization,
  max(gpu_utilization) AS max_gpu_utilization, CAST(sum(gpu_memory_mb) AS BIGINT) AS total_gpu_memory_mb,
  count(*) AS event_count
FROM process_events WHERE category IN ('gaming', 'llm_inference', 'ml_training', 'general_compute')
GROUP BY 1, 2, 3""")
def q_weekly_summary(spark, sf_dir):
    """A1 (flagship): samples -> dedup -> OS join -> classify -> per (Monday week, category) roll-up."""
    return R.weekly_summary(_process_events(spark, sf_dir))


@register("category_gauges", PE_SQL + """,
t AS (SELECT "timestamp", category, count(*) AS process_count,
        CAST(sum(gpu_memory_mb * 1048576) AS BIGINT) AS memory_bytes FROM process_events GROUP BY 1, 2)
SELECT category, arg_max("timestamp", "timestamp") AS tick, arg_max(process_count, "timestamp") AS process_count,
  arg_max(memory_bytes, "timestamp") AS memory_bytes FROM t GROUP BY category""")
def q_category_gauges(spark, sf_dir):
    """A3: per-category process count and memory of the last tick the category occurred in."""
    return R.category_gauges(_process_events(spark, sf_dir))


@register("process_memory", PE_SQL + """
SELECT category, name AS process_name, pid, max("timestamp") AS tick,
  arg_max(gpu_memory_mb * 1048576, "timestamp") AS memory_bytes
FROM process_events GROUP BY category, name, pid""")
def q_process_memory(spark, sf_dir):
    """A4: last memory in bytes per (category, process name, pid)."""
    return R.process_memory(_process_events(spark, sf_dir))


# -------------------------------------------------------------- sessions
from fleetlens.operators import sessions as SS  # noqa: E402

SESSIONS_NOW = "2024-01-02T00:00:00Z"      # rolling 24 h panel covering the fixture day
BETWEEN = ("2024-01-01T00:00:00Z", "2024-12-31T23:59:59Z")   # lower bound equals the first start

LS_SQL = fixtures.duckdb_cte("llm_chunks") + """,
r AS (SELECT *,
  min(arrival_ts) OVER w AS st, first_value(model) OVER w AS m,
  min(CASE WHEN response IS NOT NULL THEN arrival_ts END) OVER w AS ft,
  last_value(prompt_eval_count IGNORE NULLS) OVER w AS pt,
  last_value(eval_count IGNORE NULLS) OVER w AS ct,
  last_value(eval_duration IGNORE NULLS) OVER w AS ed
  FROM llm_chunks
  WINDOW w AS (PARTITION BY session_id ORDER BY arrival_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT session_id, st, arrival_ts AS et, m, coalesce(pt, 0) AS pt, coalesce(ct, 0) AS ct,
        coalesce(ed, 0) AS ed, ft FROM r WHERE done),
llm_sessions AS (SELECT session_id AS id, st AS start_time, et AS end_time, m AS model,
  pt AS prompt_tokens, ct AS completion_tokens, pt + ct AS total_tokens,
  CASE WHEN ed > 0 THEN CAST(ct AS DOUBLE) * 1e9 / CAST(ed AS DOUBLE) ELSE 0.0 END AS tokens_per_second,
  (epoch_us(ft) - epoch_us(st)) // 1000 AS time_to_first_token_ms,
  CASE WHEN ct > 0 AND ed > 0 THEN CAST(ed AS DOUBLE) / 1e6 / CAST(ct AS DOUBLE) END AS time_per_output_token_ms
  FROM q)
"""


def _sessions(spark, sf_dir):
    return SS.track_sessions(_v(spark, sf_dir, "llm_chunks"))


@register("llm_sessions", LS_SQL + "SELECT * FROM llm_sessions")
def q_llm_sessions(spark, sf_dir):
    """R1 + P6: sessions rebuilt from the response chunks, one row per done chunk."""
    return _sessions(spark, sf_dir)


@register("sessions_between", LS_SQL + """
SELECT * FROM llm_sessions
WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time <= TIMESTAMP '2024-12-31 23:59:59'
ORDER BY start_time DESC, id""")
def q_sessions_between(spark, sf_dir):
    """Sessions started in [2024-01-01, 2024-12-31 23:59:59], both ends inclusive, newest first."""
    return SS.sessions_between(_sessions(spark, sf_dir), *BETWEEN)


@register("rolling_sessions", LS_SQL + """
SELECT * FROM llm_sessions
WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time <= TIMESTAMP '2024-01-02 00:00:00'""")
def q_rolling_sessions(spark, sf_dir):
    """T4: the rolling 24 h session panel ending at 2024-01-02T00:00Z."""
    return SS.rolling_sessions(_sessions(spark, sf_dir), SESSIONS_NOW)


def _fixed_sql(x: str, digits: int) -> str:
    """printf rounds the exact binary value; an exact tie, which it sends to the even side, goes up instead."""
    v = f"CAST({x} AS DOUBLE)"
    tie = f"{v} - floor({v}) IN (0.25, 0.75)" if digits else f"{v} - floor({v}) = 0.5"
    return f"printf('%.{digits}f', {v} + CASE WHEN {tie} THEN 0.01 ELSE 0.0 END)"


def _dur_text_sql(d: str) -> str:
    return (f"CASE WHEN {d} IS NULL OR {d} = 0 THEN '-' WHEN {d} < 60 THEN {_fixed_sql(d, 0)} || 's' "
            f"ELSE {_fixed_sql(d + ' / 60.0', 1)} || 'm' END")


DUR_SQL = "CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) / 1e6"


@register("recent_sessions", LS_SQL + f"""
SELECT id, start_time, strftime(start_time, '%H:%M:%S') AS "time", model, total_tokens,
  {_fixed_sql('tokens_per_second', 1)} AS tps_text,
  CASE WHEN time_to_first_token_ms IS NULL OR time_to_first_token_ms = 0 THEN '-'
       ELSE CAST(time_to_first_token_ms AS VARCHAR) || 'ms' END AS ttft_text,
  {_dur_text_sql(DUR_SQL)} AS duration_text
FROM llm_sessions ORDER BY start_time DESC, id LIMIT 10""")
def q_recent_sessions(spark, sf_dir):
    """T3 + P8: the ten newest sessions as display rows (top-k is the feature)."""
    return SS.recent_sessions(_sessions(spark, sf_dir), 10)


@register("session_totals", LS_SQL + f"""
SELECT *, {_fixed_sql('total_tokens / 1000.0', 1)} || 'k' AS total_tokens_text,
  CASE WHEN avg_duration_secs > 0 THEN {_dur_text_sql('avg_duration_secs')} ELSE '-' END AS avg_duration_text
FROM (SELECT count(*) AS total_sessions, round(avg(tokens_per_second), 6) AS avg_tokens_per_second,
  coalesce(avg(CASE WHEN time_to_first_token_ms > 0 THEN time_to_first_token_ms END), 0.0) AS avg_ttft_ms,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
  coalesce(avg(CASE WHEN end_time IS NOT NULL THEN {DUR_SQL} END), 0.0) AS avg_duration_secs
  FROM llm_sessions) WHERE total_sessions > 0""")
def q_session_totals(spark, sf_dir):
    """A10: the session panel's totals."""
    return _round6(SS.session_totals(_sessions(spark, sf_dir)), "avg_tokens_per_second")


@register("model_stats", LS_SQL + """
SELECT model, round(avg(tokens_per_second), 6) AS avg_tokens_per_second, count(*) AS session_count,
  max(start_time) AS newest_start FROM llm_sessions GROUP BY model""")
def q_model_stats(spark, sf_dir):
    """Mean tps and session count per model, best first."""
    return _round6(SS.model_stats(_sessions(spark, sf_dir)), "avg_tokens_per_second")


@register("best_model", LS_SQL + """
SELECT model, split_part(model, ':', 1) AS model_base, round(avg_tokens_per_second, 6) AS avg_tokens_per_second,
  session_count FROM (
  SELECT model, avg(tokens_per_second) AS avg_tokens_per_second, count(*) AS session_count,
    max(start_time) AS newest_start FROM llm_sessions GROUP BY model)
ORDER BY avg_tokens_per_second DESC, newest_start DESC, model LIMIT 1""")
def q_best_model(spark, sf_dir):
    """The model with the highest mean tps (tie: newest session)."""
    return _round6(SS.best_model(_sessions(spark, sf_dir)), "avg_tokens_per_second")


def _hist_sql(value: str, buckets) -> str:
    lbl = [R._le_label(b) for b in buckets]
    cols = ", ".join(f"count_if(v <= {float(b)}) AS b{i}" for i, b in enumerate(buckets))
    rows = _union_all([f"SELECT model, '{lbl[i]}' AS le, CAST(b{i} AS BIGINT) AS bucket_count, sample_sum, "
                       f"sample_count FROM h" for i in range(len(buckets))]
                      + ["SELECT model, '+Inf' AS le, sample_count AS bucket_count, sample_sum, sample_count FROM h"])
    return LS_SQL + f""", h0 AS (SELECT model, {cols}, count(v) AS sample_count, sum(v) AS sample_sum
  FROM (SELECT model, CAST({value} AS DOUBLE) AS v FROM llm_sessions WHERE {value} IS NOT NULL) GROUP BY model),
h AS (SELECT * REPLACE (round(sample_sum, 6) AS sample_sum) FROM h0)
{rows}"""


@register("tps_histogram", _hist_sql("tokens_per_second", R.TPS_BUCKETS))
def q_tps_histogram(spark, sf_dir):
    """A5: cumulative tokens-per-second histogram per model."""
    return _round6(R.tps_histogram(_sessions(spark, sf_dir)), "sample_sum")


@register("ttft_histogram", _hist_sql("time_to_first_token_ms", R.TTFT_BUCKETS_MS))
def q_ttft_histogram(spark, sf_dir):
    """A5: cumulative time-to-first-token histogram per model (null ttft not observed)."""
    return _round6(R.ttft_histogram(_sessions(spark, sf_dir)), "sample_sum")


@register("model_counters", LS_SQL + """
SELECT model, count(*) AS session_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM llm_sessions GROUP BY model""")
def q_model_counters(spark, sf_dir):
    """A6 + A7: session count and total tokens per model."""
    return R.model_counters(_sessions(spark, sf_dir))


# -------------------------------------------------------- metric snapshot
def _json_labels_sql(*pairs) -> str:
    items = sorted(pairs)
    body = " || ',' || ".join(f"'\"{k}\":\"' || CAST({v} AS VARCHAR) || '\"'" for k, v in items)
    return f"'{{' || {body} || '}}'"


def _snapshot_sql() -> str:
    gauges = """g AS (SELECT gpu_id, name, utilization_gpu, memory_used, memory_total, temperature, power_usage
  FROM (SELECT *, row_number() OVER (PARTITION BY gpu_id, name ORDER BY "timestamp" DESC, id DESC) AS rn
        FROM gpu_metrics) WHERE rn = 1)"""
    parts = []
    gl = _json_labels_sql(("gpu_id", "gpu_id"), ("gpu_name", "name"))
    for col, name in R.GPU_GAUGE_NAMES.items():
        parts.append(f"SELECT '{name}' AS metric, {gl} AS labels, CAST({col} AS DOUBLE) AS value FROM g")
    ml = _json_labels_sql(("model", "model"))
    for base, tbl in ((R.TPS_HISTOGRAM_NAME, "htps"), (R.TTFT_HISTOGRAM_NAME, "httft")):
        parts.append(f"SELECT '{base}_bucket', {_json_labels_sql(('le', 'le'), ('model', 'model'))}, "
                     f"CAST(bucket_count AS DOUBLE) FROM {tbl}")
        parts.append(f"SELECT '{base}_sum', {ml}, CAST(sample_sum AS DOUBLE) FROM {tbl} WHERE le = '+Inf'")
        parts.append(f"SELECT '{base}_count', {ml}, CAST(sample_count AS DOUBLE) FROM {tbl} WHERE le = '+Inf'")
    parts.append(f"SELECT '{R.SESSION_COUNT_NAME}', {ml}, CAST(count(*) AS DOUBLE) FROM llm_sessions GROUP BY model")
    parts.append(f"SELECT '{R.TOTAL_TOKENS_NAME}', {ml}, CAST(sum(total_tokens) AS DOUBLE) FROM llm_sessions "
                 "GROUP BY model")
    cl = _json_labels_sql(("category", "category"))
    parts.append(f"SELECT '{R.PROCESS_COUNT_NAME}', {cl}, CAST(process_count AS DOUBLE) FROM cg")
    parts.append(f"SELECT '{R.PROCESS_MEMORY_NAME}', {cl}, CAST(memory_bytes AS DOUBLE) FROM cg")
    pl = _json_labels_sql(("category", "category"), ("pid", "pid"), ("process_name", "process_name"))
    parts.append(f"SELECT '{R.PROCESS_MEMORY_BY_PID_NAME}', {pl}, CAST(memory_bytes AS DOUBLE) FROM pm")

    def hist_cte(value, buckets, name):
        lbl = [R._le_label(b) for b in buckets]
        cols = ", ".join(f"count_if(v <= {float(b)}) AS b{i}" for i, b in enumerate(buckets))
        rows = _union_all([f"SELECT model, '{lbl[i]}' AS le, CAST(b{i} AS BIGINT) AS bucket_count, "
                           f"round(sample_sum, 6) AS sample_sum, sample_count FROM {name}0"
                           for i in range(len(buckets))]
                          + [f"SELECT model, '+Inf' AS le, sample_count, round(sample_sum, 6), sample_count "
                             f"FROM {name}0"])
        return (f", {name}0 AS (SELECT model, {cols}, count(v) AS sample_count, sum(v) AS sample_sum FROM "
                f"(SELECT model, CAST({value} AS DOUBLE) AS v FROM llm_sessions WHERE {value} IS NOT NULL) "
                f"GROUP BY model), {name} AS ({rows})")

    pe = PE_SQL[PE_SQL.index("s AS (SELECT *, date_trunc"):]
    return (fixtures.duckdb_cte("gpu_metrics", "llm_chunks", "process_samples", "os_processes")
            + ", " + LS_SQL[LS_SQL.index("r AS (SELECT *,"):].rstrip() + ",\n" + pe.rstrip() + ",\n" + gauges
            + hist_cte("tokens_per_second", R.TPS_BUCKETS, "htps")
            + hist_cte("time_to_first_token_ms", R.TTFT_BUCKETS_MS, "httft") + """,
t AS (SELECT "timestamp", category, count(*) AS process_count,
        CAST(sum(gpu_memory_mb * 1048576) AS BIGINT) AS memory_bytes FROM process_events GROUP BY 1, 2),
cg AS (SELECT category, arg_max(process_count, "timestamp") AS process_count,
        arg_max(memory_bytes, "timestamp") AS memory_bytes FROM t GROUP BY category),
pm AS (SELECT category, name AS process_name, pid, arg_max(gpu_memory_mb * 1048576, "timestamp") AS memory_bytes
       FROM process_events GROUP BY category, name, pid)
""" + _union_all(parts))


@register("metric_snapshot", _snapshot_sql())
def q_metric_snapshot(spark, sf_dir):
    """Every exported gauge / counter / histogram series in long form (labels as JSON text)."""
    snap = R.metric_snapshot(M.gpu_gauges(_v(spark, sf_dir, "gpu_metrics")), _sessions(spark, sf_dir),
                             _process_events(spark, sf_dir))
    return snap.select("metric", F.to_json("labels").alias("labels"),
                       F.when(F.col("metric").endswith("_sum"), F.round("value", 6))
                       .otherwise(F.col("value")).alias("value"))


@register("export_10s", GM + """
SELECT make_timestamp(epoch_us("timestamp") // 10000000 * 10000000) AS window_start,
  make_timestamp(epoch_us("timestamp") // 10000000 * 10000000 + 10000000) AS window_end, gpu_id, name,
  arg_max(utilization_gpu, ("timestamp", id)) AS utilization_gpu, arg_max(memory_used, ("timestamp", id)) AS memory_used,
  arg_max(memory_total, ("timestamp", id)) AS memory_total, arg_max(temperature, ("timestamp", id)) AS temperature,
  arg_max(power_usage, ("timestamp", id)) AS power_usage
FROM gpu_metrics GROUP BY 1, 2, 3, 4""")
def q_export_10s(spark, sf_dir):
    """Last gauge values per 10-second export period and GPU."""
    return R.export_windows(_v(spark, sf_dir, "gpu_metrics"))


# ---------------------------------------------------------------- parsers
from fleetlens.functions.display import rfc3339  # noqa: E402
from fleetlens.sources import chunks as CH  # noqa: E402
from fleetlens.sources import gpu as SG  # noqa: E402


def gpu_csv_lines(spark, sf_dir) -> DataFrame:
    """Probe text for every metric row: the 8 CSV fields, memory in MiB, power as a decimal.  Some rows have
    readings beyond a signed 32-bit value, a power beyond the unsigned one, or a name with a comma (a bad line)."""
    g = _v(spark, sf_dir, "gpu_metrics")
    odd = F.col("id") % 50
    return g.select("id", F.col("timestamp").alias("ts"), F.concat_ws(
        ", ", "gpu_id", F.when(odd == 9, F.lit("A, B")).otherwise(F.col("name")), "utilization_gpu", "utilization_memory",
        gpu_fn.bytes_to_mib("memory_used"), gpu_fn.bytes_to_mib("memory_total"),
        F.when(odd == 7, F.col("id") + 3000000000).otherwise(F.col("temperature")),
        F.when(odd == 8, F.lit("9e9")).otherwise(F.concat(F.col("power_usage").cast("string"), F.lit(".75")))).alias("value"))


@register("parse_gpu_csv", GM + """
SELECT id, "timestamp", gpu_id::BIGINT AS gpu_id, name, utilization_gpu::BIGINT AS utilization_gpu,
  utilization_memory::BIGINT AS utilization_memory,
  memory_used // 1048576 * 1048576 AS memory_used, memory_total // 1048576 * 1048576 AS memory_total,
  CASE WHEN id % 50 = 7 THEN 3000000000 + id ELSE temperature END AS temperature,
  CASE WHEN id % 50 = 8 THEN 4294967295 ELSE power_usage END AS power_usage FROM gpu_metrics
WHERE id % 50 <> 9""")
def q_parse_gpu_csv(spark, sf_dir):
    """Probe CSV text of every metric row parsed back (memory at MiB precision, power truncated)."""
    lines = gpu_csv_lines(spark, sf_dir)
    return SG.parse_gpu_csv(lines, timestamp=F.col("ts")).drop("ts")


def llm_raw_chunks(spark, sf_dir) -> DataFrame:
    """Raw chunk bytes for every chunk row: a blank line, a record with text after it that forges an end marker
    (rejected), the JSON record, then a non-JSON line."""
    c = _v(spark, sf_dir, "llm_chunks")
    rec = F.to_json(F.struct("model", rfc3339("arrival_ts").alias("created_at"), "response", "done",
                             "eval_count", "eval_duration", "prompt_eval_count"))
    forged = F.concat(F.regexp_replace(rec, '"done":(true|false)', '"done":true'), F.lit(',"#end#"] trailing'))
    text = F.concat(F.lit("\r\n"), forged, F.lit("\n"), rec, F.lit("\ntrailing status line"))
    return c.select("session_id", "seq", "arrival_ts", text.cast("binary").alias("chunk"))


@register("parse_llm_chunks", fixtures.duckdb_cte("llm_chunks") + """
SELECT session_id, seq, arrival_ts, model,
  strftime(arrival_ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at, response, done,
  eval_count, eval_duration, prompt_eval_count, CAST(NULL AS BIGINT) AS prompt_eval_duration
FROM llm_chunks""")
def q_parse_llm_chunks(spark, sf_dir):
    """Raw chunk bytes of every chunk parsed strictly (first valid line wins)."""
    return CH.stored_counts(CH.parse_llm_chunks(llm_raw_chunks(spark, sf_dir)))


def request_bodies(spark, sf_dir) -> DataFrame:
    """A request body per conversation turn: system turns send no model."""
    c = fixtures.table(spark, sf_dir, "conversations")
    model = F.when(F.col("conv_id") % 3 == 0, F.lit("llama2:7b")).when(F.col("conv_id") % 3 == 1, F.lit("qwen2:0.5b")) \
        .otherwise(F.lit("mistral:7b"))
    body = F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("prompt")))) \
        .otherwise(F.to_json(F.struct(model.alias("model"), F.col("text").alias("prompt"))))
    return c.select("conv_id", "turn", body.cast("binary").alias("body"))


@register("request_model", """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'unknown'
  WHEN conv_id % 3 = 0 THEN 'llama2:7b' WHEN conv_id % 3 = 1 THEN 'qwen2:0.5b' ELSE 'mistral:7b' END AS model
FROM conversations""")
def q_request_model(spark, sf_dir):
    """Model named by every request body (``unknown`` when absent)."""
    return request_bodies(spark, sf_dir).select("conv_id", "turn", CH.request_model("body").alias("model"))


# ------------------------------------------------------ table maintenance
from fleetlens.sinks import archive as AR  # noqa: E402
from fleetlens.sinks import tables as TB  # noqa: E402
from fleetlens.sources import stored as ST  # noqa: E402


def session_reemission(sessions: DataFrame) -> DataFrame:
    """A second emission of every session with changed values (model and prompt
    count included, which the upsert must not take)."""
    return sessions.select(
        "id", "start_time", (F.col("end_time") + F.expr("INTERVAL 1 SECOND")).alias("end_time"),
        F.concat(F.col("model"), F.lit("-v2")).alias("model"), (F.col("prompt_tokens") + 1).alias("prompt_tokens"),
        (F.col("completion_tokens") + 1).alias("completion_tokens"), (F.col("total_tokens") + 2).alias("total_tokens"),
        (F.col("tokens_per_second") * 2).alias("tokens_per_second"),
        (F.col("time_to_first_token_ms") + 1).alias("time_to_first_token_ms"), "time_per_output_token_ms")


@register("upsert_sessions", LS_SQL + """
SELECT id, start_time, end_time + INTERVAL 1 SECOND AS end_time, model, prompt_tokens,
  completion_tokens + 1 AS completion_tokens, total_tokens + 2 AS total_tokens,
  tokens_per_second * 2 AS tokens_per_second, time_to_first_token_ms + 1 AS time_to_first_token_ms,
  time_per_output_token_ms FROM llm_sessions""")
def q_upsert_sessions(spark, sf_dir):
    """K2: stored sessions merged with a changed re-emission: start, model, prompt kept; the rest replaced."""
    stored = _sessions(spark, sf_dir)
    return TB.merge_sessions(stored, session_reemission(stored))


@register("upsert_weekly", PE_SQL + """, wk AS (
SELECT CAST(date_trunc('week', "timestamp") AS DATE) AS week_start,
  CAST(date_trunc('week', "timestamp") AS DATE) + 7 AS week_end, category,
  CAST(sum(duration_secs) AS BIGINT) AS total_duration_secs, avg(gpu_utilization) AS avg_gpu_utilization,
  max(gpu_utilization) AS max_gpu_utilization, CAST(sum(gpu_memory_mb) AS BIGINT) AS total_gpu_memory_mb,
  count(*) AS event_count
FROM process_events WHERE category IN ('gaming', 'llm_inference', 'ml_training', 'general_compute')
GROUP BY 1, 2, 3)
SELECT week_start, week_end, category, total_duration_secs, avg_gpu_utilization, max_gpu_utilization,
  total_gpu_memory_mb, CASE WHEN category = 'gaming' THEN event_count + 1 ELSE event_count END AS event_count
FROM wk""")
def q_upsert_weekly(spark, sf_dir):
    """K4: stored weekly summaries merged with a recomputed gaming category (replaced per week and category)."""
    stored = R.weekly_summary(_process_events(spark, sf_dir))
    incoming = stored.where(F.col("category") == "gaming").withColumn("event_count", F.col("event_count") + 1)
    return TB.merge_weekly(stored, incoming)


ARCHIVE_CUTOFF = AR.cutoff_date(NOW, 16)     # 2024-01-15


@register("archive_split", fixtures.duckdb_cte("gpu_metrics", "process_samples", "os_processes", "llm_chunks")
          + ", " + LS_SQL[LS_SQL.index("r AS (SELECT *,"):].rstrip() + ",\n"
          + PE_SQL[PE_SQL.index("s AS (SELECT *, date_trunc"):].rstrip() + """
SELECT 'gpu_metrics' AS table_name, DATE '2024-01-15' AS cutoff,
  count_if("timestamp" < TIMESTAMP '2024-01-15') AS archived_rows, count_if("timestamp" >= TIMESTAMP '2024-01-15') AS kept_rows
FROM gpu_metrics
UNION ALL SELECT 'process_events', DATE '2024-01-15', count_if("timestamp" < TIMESTAMP '2024-01-15'),
  count_if("timestamp" >= TIMESTAMP '2024-01-15') FROM process_events
UNION ALL SELECT 'llm_sessions', DATE '2024-01-15', count_if(start_time < TIMESTAMP '2024-01-15'),
  count_if(start_time >= TIMESTAMP '2024-01-15') FROM llm_sessions""")
def q_archive_split(spark, sf_dir):
    """K5: rows each table's archive at cutoff 2024-01-15 takes and keeps."""
    parts = [AR.archive_split(_v(spark, sf_dir, "gpu_metrics"), "gpu_metrics", ARCHIVE_CUTOFF),
             AR.archive_split(_process_events(spark, sf_dir), "process_events", ARCHIVE_CUTOFF),
             AR.archive_split(_sessions(spark, sf_dir), "llm_sessions", ARCHIVE_CUTOFF)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("retain", GM + """
SELECT DATE '2024-01-24' AS cutoff, count_if("timestamp" < TIMESTAMP '2024-01-24') AS deleted_rows,
  count_if("timestamp" >= TIMESTAMP '2024-01-24') AS kept_rows FROM gpu_metrics""")
def q_retain(spark, sf_dir):
    """K8: gpu_metrics rows a 7-day retention at NOW deletes (before 2024-01-24) and keeps."""
    return AR.retention_split(_v(spark, sf_dir, "gpu_metrics"), 7, NOW)


# --------------------------------------------------------- more sources
def request_log(spark, sf_dir) -> DataFrame:
    """A proxy request log with one request per conversation turn."""
    c = fixtures.table(spark, sf_dir, "conversations")
    bodies = request_bodies(spark, sf_dir)
    path = (F.when(F.col("role") == "user", F.lit("/api/generate"))
            .when(F.col("role") == "assistant", F.lit("/api/chat")).otherwise(F.lit("/api/tags")))
    status = F.when(F.length("text") % 7 == 0, F.lit(503)).otherwise(F.lit(200))
    ts = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("conv_id").cast("int"))
          + F.make_interval(secs=F.col("turn").cast("int")))
    return (c.join(bodies, ["conv_id", "turn"])
            .select(F.concat_ws("-", "conv_id", "turn").alias("request_key"), ts.alias("ts"), path.alias("path"),
                    status.cast("int").alias("status"), "body"))


@register("llm_requests", """
SELECT sha256(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)) AS session_id,
  CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_key,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * conv_id + INTERVAL '1' SECOND * turn AS ts,
  CASE WHEN role = 'user' THEN '/api/generate' ELSE '/api/chat' END AS path,
  CASE WHEN conv_id % 3 = 0 THEN 'llama2:7b' WHEN conv_id % 3 = 1 THEN 'qwen2:0.5b' ELSE 'mistral:7b' END AS model
FROM conversations WHERE role IN ('user', 'assistant') AND length(text) % 7 <> 0""")
def q_llm_requests(spark, sf_dir):
    """Requests to a streaming endpoint with a 2xx answer, with their session id and model."""
    return CH.llm_requests(request_log(spark, sf_dir))


def llm_log_lines(spark, sf_dir) -> DataFrame:
    """Server log lines: each chunk record as JSON with the endpoint it was served on."""
    c = _v(spark, sf_dir, "llm_chunks")
    endpoint = (F.when(F.col("done"), F.lit("/api/chat")).when(F.col("response").isNotNull(), F.lit("/api/generate"))
                .otherwise(F.lit("/api/tags")))
    rec = F.to_json(F.struct(endpoint.alias("endpoint"), "model", rfc3339("arrival_ts").alias("created_at"),
                             "response", "done", "eval_count", "eval_duration", "prompt_eval_count"))
    return c.select("session_id", "seq", rec.alias("value"))


@register("parse_llm_log_lines", fixtures.duckdb_cte("llm_chunks") + """
SELECT session_id, seq, model, strftime(arrival_ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at, response, done,
  eval_count, eval_duration, prompt_eval_count, CAST(NULL AS BIGINT) AS prompt_eval_duration
FROM llm_chunks
WHERE done OR response IS NOT NULL OR strpos(coalesce(response, ''), 'generate') > 0
  OR strpos(coalesce(response, ''), 'chat') > 0 OR strpos(model, 'generate') > 0 OR strpos(model, 'chat') > 0""")
def q_parse_llm_log_lines(spark, sf_dir):
    """Log lines that name generate or chat, parsed as chunk records."""
    return CH.stored_counts(CH.parse_llm_log_lines(llm_log_lines(spark, sf_dir)))


@register("parse_stored_times", LS_SQL + "SELECT id, start_time, end_time FROM llm_sessions")
def q_parse_stored_times(spark, sf_dir):
    """Session times stored as RFC 3339 text ('Z' and '+00:00' forms) parsed back."""
    s = _sessions(spark, sf_dir)
    text = s.select("id", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").alias("start_time"),
                    rfc3339("end_time").alias("end_time"))
    return ST.parse_stored_times(text, ["start_time"], ["end_time"])


# ------------------------------------------------------ more gpu / export
@register("latest_metrics", GM + f"""
SELECT {GM_COLS} FROM gpu_metrics ORDER BY "timestamp" DESC, id DESC LIMIT 10""")
def q_latest_metrics(spark, sf_dir):
    """The ten newest metric rows (top-k is the feature)."""
    return M.latest_metrics(_v(spark, sf_dir, "gpu_metrics"), 10)


@register("chart_arrays", _indexed_cte() + f""", d AS (
SELECT *, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS label, {MEMPCT_SQL} AS memory_percent FROM ix
WHERE n <= {MAX_POINTS} OR idx % greatest(1, CAST(ceil(n / {float(MAX_POINTS)}) AS BIGINT)) = 0)
SELECT gpu_id, list(label ORDER BY idx) AS labels, list(utilization_gpu ORDER BY idx) AS utilization_gpu,
  list(utilization_memory ORDER BY idx) AS utilization_memory, list(memory_percent ORDER BY idx) AS memory_percent,
  list(temperature ORDER BY idx) AS temperature, list(power_usage ORDER BY idx) AS power_usage
FROM d GROUP BY gpu_id""")
def q_chart_arrays(spark, sf_dir):
    """A8 + W1, array form: per GPU parallel arrays of the downsampled series (at most 400 points each)."""
    return M.chart_arrays(_v(spark, sf_dir, "gpu_metrics"), MAX_POINTS)


@register("export_tokens_10s", LS_SQL + """
SELECT make_timestamp(epoch_us(end_time) // 10000000 * 10000000) AS window_start,
  make_timestamp(epoch_us(end_time) // 10000000 * 10000000 + 10000000) AS window_end, model,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS sessions
FROM llm_sessions WHERE end_time IS NOT NULL GROUP BY 1, 2, 3""")
def q_export_tokens_10s(spark, sf_dir):
    """R5 counters: tokens and sessions per model per 10-second export period (delta form)."""
    return R.export_counters(_sessions(spark, sf_dir))


# ------------------------------------------------- device samples / models
from fleetlens.operators.processes import flatten_processes  # noqa: E402


def device_samples(spark, sf_dir) -> DataFrame:
    """Raw device samples, one per metric row: readings a device did not return are null
    (temperature above 90, the name at 0 % utilisation, both utilisations when it reports no
    memory), power in mW; the process lists hold the sample's process in the compute list and
    the same pid, name unknown, at half the memory in the graphics list."""
    g = _v(spark, sf_dir, "gpu_metrics")
    p = _v(spark, sf_dir, "process_samples").select("id", "pid", F.col("name").alias("pname"), "used_gpu_memory")
    no_mem = F.col("memory_total") == 0
    proc_t = "array<struct<pid:bigint,name:string,used_gpu_memory:bigint>>"
    return g.join(p, "id").select(
        F.col("id").alias("sample_id"), "timestamp", F.col("gpu_id").alias("gpu_index"),
        F.when(F.col("utilization_gpu") > 0, F.col("name")).alias("name"),
        F.when(~no_mem, F.col("utilization_gpu")).alias("utilization_gpu"),
        F.when(~no_mem, F.col("utilization_memory")).alias("utilization_memory"),
        "memory_used", "memory_total",
        F.when(F.col("temperature") <= 90, F.col("temperature")).alias("temperature"),
        (F.col("power_usage").cast("long") * 1000 + 999).alias("power_mw"),
        F.array(F.struct("pid", F.col("pname").alias("name"), "used_gpu_memory")).cast(proc_t).alias("compute_processes"),
        F.array(F.struct("pid", F.lit(None).cast("string").alias("name"),
                         gpu_fn.int_div("used_gpu_memory", 2).alias("used_gpu_memory"))).cast(proc_t)
        .alias("graphics_processes"))


DS_SQL = fixtures.duckdb_cte("gpu_metrics", "process_samples") + """,
ds AS (SELECT g.id AS sample_id, g."timestamp", g.gpu_id, g.name, g.utilization_gpu, g.utilization_memory,
  g.memory_used, g.memory_total, g.temperature, g.power_usage, p.pid, p.name AS pname, p.used_gpu_memory
  FROM gpu_metrics g JOIN process_samples p ON g.id = p.id WHERE g.memory_total <> 0)
"""


@register("device_metrics", DS_SQL + """
SELECT sample_id, "timestamp", gpu_id::BIGINT AS gpu_id, CASE WHEN utilization_gpu > 0 THEN name ELSE 'GPU ' || CAST(gpu_id AS VARCHAR) END AS name,
  utilization_gpu::BIGINT AS utilization_gpu, utilization_memory::BIGINT AS utilization_memory, memory_used, memory_total,
  CASE WHEN temperature <= 90 THEN temperature ELSE 0 END::BIGINT AS temperature, power_usage::BIGINT AS power_usage FROM ds""")
def q_device_metrics(spark, sf_dir):
    """Device samples normalised to metric rows (defaults for missing readings, devices without
    utilisation skipped, mW to W)."""
    from fleetlens.sources.gpu import normalise_device_samples
    return normalise_device_samples(device_samples(spark, sf_dir)).drop("compute_processes", "graphics_processes")


@register("device_processes", DS_SQL + """
SELECT sample_id, 0::BIGINT AS id, "timestamp", gpu_id::BIGINT AS gpu_id, utilization_gpu::BIGINT AS gpu_utilization, pid, pname AS name,
  used_gpu_memory FROM ds
UNION ALL
SELECT sample_id, 1::BIGINT, "timestamp", gpu_id, utilization_gpu, pid, 'pid_' || CAST(pid AS VARCHAR),
  used_gpu_memory // 2 FROM ds""")
def q_device_processes(spark, sf_dir):
    """S2 + S3 + J2: each sample's process list (compute ++ graphics, memory descending) flattened
    with its position and the GPU's utilisation."""
    from fleetlens.sources.gpu import device_metrics_with_processes
    m = device_metrics_with_processes(device_samples(spark, sf_dir))
    return flatten_processes(m, keys=("sample_id",))


def model_snapshots(spark, sf_dir) -> DataFrame:
    """A running-models answer per chunk: the chunk's model, status 503 while it has no response."""
    c = _v(spark, sf_dir, "llm_chunks")
    body = F.to_json(F.struct(F.array(F.struct(F.col("model").alias("name"))).alias("models")))
    status = F.when(F.col("response").isNotNull(), F.lit(200)).otherwise(F.lit(503))
    return c.select("session_id", "seq", F.col("arrival_ts").alias("ts"), status.alias("status"), body.alias("body"))


@register("running_models", fixtures.duckdb_cte("llm_chunks") + """
SELECT session_id, seq, arrival_ts AS ts, 200 AS status, 0 AS position, model FROM llm_chunks
WHERE response IS NOT NULL""")
def q_running_models(spark, sf_dir):
    """Model names listed by every successful running-models answer."""
    return CH.running_models(model_snapshots(spark, sf_dir))


# ------------------------------------------------------------- streaming
@register("sessions_stream", LS_SQL + "SELECT * FROM llm_sessions")
def q_sessions_stream(spark, sf_dir):
    """R1 under Structured Streaming: the chunks, landed once in the shared checkpoint folder, are
    read as a stream (availableNow), folded by the stateful session tracker and written by the
    exactly-once file sink; the result is that sink's output."""
    import uuid

    from fleetlens.schemas import LLM_CHUNKS
    from fleetlens.streaming.sessions import track_sessions_stream

    base = f"{config.checkpoint_dir(spark)}/fleetlens-sessions-stream-{uuid.uuid4().hex}"
    _v(spark, sf_dir, "llm_chunks").select(*LLM_CHUNKS.fieldNames()).write.parquet(f"{base}/chunks")
    stream = spark.readStream.schema(LLM_CHUNKS).parquet(f"{base}/chunks")
    query = (track_sessions_stream(stream).writeStream.format("parquet").outputMode("append")
             .option("path", f"{base}/sessions").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(f"{base}/sessions")


@register("export_process_10s", PE_SQL + """,
t AS (SELECT "timestamp", category, count(*) AS process_count,
        CAST(sum(gpu_memory_mb * 1048576) AS BIGINT) AS memory_bytes FROM process_events GROUP BY 1, 2)
SELECT make_timestamp(epoch_us("timestamp") // 10000000 * 10000000) AS window_start,
  make_timestamp(epoch_us("timestamp") // 10000000 * 10000000 + 10000000) AS window_end, category,
  arg_max(process_count, "timestamp") AS process_count, arg_max(memory_bytes, "timestamp") AS memory_bytes
FROM t GROUP BY 1, 2, 3""")
def q_export_process_10s(spark, sf_dir):
    """Per-category process gauges per 10-second export period (last tick in the period)."""
    return R.export_process_gauges(_process_events(spark, sf_dir))


def _hist_window_sql(value: str = "tokens_per_second", buckets=R.TPS_BUCKETS) -> str:
    lbl = [R._le_label(b) for b in buckets]
    cols = ", ".join(f"count_if(v <= {float(b)}) AS b{i}" for i, b in enumerate(buckets))
    rows = _union_all([f"SELECT window_start, model, '{lbl[i]}' AS le, CAST(b{i} AS BIGINT) AS bucket_count, "
                       f"sample_sum, sample_count FROM h" for i in range(len(buckets))]
                      + ["SELECT window_start, model, '+Inf' AS le, sample_count AS bucket_count, sample_sum, "
                         "sample_count FROM h"])
    return LS_SQL + f""", h AS (SELECT window_start, model, {cols}, count(v) AS sample_count,
  round(sum(v), 6) AS sample_sum
  FROM (SELECT make_timestamp(epoch_us(end_time) // 10000000 * 10000000) AS window_start, model,
          CAST({value} AS DOUBLE) AS v FROM llm_sessions WHERE end_time IS NOT NULL AND {value} IS NOT NULL)
  GROUP BY window_start, model)
{rows}"""


@register("export_tps_histogram_10s", _hist_window_sql())
def q_export_tps_histogram_10s(spark, sf_dir):
    """Tokens-per-second histogram deltas per model and 10-second export period."""
    return _round6(R.export_tps_histogram(_sessions(spark, sf_dir)), "sample_sum")


@register("export_ttft_histogram_10s", _hist_window_sql("time_to_first_token_ms", R.TTFT_BUCKETS_MS))
def q_export_ttft_histogram_10s(spark, sf_dir):
    """Time-to-first-token histogram deltas per model and 10-second export period."""
    return _round6(R.export_ttft_histogram(_sessions(spark, sf_dir)), "sample_sum")


# ------------------------------------------------- operators on written tables
def _scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    import uuid
    return f"{config.checkpoint_dir(spark)}/fleetlens-{name}-{uuid.uuid4().hex}"


def _stage(rows: DataFrame, base: str) -> None:
    """``rows`` written once as landings by their column ``_file``; a landing has a file of every task that had rows of it."""
    rows.write.partitionBy("_file").parquet(f"{base}/staged")


def _land(spark, base: str, n: int) -> None:
    """Staged landing ``n`` comes whole into the streamed folders ``<base>/rows/*``."""
    fs = Folders(spark, base)
    if fs.exists(f"{base}/staged/_file={n}"):        # else it has no row
        fs.move(f"{base}/staged/_file={n}", f"{base}/rows/landed-{n}")


def _gpu_metrics_typed(spark, sf_dir) -> DataFrame:
    """The metrics in the types of the stored table."""
    g = _v(spark, sf_dir, "gpu_metrics")
    return g.select(*[F.col(f.name).cast(f.dataType) for f in SCH.GPU_METRICS.fields])


from fleetlens import schemas as SCH  # noqa: E402
from fleetlens.sinks import compaction as CO  # noqa: E402
from fleetlens.sinks.files import Folders  # noqa: E402
from fleetlens.streaming import ingest as IN  # noqa: E402

GM_STORED = ('id, "timestamp", gpu_id::BIGINT AS gpu_id, name, utilization_gpu::BIGINT AS utilization_gpu, '
             'utilization_memory::BIGINT AS utilization_memory, memory_used, memory_total, '
             'temperature::BIGINT AS temperature, power_usage::BIGINT AS power_usage')


@register("append_gpu_metrics", GM + f"""SELECT {GM_STORED}, CAST("timestamp" AS DATE) AS "date" FROM gpu_metrics""")
def q_append_gpu_metrics(spark, sf_dir):
    """K1 + S10: the metrics appended in two writes to a date-partitioned table and read back as an archive is."""
    path, g = _scratch(spark, "k1"), _gpu_metrics_typed(spark, sf_dir)
    TB.append_gpu_metrics(g.where("id % 2 = 0"), path)
    TB.append_gpu_metrics(g.where("id % 2 = 1"), path)
    return ST.read_archive(spark, path, SCH.StructType([*SCH.GPU_METRICS.fields, SCH.StructField("date", SCH.DateType())]))


@register("append_process_events", PE_SQL + """SELECT *, CAST("timestamp" AS DATE) AS "date" FROM process_events""")
def q_append_process_events(spark, sf_dir):
    """K3: the process events appended to a date-partitioned table and read back."""
    path = _scratch(spark, "k3")
    TB.append_process_events(_process_events(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("upsert_sessions_table", LS_SQL + """
SELECT id, start_time, end_time + INTERVAL 1 SECOND AS end_time, model, prompt_tokens,
  completion_tokens + 1 AS completion_tokens, total_tokens + 2 AS total_tokens,
  tokens_per_second * 2 AS tokens_per_second, time_to_first_token_ms + 1 AS time_to_first_token_ms,
  time_per_output_token_ms, CAST(start_time AS DATE) AS start_date FROM llm_sessions""")
def q_upsert_sessions_table(spark, sf_dir):
    """K2's write path: sessions stored, a changed re-emission upserted twice, each folded into the days, and
    once more, left as a delta; the table read back."""
    path, stored = _scratch(spark, "k2"), _sessions(spark, sf_dir)
    TB.upsert_sessions(spark, stored, path)
    for _ in range(2):
        TB.upsert_sessions(spark, session_reemission(stored), path)
        TB.fold_sessions(spark, path)
    TB.upsert_sessions(spark, session_reemission(stored), path)      # unfolded: merged by the reader
    return TB.read_sessions(spark, path)


@register("archive_log", GM + """
SELECT CAST("timestamp" AS DATE) AS archive_date, 'gpu_metrics' AS table_name, count(*) AS records_archived
FROM gpu_metrics WHERE "timestamp" < TIMESTAMP '2024-01-15' GROUP BY 1
UNION ALL SELECT DATE '2024-01-14', 'live', count(*) FROM gpu_metrics WHERE "timestamp" >= TIMESTAMP '2024-01-15'""")
def q_archive_log(spark, sf_dir):
    """K5, K6, K9: the metrics stored, maintained twice at a 16-day retention; the log, and the rows left live."""
    base = _scratch(spark, "k9")
    TB.append_gpu_metrics(_gpu_metrics_typed(spark, sf_dir), f"{base}/gpu_metrics")
    for _ in range(2):
        AR.maintain(spark, {"gpu_metrics": f"{base}/gpu_metrics"}, f"{base}/archive", 16, NOW)
    live = spark.read.parquet(f"{base}/gpu_metrics").agg(
        F.lit("2024-01-14").cast("date").alias("archive_date"), F.lit("live").alias("table_name"), F.count("*").alias("records_archived"))
    return spark.read.parquet(AR.log_path(f"{base}/archive")).drop("parquet_file").unionByName(live)


@register("archived_rows", GM + f"""SELECT {GM_STORED} FROM gpu_metrics WHERE "timestamp" < TIMESTAMP '2024-01-15'""")
def q_archived_rows(spark, sf_dir):
    """K5 + S10: the rows of all archives that a trimming archive at 2024-01-15 wrote."""
    base = _scratch(spark, "k5")
    TB.append_gpu_metrics(_gpu_metrics_typed(spark, sf_dir), f"{base}/gpu_metrics")
    AR.archive(spark, f"{base}/gpu_metrics", "gpu_metrics", ARCHIVE_CUTOFF, f"{base}/archive", trim=True)
    return ST.read_archive(spark, f"{base}/archive/*/batch=*", SCH.GPU_METRICS)


@register("list_archives", GM + """
SELECT DISTINCT 'gpu_metrics_' || strftime("timestamp", '%Y-%m-%d') || '.parquet' AS archive, true AS has_bytes, true AS size_agrees
FROM gpu_metrics WHERE "timestamp" < TIMESTAMP '2024-01-15'""")
def q_list_archives(spark, sf_dir):
    """K7: archives by name, and whether their sizes add up to the archive size."""
    base = _scratch(spark, "k7")
    TB.append_gpu_metrics(_gpu_metrics_typed(spark, sf_dir), f"{base}/gpu_metrics")
    AR.archive(spark, f"{base}/gpu_metrics", "gpu_metrics", ARCHIVE_CUTOFF, f"{base}/archive")
    found = AR.list_archives(spark, f"{base}/archive")
    total = found.agg(F.sum("bytes")).first()[0] or 0
    return found.select("archive", (F.col("bytes") > 0).alias("has_bytes"),
                        F.lit(total == AR.archive_size(spark, f"{base}/archive")).alias("size_agrees"))


@register("retained_rows", GM + f"""SELECT {GM_STORED}, CAST("timestamp" AS DATE) AS "date" FROM gpu_metrics
WHERE "timestamp" >= TIMESTAMP '2024-01-24'""")
def q_retained_rows(spark, sf_dir):
    """K8: the table after a 7-day retention at NOW."""
    path = _scratch(spark, "k8")
    TB.append_gpu_metrics(_gpu_metrics_typed(spark, sf_dir), path)
    AR.retain(spark, path, AR.cutoff_date(NOW, 7))
    return spark.read.parquet(path)


@register("compacted_days", GM + f"""SELECT {GM_STORED}, CAST("timestamp" AS DATE) AS "date" FROM gpu_metrics""")
def q_compacted_days(spark, sf_dir):
    """R4's compaction: the metrics written as four micro-batches, closed days compacted, then read by its reader."""
    path, g = _scratch(spark, "compact"), _gpu_metrics_typed(spark, sf_dir)
    for b in range(4):
        IN._write_batch(g.where(F.col("id") % 4 == b), path, b)
    CO.compact_closed_days(spark, path, AR.cutoff_date(NOW, 0), sort=("gpu_id",))
    return CO.read_ingested(spark, path).drop("batch_id")


def host_samples(spark, sf_dir) -> DataFrame:
    """The device samples dealt to two hosts, with eight readings to a poll."""
    return device_samples(spark, sf_dir).withColumn("host", F.concat(F.lit("h"), (F.col("sample_id") % 2).cast("string"))) \
        .withColumn("poll_id", F.floor(F.col("sample_id") / 8)).drop("sample_id")


def process_snapshots(spark, sf_dir) -> DataFrame:
    """Per host and poll, the processes that run then: the names change with the host and with every 100 polls."""
    s = device_samples(spark, sf_dir).select("sample_id", F.explode("compute_processes.pid").alias("pid"))
    s = s.select("pid", F.concat(F.lit("h"), (F.col("sample_id") % 2).cast("string")).alias("host"),
                 F.floor(F.col("sample_id") / 8).alias("poll_id")).where("pid % 10 <> 0").distinct()
    kind = (F.col("pid") + F.floor(F.col("poll_id") / 100) + F.when(F.col("host") == "h0", 0).otherwise(1)) % 3
    name = F.when(kind == 0, "ollama").when(kind == 1, "python3").otherwise("blender")
    return s.select("pid", name.alias("name"), F.when(kind == 1, "python3 -m torch.distributed").otherwise(name).alias("command_line"),
                    F.lit(None).cast("string").alias("exe_path"), "host", "poll_id")


@register("ingest", DS_SQL + """,
d AS (SELECT 'h' || CAST(sample_id % 2 AS VARCHAR) AS host, sample_id // 8 AS poll, * FROM ds),
u AS (SELECT host, poll, gpu_id, max(utilization_gpu) AS util FROM d GROUP BY 1, 2, 3),
a AS (SELECT host, poll, max("timestamp") AS "at" FROM d GROUP BY 1, 2),
w AS (SELECT host, poll, pid, max(gpu_id) AS gpu_id, arg_min(used_gpu_memory // 2, (-gpu_id, used_gpu_memory // 2)) AS mem
      FROM d GROUP BY 1, 2, 3),
k AS (SELECT *, (pid + poll // 100 + CASE WHEN host = 'h0' THEN 0 ELSE 1 END) % 3 AS kind FROM w WHERE pid % 10 <> 0)
SELECT k.host, a."at" AS "timestamp", k.pid, CASE kind WHEN 0 THEN 'ollama' WHEN 1 THEN 'python3' ELSE 'blender' END AS name,
  CASE kind WHEN 0 THEN 'llm_inference' WHEN 1 THEN 'ml_training' ELSE 'general_compute' END AS category,
  k.mem // 1048576 AS gpu_memory_mb, u.util::BIGINT AS gpu_utilization,
  CASE kind WHEN 0 THEN 'ollama' WHEN 1 THEN 'python3 -m torch.distributed' ELSE 'blender' END AS command_line,
  CAST(NULL AS VARCHAR) AS exe_path, 0::BIGINT AS duration_secs
FROM k JOIN u USING (host, poll, gpu_id) JOIN a USING (host, poll)""")
def q_ingest(spark, sf_dir):
    """R2: device samples of two hosts in three landings that cut every poll, ingested as a stream; the process
    tables of a poll land one batch late, half of each poll at a time; the process events stored."""
    base = _scratch(spark, "ingest")
    samples = host_samples(spark, sf_dir).select(*SCH.HOST_SAMPLES.fieldNames())
    _stage(samples.withColumn("_file", F.pmod(F.hash("gpu_index", "timestamp"), 3)), base)
    process_snapshots(spark, sf_dir).withColumn("part", F.col("pid") % 2).write.partitionBy("part").parquet(f"{base}/processes")
    stream = spark.readStream.schema(SCH.HOST_SAMPLES).parquet(f"{base}/rows/*")
    for n in range(4):
        if n < 3:
            _land(spark, base, n)
        else:      # one more landing without a sample: the batch that finds the rest of the process tables
            spark.createDataFrame([], SCH.HOST_SAMPLES).coalesce(1).write.parquet(f"{base}/rows/landed-{n}")

        def landed(s, n=n):
            seen = s.read.schema(SCH.PROCESS_SNAPSHOTS).parquet(*[f"{base}/processes/part={k}" for k in (0, 1)[:max(1, n)]])
            return seen if n else seen.limit(0)

        query = IN.start_ingest(spark, stream, landed, f"{base}/metrics", f"{base}/events", f"{base}/checkpoint", available_now=True)
        query.awaitTermination()
        if query.exception() is not None:
            raise RuntimeError(str(query.exception()))
    return CO.read_ingested(spark, f"{base}/events").drop("date", "batch_id", "written_batch", "poll_id")


@register("drained_sessions", LS_SQL + "SELECT *, CAST(start_time AS DATE) AS start_date FROM llm_sessions")
def q_drained_sessions(spark, sf_dir):
    """R3 and the reconcile: the chunks streamed, folded and upserted by the drain, then reconciled with all
    landed chunks; the stored sessions."""
    from fleetlens.streaming.sessions import drain_sessions, reconcile_sessions, track_sessions_stream

    base = _scratch(spark, "drain")
    _v(spark, sf_dir, "llm_chunks").select(*SCH.LLM_CHUNKS.fieldNames()).write.parquet(f"{base}/chunks")
    stream = spark.readStream.schema(SCH.LLM_CHUNKS).parquet(f"{base}/chunks")
    query = drain_sessions(spark, track_sessions_stream(stream), f"{base}/sessions", f"{base}/checkpoint", available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    TB.fold_sessions(spark, f"{base}/sessions")
    reconcile_sessions(spark, spark.read.schema(SCH.LLM_CHUNKS).parquet(f"{base}/chunks"), f"{base}/sessions")
    return TB.read_sessions(spark, f"{base}/sessions")


@register("hourly_upkeep", PE_SQL + """
SELECT CAST(date_trunc('week', "timestamp") AS DATE) AS week_start,
  CAST(date_trunc('week', "timestamp") AS DATE) + 7 AS week_end, category,
  CAST(sum(duration_secs) AS BIGINT) AS total_duration_secs, avg(gpu_utilization) AS avg_gpu_utilization,
  max(gpu_utilization) AS max_gpu_utilization, CAST(sum(gpu_memory_mb) AS BIGINT) AS total_gpu_memory_mb,
  count(*) AS event_count
FROM process_events WHERE category IN ('gaming', 'llm_inference', 'ml_training', 'general_compute')
  AND "timestamp" >= TIMESTAMP '2024-01-29' GROUP BY 1, 2, 3""")
def q_hourly_upkeep(spark, sf_dir):
    """Metrics stored, events landed in ingest batches, two upkeep runs at NOW with 7 days of retention and late
    events between them; the weekly summaries they wrote."""
    from fleetlens.plans.jobs import hourly_upkeep

    base = _scratch(spark, "upkeep")
    TB.append_gpu_metrics(_gpu_metrics_typed(spark, sf_dir), f"{base}/gpu_metrics")
    events = _process_events(spark, sf_dir)
    for batch in range(3):
        IN._write_batch(events.where(F.col("pid") % 3 == batch), f"{base}/process_events", batch)
        if batch:
            hourly_upkeep(spark, {"gpu_metrics": f"{base}/gpu_metrics", "process_events": f"{base}/process_events"},
                          f"{base}/archive", f"{base}/weekly", 7, NOW)
    return TB.read_weekly(spark, f"{base}/weekly")


@register("library_roots", PS + f"""
SELECT id, pid, {_in_lib_sql('exe_path')} AS in_library FROM process_samples""")
def q_library_roots(spark, sf_dir):
    """J3, join form: whether each sampled process lies under a library root of a table of roots."""
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    return P.library_flag(_v(spark, sf_dir, "process_samples"), roots).select("id", "pid", "in_library")


def _push_sql() -> str:
    s = _snapshot_sql()
    for old, new in R.GPU_GAUGE_NAMES.items():
        s = s.replace(f"'{new}'", f"'{R.PUSH_GAUGE_NAMES.get(old, 'unused')}'")
    return s


def _push_snapshot_sql() -> str:
    """``_snapshot_sql`` with the push exporter's names and bounds."""
    saved = R.TPS_BUCKETS, R.TTFT_BUCKETS_MS
    names = {R.TPS_HISTOGRAM_NAME: R.PUSH_TPS_NAME, R.TTFT_HISTOGRAM_NAME: R.PUSH_TTFT_NAME,
             R.PROCESS_COUNT_NAME: R.PUSH_PROCESS_COUNT_NAME, R.PROCESS_MEMORY_NAME: R.PROCESS_MEMORY_BY_PID_NAME}
    try:
        R.TPS_BUCKETS = R.TTFT_BUCKETS_MS = R.PUSH_BUCKETS
        s = _push_sql()
    finally:
        R.TPS_BUCKETS, R.TTFT_BUCKETS_MS = saved
    for old, new in names.items():
        s = s.replace(f"'{old}", f"'{new}")
    return f"SELECT * FROM ({s}) WHERE metric NOT IN ('unused', '{R.SESSION_COUNT_NAME}')"


@register("push_snapshot", _push_snapshot_sql())
def q_push_snapshot(spark, sf_dir):
    """A14 under the push exporter's names (labels as JSON text)."""
    snap = R.push_snapshot(M.gpu_gauges(_v(spark, sf_dir, "gpu_metrics")), _sessions(spark, sf_dir), _process_events(spark, sf_dir))
    return snap.select("metric", F.to_json("labels").alias("labels"),
                       F.when(F.col("metric").endswith("_sum"), F.round("value", 6)).otherwise(F.col("value")).alias("value"))


_RANGE_TEXT = """CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '2024-01-' || lpad(CAST(event_id % 31 + 1 AS {s}), 2, '0')
  WHEN 3 THEN '2024-' || lpad(CAST(event_id % 15 AS {s}), 2, '0') || '-10T00:00:00Z' WHEN 4 THEN '2024-02-' || lpad(CAST(event_id % 33 AS {s}), 2, '0') || 't10:59:59.123456789z'
  WHEN 5 THEN '2024-01-10 ' || lpad(CAST(event_id % 27 AS {s}), 2, '0') || ':00:00+02:00' WHEN 6 THEN '2024-01-10T00:' || lpad(CAST(event_id % 64 AS {s}), 2, '0') || ':00-11:30'
  WHEN 7 THEN '2024-01-10T00:00:00' ELSE '2024-01-10T00:00:00.5Z' END"""


def _range_ok(c: str) -> str:
    part = lambda n: f"TRY_CAST(nullif(regexp_extract({c}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})[Tt ](\\d{{2}}):(\\d{{2}}):(\\d{{2}})(?:\\.\\d+)?(?:[Zz]|[+-](\\d{{2}}):(\\d{{2}}))$', {n}), '') AS"
    return (f"coalesce({part(1)} DATE) IS NOT NULL AND {part(2)} INT) < 24 AND {part(3)} INT) < 60 AND {part(4)} INT) < 60 "
            f"AND coalesce({part(5)} INT), 0) < 24 AND coalesce({part(6)} INT), 0) < 60, false)")


@register("range_check", f"""
SELECT id, CASE WHEN NOT {_range_ok('start_text')} THEN 'Invalid start format' WHEN NOT {_range_ok('end_text')} THEN 'Invalid end format' END AS error
FROM (SELECT event_id AS id, {_RANGE_TEXT.format(s='VARCHAR')} AS start_text,
  {_RANGE_TEXT.format(s='VARCHAR').replace('event_id %', '(event_id // 9) %')} AS end_text FROM events)""")
def q_range_check(spark, sf_dir):
    """P10 on data: a table of text ranges, each accepted or rejected with the argument's name."""
    text = _RANGE_TEXT.format(s="STRING")
    ranges = fixtures.table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{text} AS start_text", f"{text.replace('event_id %', '(event_id DIV 9) %')} AS end_text")
    return ranges.select("id", display.range_error("start_text", "end_text").alias("error"))


def _late(df: DataFrame, column: str) -> DataFrame:
    """Rows of three landings (column ``_file`` 0 to 2) in which every third comes long after its time."""
    return df.withColumn("_file", F.when(F.pmod(F.xxhash64(*df.columns), 3) == 0, 2).when(F.dayofmonth(column) < 16, 0).otherwise(1))


def _exported(spark, name: str, rows: DataFrame, column: str, make) -> DataFrame:
    """The rows in three landings, streamed a landing at a time into an export table, folded once on the way."""
    base = _scratch(spark, name)
    _stage(_late(rows, column), base)
    export = make(f"{base}/export")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/rows/*")
    for n in range(3):
        _land(spark, base, n)
        query = EX.start_export(stream, export.table, export.part, f"{base}/checkpoint", available_now=True)
        query.awaitTermination()
        if query.exception() is not None:
            raise RuntimeError(str(query.exception()))
        if n == 1:
            export.table.fold()
    return export.read()


from fleetlens.streaming import exports as EX  # noqa: E402


@register("export_process_10s_late", ORACLES["export_process_10s"])
def q_export_process_10s_late(spark, sf_dir):
    """R5 under streaming with late rows: process gauges per period, corrected by what lands later."""
    rows = _process_events(spark, sf_dir)
    return _exported(spark, "late-p", rows, "timestamp", lambda path: EX.ProcessExport(spark, path)).drop("host")


@register("export_10s_late", ORACLES["export_10s"])
def q_export_10s_late(spark, sf_dir):
    """R5 under streaming with late rows: the last GPU gauges per period, corrected by what lands later."""
    rows = _gpu_metrics_typed(spark, sf_dir)
    return _exported(spark, "late-g", rows, "timestamp", lambda path: EX.GaugeExport(spark, path)).drop("host")


@register("export_tokens_10s_late", ORACLES["export_tokens_10s"])
def q_export_tokens_10s_late(spark, sf_dir):
    """R5 under streaming with late rows: token and session counters per period."""
    return _exported(spark, "late-t", _sessions(spark, sf_dir), "end_time", lambda path: EX.CounterExport(spark, path))
