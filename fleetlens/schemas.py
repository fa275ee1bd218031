"""Explicit schemas of the stored tables and the landed inputs.

Nothing is inferred anywhere: readers pass these schemas.  ``host`` is optional
on every stored table (pid and gpu_id are only unique per host); operators take
the key columns as an argument, and ``HOST_SAMPLES`` / ``PROCESS_SNAPSHOTS`` are
the landed inputs of a fleet.
"""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _s(*fields):
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


GPU_PROCESS = _s(
    ("pid", LongType(), False),
    ("name", StringType(), True),
    ("used_gpu_memory", LongType(), True),
)

# One row per (gpu, tick).
GPU_METRICS = _s(
    ("id", LongType(), True),
    ("timestamp", TimestampType(), False),
    ("gpu_id", LongType(), False),
    ("name", StringType(), False),
    ("utilization_gpu", LongType(), False),
    ("utilization_memory", LongType(), False),
    ("memory_used", LongType(), False),
    ("memory_total", LongType(), False),
    ("temperature", LongType(), False),
    ("power_usage", LongType(), False),
)

# One row per (gpu, tick, process): the flattened process lists of the samples.
PROCESS_SAMPLES = _s(
    ("id", LongType(), True),
    ("timestamp", TimestampType(), False),
    ("gpu_id", LongType(), False),
    ("pid", LongType(), False),
    ("name", StringType(), True),
    ("command_line", StringType(), True),
    ("exe_path", StringType(), True),
    ("used_gpu_memory", LongType(), True),
    ("gpu_utilization", LongType(), True),
)

# The OS process table the samples are joined with.
OS_PROCESSES = _s(
    ("pid", LongType(), False),
    ("name", StringType(), True),
    ("command_line", StringType(), True),
    ("exe_path", StringType(), True),
)

PROCESS_EVENTS = _s(
    ("timestamp", TimestampType(), False),
    ("pid", LongType(), False),
    ("name", StringType(), False),
    ("category", StringType(), False),
    ("gpu_memory_mb", LongType(), False),
    ("gpu_utilization", LongType(), False),
    ("command_line", StringType(), True),
    ("exe_path", StringType(), True),
    ("duration_secs", LongType(), False),
)

# Streamed response chunks, already parsed (see sources.chunks).
LLM_CHUNKS = _s(
    ("session_id", StringType(), False),
    ("seq", LongType(), False),
    ("arrival_ts", TimestampType(), False),
    ("model", StringType(), False),
    ("response", StringType(), True),
    ("eval_count", LongType(), True),
    ("eval_duration", LongType(), True),
    ("prompt_eval_count", LongType(), True),
    ("done", BooleanType(), False),
)

LLM_SESSIONS = _s(
    ("id", StringType(), False),
    ("start_time", TimestampType(), False),
    ("end_time", TimestampType(), True),
    ("model", StringType(), False),
    ("prompt_tokens", LongType(), False),
    ("completion_tokens", LongType(), False),
    ("total_tokens", LongType(), False),
    ("tokens_per_second", DoubleType(), False),
    ("time_to_first_token_ms", LongType(), True),
    ("time_per_output_token_ms", DoubleType(), True),
)

WEEKLY_SUMMARIES = _s(
    ("week_start", DateType(), False),
    ("week_end", DateType(), False),
    ("category", StringType(), False),
    ("total_duration_secs", LongType(), False),
    ("avg_gpu_utilization", DoubleType(), False),
    ("max_gpu_utilization", LongType(), False),
    ("total_gpu_memory_mb", LongType(), False),
    ("event_count", LongType(), False),
)

ARCHIVE_LOG = _s(
    ("archive_date", DateType(), False),
    ("table_name", StringType(), False),
    ("records_archived", LongType(), False),
    ("parquet_file", StringType(), False),
)

# Long-form metric snapshot (gauges, counters, histogram series).
METRIC_SNAPSHOT = _s(
    ("metric", StringType(), False),
    ("labels", MapType(StringType(), StringType()), False),
    ("value", DoubleType(), False),
)

# Raw inputs landed by collectors.
TEXT_LINES = _s(("value", StringType(), True))

DEVICE_SAMPLES = _s(
    ("timestamp", TimestampType(), False),
    ("gpu_index", LongType(), False),
    ("name", StringType(), True),
    ("utilization_gpu", LongType(), True),
    ("utilization_memory", LongType(), True),
    ("memory_used", LongType(), True),
    ("memory_total", LongType(), True),
    ("temperature", LongType(), True),
    ("power_mw", LongType(), True),
    ("compute_processes", ArrayType(GPU_PROCESS), True),
    ("graphics_processes", ArrayType(GPU_PROCESS), True),
)

# Fleet form of the landed samples: the host, and the poll that read the devices (each device stamps its
# own clock, so a poll is not a time).
HOST_SAMPLES = StructType([*DEVICE_SAMPLES.fields, StructField("host", StringType(), False),
                           StructField("poll_id", LongType(), False)])

# The OS process table as of each poll.
PROCESS_SNAPSHOTS = StructType([*OS_PROCESSES.fields, StructField("host", StringType(), False),
                                StructField("poll_id", LongType(), False)])

RAW_CHUNKS = _s(
    ("session_id", StringType(), False),
    ("seq", LongType(), False),
    ("arrival_ts", TimestampType(), False),
    ("chunk", BinaryType(), True),
)

REQUEST_LOG = _s(
    ("request_key", StringType(), False),
    ("ts", TimestampType(), False),
    ("path", StringType(), True),
    ("status", IntegerType(), True),
    ("body", BinaryType(), True),
)

MODEL_SNAPSHOTS = _s(
    ("ts", TimestampType(), False),
    ("status", IntegerType(), True),
    ("body", StringType(), True),
)

WORKLOAD_CATEGORIES = ("gaming", "llm_inference", "ml_training", "general_compute")

# A1's state per batch of an ingest table (partition columns left out).
WEEKLY_PARTS = _s(
    ("week_start", DateType(), True),
    ("category", StringType(), True),
    ("events", LongType(), True),
    ("utilization", LongType(), True),
    ("measured", LongType(), True),
    ("peak", LongType(), True),
    ("memory_mb", LongType(), True),
    ("duration_secs", LongType(), True),
)
