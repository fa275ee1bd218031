"""Test inputs derived by SQL from the driver's tables (FIXTURES.md, part B).

The statements are shared between Spark (``views``) and DuckDB (``duckdb_ctes``):
Spark receives the base tables as DataFrame arguments, DuckDB the registered
views of the same names.  They only reshape rows into the schemas the jobs
expect; none of the jobs' work happens here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

GPU_METRICS_SQL = """
SELECT event_id AS id, ts AS `timestamp`,
  CAST(user_id % 4 AS INT) AS gpu_id, concat('GPU ', CAST(user_id % 4 AS STRING)) AS name,
  CAST(floor(least(value, 100.0)) AS INT) AS utilization_gpu,
  CAST(CAST(floor(value * 7) AS BIGINT) % 101 AS INT) AS utilization_memory,
  CASE WHEN event_id % 97 = 0 THEN CAST(0 AS BIGINT)
       ELSE 85899345 * (1 + user_id % 4) * CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) END AS memory_used,
  CASE WHEN event_id % 97 = 0 THEN CAST(0 AS BIGINT) ELSE 8589934592 * (1 + user_id % 4) END AS memory_total,
  CAST(30 + (CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 13) % 66 AS INT) AS temperature,
  CAST(floor(value * 3) AS INT) AS power_usage
FROM {events}
"""

PROCESS_SAMPLES_SQL = """
SELECT event_id AS id, ts AS `timestamp`, CAST(event_id % 4 AS INT) AS gpu_id, user_id AS pid,
  CASE event_type WHEN 'click' THEN 'ollama' WHEN 'view' THEN 'python3' WHEN 'purchase' THEN 'python3'
       WHEN 'signup' THEN 'Racer-Vulkan.EXE' ELSE 'blender' END AS name,
  CASE event_type WHEN 'click' THEN '/usr/bin/ollama serve' WHEN 'view' THEN 'python3 train.py --epochs 10'
       WHEN 'purchase' THEN 'python3 inference.py --model llama --generate'
       WHEN 'signup' THEN 'Racer-Vulkan.EXE' ELSE 'blender -b scene' END AS command_line,
  CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN '/opt/lib/common/racer/Racer-Vulkan.EXE'
       WHEN event_type = 'error' AND event_id % 3 = 0 THEN '/opt/lib/commonX/blender'
       WHEN event_type = 'error' AND event_id % 3 = 1 THEN '/home/u/MyGames/tool'
       WHEN event_type = 'error' THEN '/usr/bin/blender' ELSE CAST(NULL AS STRING) END AS exe_path,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 104857600 AS used_gpu_memory,
  CAST(floor(least(value, 100.0)) AS INT) AS gpu_utilization
FROM {events}
"""

OS_PROCESSES_SQL = """
SELECT DISTINCT user_id AS pid,
  CASE user_id % 4 WHEN 0 THEN 'ollama' WHEN 1 THEN 'python3' WHEN 2 THEN 'Racer.exe' ELSE 'blender' END AS name,
  CASE user_id % 4 WHEN 0 THEN 'ollama serve' WHEN 1 THEN 'python3 -m torch.distributed' WHEN 2 THEN 'Racer.exe' ELSE 'blender -b' END AS command_line,
  CASE user_id % 4 WHEN 3 THEN '/opt/lib/common/blender' ELSE CAST(NULL AS STRING) END AS exe_path
FROM {events} WHERE user_id % 10 <> 0
"""

LLM_CHUNKS_SQL = """
SELECT concat('s', CAST(conv_id AS STRING)) AS session_id, turn AS seq,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * conv_id + INTERVAL '1' SECOND * turn AS arrival_ts,
  CASE conv_id % 3 WHEN 0 THEN 'llama2:7b' WHEN 1 THEN 'qwen2:0.5b' ELSE 'mistral:7b' END AS model,
  CASE WHEN role = 'assistant' THEN text ELSE CAST(NULL AS STRING) END AS response,
  CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS eval_count,
  CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) * 10000000 + turn * 1000000 ELSE CAST(NULL AS BIGINT) END AS eval_duration,
  CASE WHEN role <> 'assistant' THEN CAST(length(text) AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS prompt_eval_count,
  turn = max(turn) OVER (PARTITION BY conv_id) AS done
FROM {conversations}
"""

VIEWS = {
    "gpu_metrics": (GPU_METRICS_SQL, "events"),
    "process_samples": (PROCESS_SAMPLES_SQL, "events"),
    "os_processes": (OS_PROCESSES_SQL, "events"),
    "llm_chunks": (LLM_CHUNKS_SQL, "conversations"),
}

# Fixed library root of the fixture (FIXTURES.md, process_samples).
FIXTURE_LIBRARY_ROOTS = ("/opt/lib/common",)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, read with an explicit schema (inferred once per path; the
    driver's tables are read-only), so a read lists files without a footer job."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        schema = _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(path)


def _to_ltz(df: DataFrame) -> DataFrame:
    """Parquet times arrive as TIMESTAMP_NTZ; the library works on TIMESTAMP (UTC)."""
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived fixture view as a DataFrame with TIMESTAMP (UTC) times."""
    sql, base = VIEWS[name]
    df = spark.sql(sql, **{base: table(spark, sf_dir, base)})
    return _to_ltz(df)


def duckdb_cte(*names: str) -> str:
    """``WITH`` clause defining the named views for DuckDB over its registered tables."""
    parts = []
    for name in names:
        sql, base = VIEWS[name]
        body = sql.replace("`timestamp`", '"timestamp"').format(**{base: base})
        parts.append(f"{name} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
