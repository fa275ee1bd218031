"""GPU sources: probe CSV lines (S1), device samples (S2) and their process lists (S3).

All parsing is column expressions, so a text or Parquet scan of landed data is
one map-only stage.  Rows the reference would drop are dropped, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.gpu import MIB, int_div
from fleetlens.schemas import DEVICE_SAMPLES

#: Largest value of the reference readings' unsigned 32-bit type.
U32_MAX = 4294967295

# Field order of a probe line (fixed).
CSV_FIELDS = ("index", "name", "utilization_gpu", "utilization_memory", "memory_used_mib",
              "memory_total_mib", "temperature", "power_draw")

_UINT_RE = r"^\+?[0-9]+$"
_FLOAT_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL_FLOAT_RE = r"^[+-]?(?i)(inf|infinity|nan)$"


def unicode_trim(c: Column) -> Column:
    """Strip leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_uint(text: Column, most: int | None = None) -> Column:
    """Unsigned integer text (optional ``+``, digits only) to BIGINT; null when
    malformed, beyond BIGINT (``try_cast``) or above ``most``."""
    value = text.try_cast("long")
    ok = text.rlike(_UINT_RE)
    return F.when(ok if most is None else ok & (value <= F.lit(most)), value)


def parse_float_truncated(text: Column) -> Column:
    """Float text to a non-negative whole number, as a saturating float-to-
    unsigned cast: fraction dropped, negatives and NaN to 0; saturates at the
    unsigned 32-bit range.  Null when the text is not a float."""
    ok = text.rlike(_FLOAT_RE) | text.rlike(_SPECIAL_FLOAT_RE)
    # The guard stays outside: greatest() skips nulls and would turn a bad field into 0.
    clamped = F.least(F.greatest(F.floor(F.nanvl(text.try_cast("double"), F.lit(0.0))), F.lit(0)), F.lit(U32_MAX))
    return F.when(ok, clamped.cast("long"))


def parse_gpu_csv(lines: DataFrame, value: str = "value", timestamp: Column | None = None) -> DataFrame:
    """Probe CSV lines to gpu_metrics rows.

    Fields are split on ``,`` and trimmed; fewer than 8 fields drops the line,
    extra fields are ignored; any unparsable or out-of-range number drops the
    line (index, utilisation and temperature must fit unsigned 32 bits, memory in
    bytes BIGINT).  Memory is MiB (times 1048576 for bytes), power a float truncated
    to whole watts.
    Other input columns are carried through; ``timestamp`` defaults to the
    current time (the read time), as the probe has no clock of its own.
    """
    carried = [c for c in lines.columns if c != value]
    # The split is its own projection so that every field reads it instead of re-splitting.
    split = lines.select(*carried, F.transform(F.split(F.col(value), ","), lambda x: unicode_trim(x)).alias("_parts"))
    parts = F.col("_parts")
    fld = [F.get(parts, i) for i in range(8)]
    gpu_id, util_g, util_m, temp = (parse_uint(fld[i], U32_MAX) for i in (0, 2, 3, 6))
    mem_used = F.try_multiply(parse_uint(fld[4]), F.lit(MIB).cast("long"))
    mem_total = F.try_multiply(parse_uint(fld[5]), F.lit(MIB).cast("long"))
    power = parse_float_truncated(fld[7])
    ts = timestamp if timestamp is not None else F.current_timestamp()
    out = split.select(
        *carried,
        F.size(parts).alias("_n"),
        ts.alias("timestamp"),
        gpu_id.alias("gpu_id"),
        fld[1].alias("name"),
        util_g.alias("utilization_gpu"),
        util_m.alias("utilization_memory"),
        mem_used.alias("memory_used"),
        mem_total.alias("memory_total"),
        temp.alias("temperature"),
        power.alias("power_usage"),
    )
    required = ["gpu_id", "utilization_gpu", "utilization_memory", "memory_used", "memory_total",
                "temperature", "power_usage"]
    cond = F.col("_n") >= 8
    for c in required:
        cond = cond & F.col(c).isNotNull()
    return out.where(cond).drop("_n")


def read_gpu_csv(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """S1 over landed text files (one probe line per line); batch or stream."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.schema("value STRING").text(path) if streaming else reader.text(path)
    return parse_gpu_csv(lines)


def normalise_device_samples(raw: DataFrame) -> DataFrame:
    """Device samples to gpu_metrics rows.

    Missing name -> ``GPU {index}``; missing temperature -> 0; power mW -> W by
    integer division, missing -> 0; a device missing utilisation or memory is
    skipped (the other devices of the tick are kept).
    """
    keep = (F.col("utilization_gpu").isNotNull() & F.col("utilization_memory").isNotNull()
            & F.col("memory_used").isNotNull() & F.col("memory_total").isNotNull())
    carried = [c for c in raw.columns if c not in DEVICE_SAMPLES.fieldNames()]
    return raw.where(keep).select(
        *carried,
        "timestamp",
        F.col("gpu_index").cast("long").alias("gpu_id"),
        F.coalesce(F.col("name"), F.concat(F.lit("GPU "), F.col("gpu_index").cast("string"))).alias("name"),
        F.col("utilization_gpu").cast("long").alias("utilization_gpu"),
        F.col("utilization_memory").cast("long").alias("utilization_memory"),
        F.col("memory_used").cast("long").alias("memory_used"),
        F.col("memory_total").cast("long").alias("memory_total"),
        F.coalesce(F.col("temperature"), F.lit(0)).cast("long").alias("temperature"),
        F.coalesce(int_div("power_mw", 1000), F.lit(0)).cast("long").alias("power_usage"),
    )


def gpu_process_list(raw: DataFrame) -> DataFrame:
    """S3: the sample's process list: compute list followed by graphics list
    (bag union, a pid in both appears twice), unavailable memory -> 0, unknown
    name -> ``pid_{pid}``, sorted by memory descending (stable)."""
    empty = F.array().cast("array<struct<pid:bigint,name:string,used_gpu_memory:bigint>>")
    both = F.concat(F.coalesce(F.col("compute_processes"), empty), F.coalesce(F.col("graphics_processes"), empty))
    fixed = F.transform(both, lambda p: F.struct(
        p["pid"].alias("pid"),
        F.coalesce(p["name"], F.concat(F.lit("pid_"), p["pid"].cast("string"))).alias("name"),
        F.coalesce(p["used_gpu_memory"], F.lit(0).cast("long")).alias("used_gpu_memory")))
    by_mem_desc = F.array_sort(fixed, lambda a, b: F.when(a["used_gpu_memory"] > b["used_gpu_memory"], -1)
                               .when(a["used_gpu_memory"] < b["used_gpu_memory"], 1).otherwise(0))
    return raw.withColumn("processes", by_mem_desc)


def device_metrics_with_processes(raw: DataFrame) -> DataFrame:
    """S2 + S3: gpu_metrics rows carrying their sorted ``processes`` array."""
    return normalise_device_samples(gpu_process_list(raw).withColumnRenamed("processes", "_procs")) \
        .withColumnRenamed("_procs", "processes")
