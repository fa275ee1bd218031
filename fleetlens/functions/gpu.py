"""Column functions over GPU metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1048576

# Severity bounds (strictly greater than) per metric: (critical, warning).
SEVERITY_BOUNDS = {
    "temperature": (85, 70),
    "utilization_gpu": (95, 80),
    "memory_percent": (90, 75),
}
# Gauge full-scale per metric.
GAUGE_MAX = {
    "utilization_gpu": 100.0,
    "memory_percent": 100.0,
    "temperature": 100.0,
    "power_usage": 350.0,
}


def memory_percent(used="memory_used", total="memory_total") -> Column:
    """used / total * 100, and 0.0 when total is 0."""
    u, t = F.col(used) if isinstance(used, str) else used, F.col(total) if isinstance(total, str) else total
    return F.when(t > 0, u.cast("double") / t.cast("double") * 100.0).otherwise(F.lit(0.0))


def memory_view(df: DataFrame) -> DataFrame:
    """Add memory_used_mb, memory_total_mb (bytes / 1048576.0) and memory_percent."""
    return df.select(
        "*",
        (F.col("memory_used") / float(MIB)).alias("memory_used_mb"),
        (F.col("memory_total") / float(MIB)).alias("memory_total_mb"),
        memory_percent().alias("memory_percent"),
    )


def severity(value: Column, critical: float, warning: float) -> Column:
    """``critical`` above the first bound, ``warning`` above the second, else ``ok``."""
    return F.when(value > critical, F.lit("critical")).when(value > warning, F.lit("warning")).otherwise(F.lit("ok"))


def severity_levels(df: DataFrame) -> DataFrame:
    """P3 for temperature, utilisation and memory percent (needs ``memory_percent``)."""
    return df.select(
        "*",
        *[severity(F.col(m), c, w).alias(f"{m}_level") for m, (c, w) in SEVERITY_BOUNDS.items()],
    )


def gauge_fill(value: Column, full_scale: float) -> Column:
    """P5: min(value / max * 100, 100)."""
    return F.least(value.cast("double") / F.lit(full_scale) * 100.0, F.lit(100.0))


def gauge_fills(df: DataFrame) -> DataFrame:
    """P5 for the four gauges (needs ``memory_percent``)."""
    return df.select("*", *[gauge_fill(F.col(m), mx).alias(f"{m}_fill") for m, mx in GAUGE_MAX.items()])


def int_div(col, divisor: int) -> Column:
    """Integer division (SQL ``div``), exact on BIGINT."""
    c = F.col(col) if isinstance(col, str) else col
    return F.call_function("div", c.cast("long"), F.lit(divisor).cast("long"))


def bytes_to_mib(col) -> Column:
    """Whole MiB by integer division."""
    return int_div(col, MIB)


def mib_to_bytes(col) -> Column:
    """MiB to bytes."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long") * F.lit(MIB)
