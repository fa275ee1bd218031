"""Stored data: RFC 3339 text times (S9) and Parquet archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RFC3339_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339_to_timestamp(text) -> Column:
    """RFC 3339 text to TIMESTAMP (UTC instant), null when not RFC 3339.

    The pattern guard matters: a plain cast also accepts ``2024-01-01`` or a
    time without offset."""
    t = F.col(text) if isinstance(text, str) else text
    norm = F.regexp_replace(F.regexp_replace(t, "[Tt ]", "T"), "[Zz]$", "+00:00")
    norm = F.regexp_replace(norm, r"(\.[0-9]{6})[0-9]+", "$1")      # finer than a microsecond: truncated
    return F.when(t.rlike(RFC3339_RE), norm.try_cast("timestamp"))


def parse_stored_times(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Parse text time columns; a bad required time drops the row, a bad
    optional time becomes null."""
    out = df
    for c in list(required) + list(optional):
        out = out.withColumn(c, rfc3339_to_timestamp(c))
    for c in required:
        out = out.where(F.col(c).isNotNull())
    return out


def read_archive(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """An archived table back as a DataFrame (explicit schema, no inference)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)
