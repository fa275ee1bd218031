"""Time filters that prune: the predicate on the time column reaches the Parquet
reader (row-group statistics), and on tables written by ``fleetlens.sinks``
(partitioned by the UTC date of the time column) a redundant bound on the
partition column skips whole days of files.  Spark does not derive partition
filters from a predicate on a data column, so the bound is added explicitly.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.display import as_instant, ts_literal

# Partition column written next to each time column by the sinks.
PARTITION_OF = {"timestamp": "date", "start_time": "start_date"}


def _day(value, argument: str) -> _dt.date:
    return as_instant(value, argument).astimezone(_dt.timezone.utc).date()


def time_filter(df: DataFrame, ts: str, start=None, end=None, end_inclusive: bool = True,
                start_inclusive: bool = True) -> DataFrame:
    """Rows with ``start <= ts`` and ``ts <= end`` (or ``< end``); either bound optional.

    Bounds are validated instants (RFC 3339 text or datetimes) turned into
    literals, so the filter is pushed to the scan."""
    cond: Column = F.lit(True)
    part = PARTITION_OF.get(ts)
    has_part = part is not None and part in df.columns
    if start is not None:
        s = ts_literal(start, "start")
        cond = cond & ((F.col(ts) >= s) if start_inclusive else (F.col(ts) > s))
        if has_part:
            cond = cond & (F.col(part) >= F.lit(_day(start, "start")))
    if end is not None:
        e = ts_literal(end, "end")
        cond = cond & ((F.col(ts) <= e) if end_inclusive else (F.col(ts) < e))
        if has_part:
            cond = cond & (F.col(part) <= F.lit(_day(end, "end")))
    return df.where(cond)


def before_date(df: DataFrame, ts: str, cutoff: _dt.date) -> Column:
    """``DATE(ts) < cutoff`` in sargable form, plus the partition bound when present."""
    midnight = _dt.datetime(cutoff.year, cutoff.month, cutoff.day, tzinfo=_dt.timezone.utc)
    cond = F.col(ts) < ts_literal(midnight)
    part = PARTITION_OF.get(ts)
    if part is not None and part in df.columns:
        cond = cond & (F.col(part) < F.lit(cutoff))
    return cond
