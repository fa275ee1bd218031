"""Order-dependent series operators: position in series, downsampling (W1), trend.

A device's series can be arbitrarily long and one device may hold a large share
of all rows, so no operator here runs a window over a whole device.  Positions
are computed in two levels:

1. rows are cut into (device, block) groups that follow the order of the series:
   fixed time slices, of which those with more than ``DEFAULT_BLOCK_ROWS`` rows
   (a burst, one bad clock, equal or missing times) are cut again into seconds,
   and such seconds into single times and ranges of the tie-break; a per-block
   row count is a partial aggregation (map-side combine), so a hot device costs
   nothing extra;
2. a running sum over the small per-block count table gives each block's offset;
3. ``row_number`` runs per (device, block) — bounded by the block size — and
   the offset is added.

The join of rows with offsets and the per-block window share one hash
partitioning on (device, block), so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import config

DEFAULT_BLOCK_SECONDS = 3600
# A slice with more rows than this is cut into finer blocks, however the rows lie in it.
DEFAULT_BLOCK_ROWS = 1_000_000
BLOCK_COLUMNS = ("_fl_blk", "_fl_sec", "_fl_us", "_fl_tie")

# Chart point budget by time range (hours): <=1 h, <=6 h, longer.
def max_points_for_range(hours: float) -> int:
    return 200 if hours <= 1 else 300 if hours <= 6 else 400


def _ord_cols(ts: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(ts)] + [F.col(t) for t in tiebreak]


def _non_null_default(dtype) -> Column:
    name = dtype.typeName()
    if name in ("string", "varchar", "char"):
        return F.lit("")
    if name == "boolean":
        return F.lit(False)
    if name == "date":
        return F.to_date(F.lit("1970-01-01"))
    if name in ("timestamp", "timestamp_ntz"):
        return F.lit(0).cast("timestamp").cast(dtype)
    if name in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.lit(0).cast(dtype)
    raise TypeError(f"unsupported key type {dtype.simpleString()}")


def with_blocks(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str],
                block_seconds: int = DEFAULT_BLOCK_SECONDS, block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``df`` with the helper columns ``partitioning_columns(keys)``: key columns without nulls (a null key is
    a group of its own) and a block id whose order is that of (ts, first tie-break).  Null times sort first.

    Blocks are ``block_seconds`` wide.  With ``block_rows``, a block above it is cut into its seconds, and a
    second above it into single microseconds and ranges of ``block_rows`` values of the first tie-break (if
    that is a whole number, such as an id).  The tables of blocks above the bound have at most one row per
    ``block_rows`` rows of ``df``; they are looked for when the plan is built, and broadcast if there are any,
    so the rows are not shuffled for this.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    q, least = f"`{ts}`", -(2 ** 63)
    helpers = {}
    for i, k in enumerate(keys):
        helpers[f"_fl_k{i}"] = F.coalesce(F.col(k), _non_null_default(types[k]))
        helpers[f"_fl_n{i}"] = F.col(k).isNull()
    blk, sec, us, tie = BLOCK_COLUMNS
    rows = df.withColumns(helpers | {blk: F.expr(f"coalesce(CAST(floor(unix_micros({q}) / {int(block_seconds) * 1_000_000}) AS BIGINT), {least}L)")})
    zero = F.lit(0).cast("long")
    if not block_rows:
        return rows.withColumns({sec: zero, us: zero, tie: zero})
    group = list(helpers)

    def above(part: DataFrame, by: list[str]) -> DataFrame | None:
        """The overfull blocks, found now (one pass over key and time) so that the plan has no trace of
        them where there are none."""
        config.checkpoint_dir(part.sparkSession)
        large = part.groupBy(*by).agg(F.expr("count(1)").alias("_fl_cnt")).where(F.col("_fl_cnt") > block_rows)
        large = large.select(*by, F.lit(True).alias("_fl_dense")).checkpoint()
        return None if large.isEmpty() else F.broadcast(large)

    dense = above(rows, [*group, blk])
    if dense is None:
        return rows.withColumns({sec: zero, us: zero, tie: zero})
    seconds = F.expr(f"coalesce(CAST(floor(unix_micros({q}) / 1000000) AS BIGINT), {least}L)")
    inside = rows.join(dense, [*group, blk]).withColumn(sec, seconds)
    rows = rows.join(dense, [*group, blk], "left").withColumn(sec, F.when(F.col("_fl_dense"), seconds).otherwise(zero)).drop("_fl_dense")
    dense = above(inside, [*group, blk, sec])
    if dense is None:
        return rows.withColumns({us: zero, tie: zero})
    whole = bool(tiebreak) and types[tiebreak[0]].typeName() in ("byte", "short", "integer", "long")
    span = F.expr(f"coalesce(CAST(floor(`{tiebreak[0]}` / {int(block_rows)}) AS BIGINT), {least}L)") if whole else zero
    rows = rows.join(dense, [*group, blk, sec], "left")
    return rows.withColumns({us: F.when(F.col("_fl_dense"), F.expr(f"coalesce(unix_micros({q}), {least}L)")).otherwise(zero),
                             tie: F.when(F.col("_fl_dense"), span).otherwise(zero)}).drop("_fl_dense")


def prefix_sum(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str], weight: Column | None = None,
               block_seconds: int = DEFAULT_BLOCK_SECONDS, out: str = "prefix", total: str | None = None,
               keep_partitioning: bool = False, block_rows: int | None = DEFAULT_BLOCK_ROWS,
               need: str | None = None) -> DataFrame:
    """Add, for every row, the sum of ``weight`` over the rows of its key group
    strictly before it in (ts, *tiebreak) order (``weight`` None counts rows),
    and optionally the group total.

    Two levels, so no window ever spans a whole key group: per (key, block)
    sums are a partial aggregate; a running sum over that small table gives each
    block's offset; the in-block part is a window per (key, block).  Blocks are
    those of ``with_blocks``.  Every grouping, the join and the windows use its
    helper columns, so the join and the in-block window share one partitioning
    and the rows are shuffled once.  ``keep_partitioning`` keeps those columns
    (``partitioning_columns``) so a following aggregate on a superset of them
    needs no exchange.  ``need`` is a condition on a block (``_fl_off``, the sum
    before it, ``_fl_cnt``, its own, and the total): rows of other blocks leave
    before the window.
    """
    keys = list(keys)
    q = lambda c: f"`{c}`"
    if weight is not None:
        df = df.withColumn("_fl_w", weight.cast("long"))
    rows = with_blocks(df, keys, ts, tiebreak, block_seconds, block_rows)
    part = partitioning_columns(keys)
    group, blocks = part[:-len(BLOCK_COLUMNS)], list(BLOCK_COLUMNS)
    by_key, by_block = ", ".join(group), ", ".join(blocks)
    per_block = "sum(_fl_w)" if weight is not None else "count(1)"
    counts = rows.groupBy(*part).agg(F.expr(per_block).alias("_fl_cnt"))
    offset_cols = [f"CAST(coalesce(sum(_fl_cnt) OVER (PARTITION BY {by_key} ORDER BY {by_block} "
                   f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS _fl_off"]
    if total:
        offset_cols.append(f"CAST(sum(_fl_cnt) OVER (PARTITION BY {by_key}) AS BIGINT) AS {q(total)}")
    offsets = counts.selectExpr(*part, *offset_cols, *(["_fl_cnt"] if need else []))
    if need:
        offsets = offsets.where(need).drop("_fl_cnt")
    order = ", ".join(q(c) for c in [ts, *tiebreak])
    in_block = f"PARTITION BY {', '.join(part)} ORDER BY {order}"
    local = (f"row_number() OVER ({in_block}) - 1" if weight is None else
             f"coalesce(sum(_fl_w) OVER ({in_block} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    out_df = (rows.join(offsets, part)
              .withColumn(out, F.expr(f"CAST(_fl_off + {local} AS BIGINT)"))
              .drop("_fl_off"))
    if not keep_partitioning:
        out_df = out_df.drop(*part)
    return out_df.drop("_fl_w") if weight is not None else out_df


def partitioning_columns(keys: Sequence[str]) -> list[str]:
    """The helper columns of ``with_blocks``: ``prefix_sum(keep_partitioning=True)`` leaves the rows
    hash-partitioned on exactly these."""
    return [c for i in range(len(keys)) for c in (f"_fl_k{i}", f"_fl_n{i}")] + list(BLOCK_COLUMNS)


def ordered_index(df: DataFrame, keys: Sequence[str] = ("gpu_id",), ts: str = "timestamp",
                  tiebreak: Sequence[str] = ("id",), block_seconds: int = DEFAULT_BLOCK_SECONDS,
                  index: str = "idx", size: str = "n", block_rows: int | None = DEFAULT_BLOCK_ROWS,
                  need: str | None = None) -> DataFrame:
    """Add the 0-based position of each row within its key group, ordered by
    (ts, *tiebreak), and the group size.  Blocks are ``block_seconds`` wide, those above
    ``block_rows`` rows cut finer; pass ``block_rows=None`` to leave them whole."""
    return prefix_sum(df, keys, ts, tiebreak, None, block_seconds, out=index, total=size, block_rows=block_rows, need=need)


def downsample(df: DataFrame, max_points: int, keys: Sequence[str] = ("gpu_id",), ts: str = "timestamp",
               tiebreak: Sequence[str] = ("id",), block_seconds: int = DEFAULT_BLOCK_SECONDS,
               block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Per key, all rows when n <= max_points; else rows whose 0-based
    position is a multiple of ceil(n / max_points)."""
    ix = ordered_index(df, keys, ts, tiebreak, block_seconds, block_rows=block_rows)
    step = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / F.lit(float(max_points))).cast("long"))
    return ix.where((F.col("n") <= max_points) | (F.col("idx") % step == 0))


# Recent / previous sample size = max(5, floor(n * 0.1)); +-5 % change bands.
TREND_MIN_SAMPLE = 5
TREND_FRACTION = 0.1
TREND_BAND = 5.0


def trend(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("gpu_id",), ts: str = "timestamp",
          tiebreak: Sequence[str] = ("id",), block_seconds: int = DEFAULT_BLOCK_SECONDS,
          block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Compare the mean of the last s values with the mean of the s before.

    One row per (key, metric): sample_size, recent_avg, previous_avg (the recent
    mean when there is no previous value), change_percent (0 when previous_avg
    is not above 0) and trend (up above +5 %, down below -5 %, else neutral).
    The aggregation is a plain grouped aggregate over the indexed rows.
    """
    keys = list(keys)
    sample = f"greatest({TREND_MIN_SAMPLE}L, CAST(floor(n * {TREND_FRACTION}D) AS BIGINT))"
    # Only blocks that reach into the last two samples are numbered.
    ix = ordered_index(df, keys, ts, tiebreak, block_seconds, block_rows=block_rows, need=f"_fl_off + _fl_cnt > n - 2 * {sample}")
    # s = max(5, floor(n * 0.1)), in double arithmetic as the reference computes it.
    ix = ix.withColumn("_s", F.expr(sample))
    recent, previous = "idx >= n - _s", "idx >= n - 2 * _s AND idx < n - _s"
    aggs = [F.max("_s").alias("sample_size")]
    for m in metrics:
        aggs += [F.expr(f"avg(CASE WHEN {recent} THEN `{m}` END)").alias(f"{m}__r"),
                 F.expr(f"avg(CASE WHEN {previous} THEN `{m}` END)").alias(f"{m}__p")]
    wide = ix.groupBy(*keys).agg(*aggs)
    stack = (f"stack({len(metrics)}, " + ", ".join(f"'{m}', `{m}__r`, `{m}__p`" for m in metrics)
             + ") AS (metric, recent_avg, previous)")
    key_cols = [f"`{k}`" for k in keys]
    return (wide.selectExpr(*key_cols, "sample_size", stack)
            .selectExpr(*key_cols, "metric", "sample_size", "recent_avg",
                        "coalesce(previous, recent_avg) AS previous_avg")
            .selectExpr(*key_cols, "metric", "sample_size", "recent_avg", "previous_avg",
                        "CASE WHEN previous_avg > 0 THEN (recent_avg - previous_avg) / previous_avg * 100.0D "
                        "ELSE 0.0D END AS change_percent")
            .selectExpr(*key_cols, "metric", "sample_size", "recent_avg", "previous_avg", "change_percent",
                        f"CASE WHEN change_percent > {TREND_BAND}D THEN 'up' "
                        f"WHEN change_percent < -{TREND_BAND}D THEN 'down' ELSE 'neutral' END AS trend"))
