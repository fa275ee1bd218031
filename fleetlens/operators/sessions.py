"""LLM sessions from parsed response chunks (R1 batch, P6) and the session
panel (T2, T3, T4, P8, A10, A11).

State of a session after a chunk (in (arrival_ts, seq) order):

* start = arrival of its first chunk (or the earliest ``start_col`` value);
  model = model of its first chunk;
* first token = arrival of the first chunk whose ``response`` is present
  (an empty string counts);
* prompt / completion counts and the eval duration: last non-null value;
* every chunk with ``done`` emits the session as of that chunk, end = its
  arrival.  The state survives ``done``, so a second ``done`` emits again.

Plan (exact for any number of ``done`` chunks; no window task holds more than
one block of a session, so a long or hot session spreads over many tasks):

1. chunks are cut into blocks per session that follow their order
   (``series.with_blocks``: time slices, a burst cut finer);
2. per (session, block) aggregates of the state (start, model, first token, last
   non-null counts), a partial aggregate; the state is associative, so a running
   combine over that small table gives the state before each block;
3. a running window per (session, block) over the chunks, combined with the
   state before the block, emits the rows at each ``done``.

Raw chunks are shuffled once, for the join with that state and the window together.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import sessions as SF
from fleetlens.functions.display import (as_instant, clock_time, duration_text, fixed, model_base_name,
                                         thousands_text, ts_literal, ttft_text)
from fleetlens.operators.pruning import time_filter
from fleetlens.operators.series import BLOCK_COLUMNS, partitioning_columns, with_blocks

ORDER = ("arrival_ts", "seq")


def _finish(df: DataFrame) -> DataFrame:
    """P6 on the raw state columns."""
    prompt = F.coalesce(F.col("_prompt"), F.lit(0).cast("long"))
    completion = F.coalesce(F.col("_completion"), F.lit(0).cast("long"))
    eval_ns = F.coalesce(F.col("_eval_ns"), F.lit(0).cast("long"))
    return df.select(
        F.col("session_id").alias("id"),
        F.col("_start").alias("start_time"),
        F.col("_end").alias("end_time"),
        F.col("_model").alias("model"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        SF.total_tokens(prompt, completion).alias("total_tokens"),
        SF.tokens_per_second(completion, eval_ns).alias("tokens_per_second"),
        SF.time_to_first_token_ms(F.col("_start"), F.col("_first_token")).alias("time_to_first_token_ms"),
        SF.time_per_output_token_ms(completion, eval_ns).alias("time_per_output_token_ms"),
    )


def track_sessions(chunks: DataFrame, order: Sequence[str] = ORDER, block_seconds: int = 60,
                   start_col: str | None = None, block_rows: int | None = 100_000) -> DataFrame:
    """R1 + P6 (batch): one ``llm_sessions`` row per ``done`` chunk.

    ``start_col`` (e.g. a ``request_ts`` column carried by the chunks) makes
    the session start at the earliest value of that column instead of the first
    chunk's arrival, so time to first token counts from the request.  Blocks
    are ``block_seconds`` wide, those above ``block_rows`` chunks cut finer.
    """
    order = list(order)
    rows = with_blocks(chunks, ["session_id"], order[0], order[1:], block_seconds, block_rows)
    part = partitioning_columns(["session_id"])
    group, blocks = part[:-len(BLOCK_COLUMNS)], list(BLOCK_COLUMNS)
    key_sql = "struct(" + ", ".join(f"`{c}`" for c in order) + ")"
    start, first_token = f"`{start_col or 'arrival_ts'}`", "CASE WHEN response IS NOT NULL THEN arrival_ts END"
    counts = {"prompt": "prompt_eval_count", "completion": "eval_count", "eval_ns": "eval_duration"}

    per_block = rows.groupBy(*part).agg(*[F.expr(a) for a in (
        f"min({start}) AS _start", f"min_by(model, {key_sql}) AS _model", f"min({first_token}) AS _first_token",
        *[f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN {key_sql} END) AS _{n}" for n, c in counts.items()])])
    earlier = (f"OVER (PARTITION BY {', '.join(group)} ORDER BY {', '.join(blocks)} "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    before = per_block.selectExpr(
        *part, f"min(_start) {earlier} AS _b_start", f"first(_model) {earlier} AS _b_model",
        f"min(_first_token) {earlier} AS _b_first_token", *[f"last(_{n}, true) {earlier} AS _b_{n}" for n in counts])
    so_far = (f"OVER (PARTITION BY {', '.join(part)} ORDER BY {', '.join(f'`{c}`' for c in order)} "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    state = rows.join(before, part).selectExpr(
        "session_id", "done", "arrival_ts AS _end",
        f"least(_b_start, min({start}) {so_far}) AS _start",
        f"coalesce(_b_model, first(model) {so_far}) AS _model",
        f"coalesce(_b_first_token, min({first_token}) {so_far}) AS _first_token",
        *[f"coalesce(last(`{c}`, true) {so_far}, _b_{n}) AS _{n}" for n, c in counts.items()])
    return _finish(state.where("done"))


def sessions_between(sessions: DataFrame, start, end, newest_first: bool = True) -> DataFrame:
    """Sessions with start <= start_time <= end (both inclusive), newest first."""
    # Both bounds are validated first, so a bad one is named in the error (P10).
    ts_literal(start, "start_date"), ts_literal(end, "end_date")
    out = time_filter(sessions, "start_time", start, end)
    return out.orderBy(F.col("start_time").desc(), F.col("id")) if newest_first else out


def rolling_sessions(sessions: DataFrame, now, hours: float = 24) -> DataFrame:
    """T4: the panel's rolling window, T2 with end = now and start = now - 24 h."""
    n = as_instant(now, "now")
    return sessions_between(sessions, n - _dt.timedelta(hours=hours), n)


def recent_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    """T3 + P8: the newest n sessions as display rows (top-k, no global sort)."""
    dur = SF.duration_seconds("start_time", "end_time")
    top = sessions.orderBy(F.col("start_time").desc(), F.col("id")).limit(n)
    return top.select(
        "id", "start_time", clock_time("start_time").alias("time"), "model", "total_tokens",
        fixed(F.col("tokens_per_second"), 1).alias("tps_text"),
        ttft_text("time_to_first_token_ms").alias("ttft_text"),
        duration_text(dur).alias("duration_text"),
    )


def session_totals(sessions: DataFrame) -> DataFrame:
    """A10: count, mean tps, mean ttft over non-null non-zero values (0 if none),
    token sum, mean duration in seconds over ended sessions (0 if none).  No
    sessions, no row."""
    ttft = F.col("time_to_first_token_ms")
    dur = F.when(F.col("end_time").isNotNull(), SF.duration_seconds("start_time", "end_time"))
    agg = sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg("tokens_per_second").alias("avg_tokens_per_second"),
        F.coalesce(F.avg(F.when(ttft > 0, ttft)), F.lit(0.0)).alias("avg_ttft_ms"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.avg(dur), F.lit(0.0)).alias("avg_duration_secs"),
    ).where(F.col("total_sessions") > 0)
    return agg.select("*", thousands_text("total_tokens").alias("total_tokens_text"),
                      F.when(F.col("avg_duration_secs") > 0, duration_text(F.col("avg_duration_secs")))
                      .otherwise(F.lit("-")).alias("avg_duration_text"))


def model_stats(sessions: DataFrame) -> DataFrame:
    """Per model mean tps and count, best first; ties go to the model with
    the newest session."""
    return (sessions.groupBy("model")
            .agg(F.avg("tokens_per_second").alias("avg_tokens_per_second"),
                 F.count(F.lit(1)).alias("session_count"),
                 F.max("start_time").alias("newest_start"))
            .orderBy(F.col("avg_tokens_per_second").desc(), F.col("newest_start").desc(), F.col("model")))


def best_model(sessions: DataFrame) -> DataFrame:
    """The first row of ``model_stats``, with the model's base name."""
    return model_stats(sessions).limit(1).select(
        "model", model_base_name("model").alias("model_base"), "avg_tokens_per_second", "session_count")
