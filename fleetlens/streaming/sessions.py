"""Streaming session tracking (R1) and the session drain.

R1 is a keyed fold over arrival order with a state that outlives ``done``, which
a streaming aggregate cannot emit per ``done``; it runs as
``applyInPandasWithState`` keyed by session id.  The Python part only folds the
raw state (start, model, first token, last non-null counts); the session
measures (P6) are the same Spark expressions as in batch.  Response texts stay in
the JVM, and of a micro-batch the fold holds one Arrow batch and the chunks with
``done`` or a count, so a session of a million tokens costs no more memory than a
short one.  A watermark on the arrival time bounds the state: a session idle for ``state_ttl`` beyond the
watermark leaves it.  ``reconcile_sessions`` then makes the stored sessions what
the landed chunks say, late ones included.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, StructField, StructType

from fleetlens import config
from fleetlens.functions.display import ts_literal
from fleetlens.operators.sessions import _finish, track_sessions
from fleetlens.schemas import LLM_CHUNKS
from fleetlens.sinks.files import Folders
from fleetlens.sinks.tables import replace_sessions, upsert_sessions

STATE_SCHEMA = ("start_ts timestamp, model string, first_token timestamp, prompt long, completion long, "
                "eval_ns long, last_ts timestamp")
RAW_SCHEMA = ("session_id string, _start timestamp, _model string, _first_token timestamp, _prompt long, "
              "_completion long, _eval_ns long, _end timestamp")
_COUNTS = (("prompt_eval_count", "prompt"), ("eval_count", "completion"), ("eval_duration", "eval_ns"))


EMIT_ROWS = 100_000


def _none(v):
    return None if v is None or pd.isna(v) else v


def _reduced(pdfs: Iterator[pd.DataFrame]):
    """(first row, first row with a response, latest arrival, rows that emit or count, in order).

    One Arrow batch is held at a time; of it stay the rows with ``done`` or a count, as numbers.  The tokens
    between them, nearly all chunks of a session, only matter through the first one with a response.  Arrays,
    not frames: most sessions are a few chunks, for which every pandas step costs more than the work.
    """
    first = answer = latest = None
    kept = []
    for pdf in pdfs:
        at, seq, done = (pdf[c].to_numpy() for c in ("arrival_ts", "seq", "done"))
        order = np.lexsort((seq, at))
        place = at[order[0]], seq[order[0]]
        if first is None or place < first[0]:
            first = place, pdf["model"].iloc[order[0]]
        spoken = order[pdf["answered"].to_numpy()[order]]
        if len(spoken) and (answer is None or (at[spoken[0]], seq[spoken[0]]) < answer):
            answer = at[spoken[0]], seq[spoken[0]]
        end = at[order[-1]]
        latest = end if latest is None else max(latest, end)
        counts = [pdf[src].to_numpy() for src, _ in _COUNTS]
        known = [pd.notna(c) for c in counts]
        keep = order[(done | np.logical_or.reduce(known))[order]]
        kept.append([at[keep], seq[keep], done[keep], *[np.where(k, c, 0).astype(np.int64)[keep] for c, k in zip(counts, known, strict=True)],
                     *[k[keep] for k in known]])
    if len(kept) > 1:
        rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
        order = np.lexsort((rows[1], rows[0]))
        kept = [[x[order] for x in rows]]
    return first, answer, latest, kept[0]


def _carried(values: np.ndarray, known: np.ndarray, before: int | None) -> pd.api.extensions.ExtensionArray:
    """The last known value at each row, ``before`` ahead of the first."""
    last = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    none = last < 0
    out = np.where(none, 0 if before is None else before, values[last])
    return pd.arrays.IntegerArray(out.astype(np.int64), none if before is None else np.zeros(len(values), bool))


def _fold(ttl_ms: int):
    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, answer, latest, (at, seq, done, *numbers) = _reduced(pdfs)
        if state.exists:
            start, model, first_token, prompt, completion, eval_ns, _ = state.get
        else:
            start, model = pd.Timestamp(first[0][0]), _none(first[1])
            first_token = prompt = completion = eval_ns = None
        # First token: earliest arrival of a chunk with a response, unless one was seen before.
        if first_token is not None:
            ft = np.full(len(at), pd.Timestamp(first_token).to_datetime64())
        elif answer is None:
            ft = np.full(len(at), np.datetime64("NaT"), at.dtype)
        else:
            ft = np.where((at > answer[0]) | ((at == answer[0]) & (seq >= answer[1])), answer[0], np.datetime64("NaT")).astype(at.dtype)
        running, left = {}, {}
        for n, (_, name) in enumerate(_COUNTS):
            prev = {"prompt": prompt, "completion": completion, "eval_ns": eval_ns}[name]
            running[name] = _carried(numbers[n], numbers[len(_COUNTS) + n], prev)
            left[name] = _none(running[name][-1]) if len(at) else prev
        state.update((start, model, first_token if first_token is not None else (pd.Timestamp(answer[0]) if answer else None),
                      left["prompt"], left["completion"], left["eval_ns"], pd.Timestamp(latest)))
        # Idle timeout in event time: TTL past the session's last chunk (never before the watermark).
        last_ms = int(pd.Timestamp(latest).value // 1_000_000)
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + ttl_ms)
        emits = np.flatnonzero(done)
        for lo in range(0, len(emits), EMIT_ROWS):
            some = emits[lo:lo + EMIT_ROWS]
            yield pd.DataFrame({
                "session_id": key[0],
                "_start": start, "_model": model,
                "_first_token": ft[some],
                "_prompt": running["prompt"][some],
                "_completion": running["completion"][some],
                "_eval_ns": running["eval_ns"][some],
                "_end": at[some],
            })
    return fold


def track_sessions_stream(chunks: DataFrame, watermark: str = "10 minutes",
                          state_ttl_ms: int = 30 * 60 * 1000) -> DataFrame:
    """R1 (streaming): one session row per ``done`` chunk, as in batch.

    ``chunks`` is a streaming frame of parsed chunks (LLM_CHUNKS) whose
    ``arrival_ts`` is a TIMESTAMP; the output has the ``llm_sessions`` schema.
    """
    last = F.lit(2 ** 63 - 1)
    raw = (chunks.select("session_id", F.col("arrival_ts").cast("timestamp").alias("arrival_ts"), F.coalesce("seq", last).alias("seq"),
                         "model", F.col("response").isNotNull().alias("answered"), F.coalesce("done", F.lit(False)).alias("done"),
                         *[c for c, _ in _COUNTS])
           .withWatermark("arrival_ts", watermark)
           .groupBy("session_id")
           .applyInPandasWithState(_fold(state_ttl_ms), RAW_SCHEMA, STATE_SCHEMA, "append",
                                   GroupStateTimeout.EventTimeTimeout))
    return _finish(raw)


def reconcile_sessions(spark: SparkSession, chunks: DataFrame, table_path: str, since=None) -> None:
    """Sessions recomputed from the landed chunks and upserted over what the stream stored.

    The stream drops chunks later than its watermark and forgets idle sessions, to bound its state; the
    landed chunks hold everything.  This job takes every session with a chunk since ``since`` (all, if
    None), tracks it in batch over all its chunks (R1) and upserts the result, whichever day the
    stored version lies under.  Run from upkeep, it makes stored sessions independent of the watermark.
    """
    touched = chunks if since is None else chunks.where(F.col("arrival_ts") >= ts_literal(since, "since"))
    ids = touched.select("session_id").distinct()
    replace_sessions(spark, track_sessions(chunks.join(ids, "session_id", "left_semi")), table_path)


def reconcile_landed(spark: SparkSession, chunks_path: str, table_path: str, span_days: int = 1) -> int:
    """Reconcile the sessions that have chunks in landed days changed since the last run; returns the number of days.

    ``chunks_path`` is a folder of ``date=D`` partitions of parsed chunks.  A ledger beside the session
    table holds the signature of every day as last reconciled, so only days that are new or have got late
    chunks are read, with ``span_days`` around them for the rest of their sessions.  The ledger follows the
    write: a run that dies is done again.
    """
    base, ledger = chunks_path.rstrip("/"), f"{table_path.rstrip('/')}/_reconciled"
    fs, own = Folders(spark, base), Folders(spark, table_path)
    now = {n.split("=", 1)[1]: fs.signature(f"{base}/{n}") for n in fs.folders(base, "date=")}
    then = json.loads(own.read_text(ledger)) if own.exists(ledger) else {}
    changed = sorted(d for d, s in now.items() if then.get(d) != s)
    if changed:
        around = {(_dt.date.fromisoformat(d) + _dt.timedelta(days=n)) for d in changed if d[:1].isdigit() for n in range(-span_days, span_days + 1)}
        chunks = spark.read.schema(StructType([*LLM_CHUNKS.fields, StructField("date", DateType())])).parquet(base)
        odd = F.col("date").isNull() if any(not d[:1].isdigit() for d in changed) else F.lit(False)
        ids = chunks.where(F.col("date").isin([_dt.date.fromisoformat(d) for d in changed if d[:1].isdigit()]) | odd).select("session_id").distinct()
        near = chunks.where(F.col("date").isin(sorted(around)) | odd).drop("date")
        replace_sessions(spark, track_sessions(near.join(ids, "session_id", "left_semi")), table_path)
        own.write_text(ledger, json.dumps(now, sort_keys=True))
    return len(changed)


def drain_sessions(spark: SparkSession, sessions: DataFrame, table_path: str, checkpoint_location: str,
                   trigger_seconds: int = 5, available_now: bool = False, writer_name: str = "drain"):
    """Every trigger, upsert the completed sessions into the table (K2).

    A micro-batch writes its own rows, as the delta of its number: the stored days are neither read nor
    rewritten, and a replayed batch is not written again.  ``writer_name`` tells streams into one table apart.
    """
    config.prepare(spark)

    def write(df: DataFrame, batch_id: int) -> None:
        # Spark plans stateful streams without adaptive execution.  The micro-batch is computed apart from them; its
        # write needs it, to bring a day's rows together: else every state partition writes a file of every day.
        conf = df.sparkSession.conf
        stateful = conf.get("spark.sql.adaptive.enabled")
        conf.set("spark.sql.adaptive.enabled", "true")
        try:
            upsert_sessions(spark, df, table_path, writer_name, batch_id)
        finally:
            conf.set("spark.sql.adaptive.enabled", stateful)

    writer = sessions.writeStream.option("checkpointLocation", checkpoint_location).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
