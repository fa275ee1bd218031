"""Streaming ingest tick (R2) and periodic export.

R2 runs the batch operators on each micro-batch of device samples inside
``foreachBatch``: normalise (S2, S3), store metrics (K1), flatten processes
(J2), keep one entry per pid (W4), join the OS process table (J1), classify
(P1), store events (K3).  Each micro-batch is written into its own
``batch_id`` partition with dynamic partition overwrite, so a replayed batch
replaces its own output instead of duplicating it.

With polls, a poll is one classification however it lands: its devices may come in several
micro-batches, and its process table before, with or after them, also in pieces.  Every batch keeps
its flat samples (``<events>/_polls``) and a ledger of the polls of the last ``hold_batches`` batches
with the samples and processes counted so far (``_open``).  A poll of which either count has grown is
classified again over all its samples, and the batch notes that its earlier events are superseded
(``_superseded``); readers, compaction and archive leave those out (``compaction.read_ingested``).

R5 is a native streaming aggregate per export period, emitted when the watermark
passes its end; the stored tables hold late rows too, and the batch forms over
them (``operators.rollups``) are the final answer for a closed period.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.operators.processes import flatten_processes, process_events
from fleetlens.functions.gpu import MIB
from fleetlens.operators.metrics import order_key
from fleetlens.operators.rollups import GPU_GAUGE_NAMES, histogram
from fleetlens.sinks.compaction import SUPERSEDED
from fleetlens.sinks.files import Folders
from fleetlens.sources.gpu import device_metrics_with_processes


def _write_batch(df: DataFrame, path: str, batch_id: int, ts: str = "timestamp") -> None:
    order = [c for c in ("host", "gpu_id", "category") if c in df.columns]
    # by date first: else every task writes a file of every date
    (df.withColumn("date", F.to_date(F.col(ts))).withColumn("batch_id", F.lit(batch_id).cast("long")).hint("rebalance", "date")
     .sortWithinPartitions("date", *order, ts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date", "batch_id").parquet(path))


def ingest_batch(spark: SparkSession, samples: DataFrame, batch_id: int,
                 os_processes: DataFrame | Callable[[SparkSession], DataFrame],
                 metrics_path: str, events_path: str, library_roots: Sequence[str] | DataFrame = (), hold_batches: int = 64) -> None:
    """One ingest tick over a micro-batch of raw device samples.

    Samples of a fleet (HOST_SAMPLES) are keyed by ``host`` and taken poll by poll (``poll_id``).
    ``os_processes`` as a function is called for every micro-batch, so it lists what has landed since;
    with a ``poll_id`` column (PROCESS_SNAPSHOTS) every poll gets its own process table.  A poll stays open
    to late devices and processes for ``hold_batches`` micro-batches.
    """
    procs = os_processes(spark) if callable(os_processes) else os_processes
    keys = [k for k in ("host",) if k in samples.columns]
    poll = "poll_id" if "poll_id" in samples.columns else None
    metrics = device_metrics_with_processes(samples)
    metrics = metrics.persist()  # used by both writes of this micro-batch only
    try:
        _write_batch(metrics.drop("processes"), metrics_path, batch_id)
        flat = flatten_processes(metrics, keys=[*keys, *([poll] if poll else [])])
        if poll:
            _polled_events(spark, flat, procs, batch_id, events_path.rstrip("/"), library_roots, keys, poll, hold_batches)
        else:
            events = process_events(flat, procs, tick_unit=None, library_roots=library_roots, keys=keys)
            _write_batch(events, events_path, batch_id)
    finally:
        metrics.unpersist()


def _polled_events(spark: SparkSession, flat: DataFrame, procs: DataFrame, batch_id: int, path: str,
                   library_roots: Sequence[str] | DataFrame, keys: list[str], poll: str, hold: int) -> None:
    """Events of the polls that have grown with this batch: by samples, or by their process table."""
    fs, by = Folders(spark, path), [*keys, poll]

    def one(df: DataFrame, folder: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{folder}/batch_id={batch_id}")

    def recent(folder: str) -> list[int]:
        found = sorted(int(n.split("=", 1)[1]) for n in fs.folders(f"{path}/{folder}", "batch_id="))
        return [b for b in found if batch_id - hold < b < batch_id]

    one(flat, "_polls")
    held = [f"{path}/_polls/batch_id={b}" for b in (*recent("_polls"), batch_id)]
    pending = spark.read.schema(flat.schema).parquet(*held)
    before = recent("_open")
    ledger = flat.select(*by).schema.add("samples", "long").add("processes", "long").add("since", "long").add("written", "boolean")
    known = spark.read.schema(ledger).parquet(f"{path}/_open/batch_id={before[-1]}") if before else spark.createDataFrame([], ledger)
    known = known.where(F.col("since") > batch_id - hold)
    match = by if poll in procs.columns else keys
    counted = pending.groupBy(*by).agg(F.count("*").alias("n_samples"))
    if match:
        there = procs.groupBy(*match).agg(F.count("*").alias("n_processes"))
        counted = counted.join(there, match, "left")
    else:
        counted = counted.withColumn("n_processes", F.lit(procs.count()).cast("long"))
    state = known.join(counted, by, "full_outer").select(
        *by, F.coalesce("n_samples", "samples").alias("samples"), F.coalesce("n_processes", F.lit(0).cast("long")).alias("processes"),
        F.coalesce("since", F.lit(batch_id).cast("long")).alias("since"), F.coalesce("written", F.lit(False)).alias("before"),
        (F.coalesce(F.col("samples"), F.lit(0)) < F.col("n_samples")).alias("more_samples"),
        (F.coalesce(known["processes"], F.lit(0)) < F.coalesce("n_processes", F.lit(0))).alias("more_processes"))
    state = state.withColumn("grown", (F.col("more_samples") | F.col("more_processes")) & (F.col("processes") > 0)).persist()
    try:
        grown = state.where("grown").select(*by)
        events = process_events(pending.join(grown, by, "left_semi"), procs, tick_unit=None, library_roots=library_roots,
                                keys=keys, poll=poll, keep_poll=True)
        _write_batch(events.withColumn("written_batch", F.lit(batch_id).cast("long")), path, batch_id)
        again = state.where("grown AND before").select(*by)
        if not again.isEmpty():
            one(again, SUPERSEDED)
        one(state.select(*by, "samples", "processes", "since", (F.col("before") | F.col("grown")).alias("written")), "_open")
    finally:
        state.unpersist()
    for folder in ("_polls", "_open"):
        for name in fs.folders(f"{path}/{folder}", "batch_id="):
            if int(name.split("=", 1)[1]) <= batch_id - hold:
                fs.delete(f"{path}/{folder}/{name}")


def start_ingest(spark: SparkSession, samples_stream: DataFrame,
                 os_processes: DataFrame | Callable[[SparkSession], DataFrame], metrics_path: str,
                 events_path: str, checkpoint_location: str, library_roots: Sequence[str] | DataFrame = (),
                 trigger_seconds: int = 2, available_now: bool = False, hold_batches: int = 64):
    """R2: start the ingest stream (2 s trigger by default, ``availableNow`` in tests)."""
    config.prepare(spark)
    writer = (samples_stream.writeStream.option("checkpointLocation", checkpoint_location)
              .foreachBatch(lambda df, batch_id: ingest_batch(spark, df, batch_id, os_processes, metrics_path,
                                                              events_path, library_roots, hold_batches)))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()


def export_stream(metrics: DataFrame, every: str = "10 seconds", watermark: str = "30 seconds",
                  tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """Last GPU gauge values per export period and (host if there, gpu_id, name).  Append
    mode emits a period once the watermark passes its end.  Rows later than that miss this
    early answer, not the table: ``operators.rollups.export_windows`` over the stored metrics
    gives the closed periods with them."""
    ts = F.col("timestamp").cast("timestamp")
    cols, keys = list(GPU_GAUGE_NAMES), [k for k in ("host",) if k in metrics.columns]
    rows = metrics.withColumn("timestamp", ts).withWatermark("timestamp", watermark)
    order = order_key(rows, "timestamp", [t for t in tiebreak if t in metrics.columns])
    return (rows.groupBy(F.window("timestamp", every).alias("w"), *keys, "gpu_id", "name")
            .agg(*[F.max_by(F.col(c), order).alias(c) for c in cols])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "gpu_id", "name", *cols))


def export_process_stream(events: DataFrame, every: str = "10 seconds", watermark: str = "30 seconds") -> DataFrame:
    """R5 process gauges under streaming: per export period and category, the process count and memory
    bytes of the period's last tick with the category."""
    keys = [k for k in ("host",) if k in events.columns]
    rows = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    # Ticks are told apart to the millisecond.
    per_tick = rows.groupBy(F.window("timestamp", "1 millisecond").alias("t"), *keys, "category").agg(
        F.count(F.lit(1)).alias("process_count"), F.sum(F.col("gpu_memory_mb") * F.lit(MIB)).cast("long").alias("memory_bytes"))
    at = F.window_time("t")
    return (per_tick.withColumn("at", at).groupBy(F.window("at", every).alias("w"), *keys, "category")
            .agg(F.max_by("process_count", "at").alias("process_count"), F.max_by("memory_bytes", "at").alias("memory_bytes"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "category",
                    "process_count", "memory_bytes"))


def export_histogram_stream(sessions: DataFrame, value: str, buckets: Sequence[float], every: str = "10 seconds",
                            watermark: str = "30 seconds") -> DataFrame:
    """R5 histogram deltas under streaming: per export period of the session end and model, in long form."""
    ended = sessions.where(F.col("end_time").isNotNull()).withWatermark("end_time", watermark)
    return histogram(ended.withColumn("w", F.window("end_time", every)), value, buckets, by=("w", "model")).select(
        F.col("w.start").alias("window_start"), "model", "le", "bucket_count", "sample_sum", "sample_count")


def export_counters_stream(sessions: DataFrame, every: str = "10 seconds", watermark: str = "30 seconds") -> DataFrame:
    """R5 counters under streaming: tokens and sessions per model per export
    period of the session end (delta form), emitted once the watermark passes."""
    ended = sessions.where(F.col("end_time").isNotNull()).withWatermark("end_time", watermark)
    return (ended.groupBy(F.window("end_time", every).alias("w"), "model")
            .agg(F.sum("total_tokens").cast("long").alias("total_tokens"), F.count(F.lit(1)).alias("sessions"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "model", "total_tokens", "sessions"))
