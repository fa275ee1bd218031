"""From sampled GPU processes to classified ``process_events``.

Plan of ``process_events``:

* the GPU's utilisation per tick: ``max`` per (tick, gpu) — partial aggregate;
* W4, one (memory, GPU) per (tick, pid): the last one the sampler would have
  inserted — highest GPU index, then the smallest memory — as hash aggregates
  over one (tick, pid) shuffle of the samples (a (tick, pid) group is bounded
  by the GPUs of one host);
* J1 inner join with the OS process table (pids not found are dropped), on pid and
  a slice of the ticks, so that a busy pid is not one task's work; the library flag
  (J3) is computed on that table before the join;
* P1 classification as one CASE expression on the joined row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.classify import normalise_path, under_any_root, workload_category
from fleetlens.functions.gpu import bytes_to_mib


def flatten_processes(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (sample, process), carrying the GPU's utilisation.

    ``samples`` holds gpu_metrics rows with a ``processes`` array of
    (pid, name, used_gpu_memory) structs; ``id`` becomes the process's position
    in its list (the insertion order W4 relies on).
    """
    return samples.select(
        *keys, "timestamp", "gpu_id", F.col("utilization_gpu").alias("gpu_utilization"),
        F.posexplode("processes").alias("id", "_p"),
    ).select(*keys, F.col("id").cast("long").alias("id"), "timestamp", "gpu_id", "gpu_utilization",
             "_p.pid", "_p.name", F.col("_p.used_gpu_memory").alias("used_gpu_memory"))


def path_prefixes(path) -> Column:
    """All component prefixes of a path: ``/a/b/x`` -> ``/a``, ``/a/b``, ``/a/b/x``
    (and ``""`` standing for the root ``/``)."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def library_flag(df: DataFrame, roots: DataFrame, path: str = "exe_path", out: str = "in_library",
                 root_col: str = "root") -> DataFrame:
    """J3 as an equi-join: a path lies under a root when one of its component
    prefixes equals the root.  Exact for any number of roots (no theta join, no
    broadcast assumption); the flag is computed once per distinct path and
    joined back on the path."""
    norm_roots = (roots.select(normalise_path(root_col).alias("_root"))
                  .where(F.col("_root").isNotNull()).distinct())
    paths = df.select(F.col(path).alias("_path")).where(F.col("_path").isNotNull()).distinct()
    hits = (paths.select("_path", F.explode(path_prefixes(normalise_path("_path"))).alias("_root"))
            .join(norm_roots, "_root", "left_semi")
            .select("_path").distinct().withColumn(out, F.lit(True)))
    return (df.join(hits, df[path] == hits["_path"], "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(False))).drop("_path"))


def per_tick_gpu_pid(samples: DataFrame, keys: Sequence[str] = (), tick: str = "tick") -> DataFrame:
    """Samples reduced to one row per (tick, pid, gpu) with the smallest memory.
    The samples are hash-partitioned once on (tick, pid); this aggregate groups
    on a superset of that partitioning, so it adds neither an exchange nor a sort."""
    mem = F.coalesce(F.col("used_gpu_memory"), F.lit(0).cast("long"))
    by_key = samples.select(*keys, tick, "pid", "gpu_id", mem.alias("mem")).repartition(*keys, tick, "pid")
    return by_key.groupBy(*keys, tick, "pid", "gpu_id").agg(F.min("mem").alias("mem"))


def gpu_utilization_per_tick(samples: DataFrame, keys: Sequence[str] = (), tick: str = "tick") -> DataFrame:
    """A GPU's utilisation in a tick (single-valued: the maximum of its samples);
    a partial aggregate, so only reduced rows are shuffled."""
    return samples.groupBy(*keys, tick, "gpu_id").agg(F.max("gpu_utilization").alias("gpu_util"))


def last_inserted_per_pid(per_gpu: DataFrame, keys: Sequence[str] = (), tick: str = "tick") -> DataFrame:
    """Per (tick, pid) the entry the sampler inserts last: highest GPU index,
    then the smallest memory on it (lists are sorted by memory descending).

    From ``per_tick_gpu_pid``: the value at the highest GPU (``max_by`` over
    fixed-width columns) is a hash aggregate on the (tick, pid) partitioning
    already in place.  Entries tied on GPU and memory are identical in the
    output, so no further tie-break is needed.
    """
    return (per_gpu.groupBy(*keys, tick, "pid")
            .agg(F.max("gpu_id").alias("gpu_id"), F.max_by("mem", "gpu_id").alias("mem")))


def process_events(samples: DataFrame, os_processes: DataFrame, tick_unit: str | None = "day",
                   library_roots: Sequence[str] | DataFrame = (), keys: Sequence[str] = (),
                   poll: str | None = None, keep_poll: bool = False, slices: int = 64) -> DataFrame:
    """Classified process events, one per (*keys, tick, pid) found in the OS table.

    ``samples``: flat process samples (PROCESS_SAMPLES); ``keys``: e.g. ("host",), as
    pid and gpu_id are unique only within a host.  One poll is the column ``poll`` (devices
    of a poll stamp their own clocks; its events carry the latest), or else a
    ``date_trunc`` unit ``tick_unit``, or every sample time.  If ``os_processes`` has the
    ``poll`` column too, each poll is joined with its own process table, whose processes may
    come and go.  ``library_roots``: a list of game library roots or a one-column DataFrame
    ``root`` of them.  ``keep_poll``: the events carry their poll.  ``slices``: without own process tables
    of the polls, the ticks of a pid are joined in this many slices, for a pid may have any share of all ticks;
    the process table gets a row per slice in which its pid occurs.
    """
    keys = list(keys)
    if poll:
        tick = F.col(poll)
    else:
        tick = F.date_trunc(tick_unit, F.col("timestamp")) if tick_unit else F.col("timestamp")
    s = samples.withColumn("tick", tick)
    util = gpu_utilization_per_tick(s, keys)
    picked = last_inserted_per_pid(per_tick_gpu_pid(s, keys), keys)
    procs = os_processes
    if isinstance(library_roots, DataFrame):
        procs = library_flag(procs, library_roots)
        in_lib = F.col("in_library")
    else:
        in_lib = under_any_root(F.col("exe_path"), list(library_roots))
    versioned = bool(poll) and poll in os_processes.columns
    at = [F.col(poll).alias("tick")] if versioned else []
    procs = procs.select(*keys, *at, "pid", "name", "command_line", "exe_path", in_lib.alias("in_library"))
    on = [*keys, *(["tick"] if versioned else []), "pid"]
    if not versioned and slices > 1:
        part = F.pmod(F.xxhash64("tick"), F.lit(slices)).alias("_slice")
        occurring = s.select(*keys, "pid", part).distinct()
        procs, picked, on = procs.join(occurring, on), picked.select("*", part), [*on, "_slice"]
    joined = picked.join(util, [*keys, "tick", "gpu_id"]).join(procs, on, "inner")
    time = F.col("tick")
    if poll:
        joined = joined.join(s.groupBy(*keys, "tick").agg(F.max("timestamp").alias("_at")), [*keys, "tick"])
        time = F.col("_at")
    polled = [F.col("tick").alias(poll)] if keep_poll else []
    category = workload_category("name", "command_line", "exe_path", "gpu_util", in_library=F.col("in_library"))
    return joined.select(
        *keys, *polled,
        time.alias("timestamp"), "pid", "name", category.alias("category"),
        bytes_to_mib("mem").alias("gpu_memory_mb"), F.col("gpu_util").alias("gpu_utilization"),
        "command_line", "exe_path", F.lit(0).cast("long").alias("duration_secs"),
    )
