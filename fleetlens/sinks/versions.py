"""Keyed tables on Parquet that change by one rename: appended deltas, merged when read, folded in by upkeep.

    <table>/_log/<seq>.seq              a number that a writer has taken (exclusive creation)
    <table>/_log/<seq>.begun.<writer>   it is writing its delta
    <table>/_log/<seq>.done.<writer>    the delta counts (one rename of the file above)
    <table>/_log/<seq>.base             JSON: the version of each day, and the deltas that these hold
    <table>/deltas/seq=<seq>/day=<D>/   the rows of one write
    <table>/base/day=<D>/version=<seq>/ merged rows

A write adds its own rows and nothing else, whatever the table holds.  A reader takes the newest base
file, the day versions it names and the deltas that are done and not in them, so it sees a write whole or
not at all, also one that spans days.  ``fold`` writes new versions of the days that the deltas touch
beside the old ones, then publishes them with a new base file.  Whatever step a job dies at, the table
is what it was before or after, and the next run goes on: an unfinished delta is overwritten under its
old number by the writer's replay, versions that no base file names are overwritten or swept up.  What
a fold has made old stays until the next fold, for readers that have begun.

Any number of writers may append; folds must not run at the same time as each other.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from fleetlens.sinks.files import Folders

LOG, BASE, DELTAS = "_log", "base", "deltas"
#: In a delta: the row stands for all that is stored of its key, kept columns too.
REPLACES = "replaces"
#: Day of rows without a date.
NO_DAY = "none"


@dataclass(frozen=True)
class State:
    """What a reader sees: the days of the base and the deltas that are not in them."""

    versions: dict[str, int]
    deltas: tuple[int, ...]
    folded: tuple[int, ...]


class KeyedTable:
    """One row a ``key``: of all versions of a key, ``kept`` columns come from the first, ``summed`` columns
    add up, the others come from the last: the last write, in it the highest ``order``; with ``by_order``
    the highest ``order`` of all writes.

    ``day`` is the date column (or the time) that rows are partitioned by; ``order`` decides between
    versions of one write.  A key's versions are expected to have the same day; ``fold(anywhere=True)``,
    and any fold of replacing rows, also finds those that do not.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], day: str,
                 kept: Sequence[str] = (), order: str | None = None, summed: Sequence[str] = (), by_order: bool = False):
        self.spark, self.path, self.schema, self.day = spark, path.rstrip("/"), schema, day
        self.key, self.kept, self.order = list(key), list(kept), order
        self.summed, self.by_order = list(summed), by_order
        self.fs = Folders(spark, self.path)

    # -- the log -----------------------------------------------------------------------------------

    def _entries(self) -> list[tuple[int, str, str]]:
        out = []
        for name in self.fs.files(f"{self.path}/{LOG}"):
            seq, kind, writer = (*name.split(".", 2), "")[:3]
            if seq.isdigit() and not (kind == "base" and writer):       # not a file being written
                out.append((int(seq), kind, writer))
        return sorted(out)

    def _file(self, seq: int, kind: str, writer: str = "") -> str:
        return f"{self.path}/{LOG}/{seq:012d}.{kind}" + (f".{writer}" if writer else "")

    def exists(self) -> bool:
        return any(kind in ("done", "base") for _, kind, _ in self._entries())

    def _base(self, entries, below: int | None = None) -> tuple[int, dict]:
        found = [seq for seq, kind, _ in entries if kind == "base" and (below is None or seq < below)]
        if not found:
            return -1, {"days": {}, "folded": []}
        return max(found), json.loads(self.fs.read_text(self._file(max(found), "base")))

    def state(self) -> State:
        entries = self._entries()
        base = self._base(entries)[1]
        done = [seq for seq, kind, _ in entries if kind == "done"]
        folded = set(base["folded"])
        return State(base["days"], tuple(s for s in done if s not in folded), tuple(s for s in done if s in folded))

    # -- writing -----------------------------------------------------------------------------------

    def append(self, rows: DataFrame, writer: str, batch: int | None = None, replaces: bool = False) -> None:
        """Add ``rows`` (versions of their keys) as one write.

        ``writer`` names who writes; with ``batch`` a write that is done is not done again, so a replayed
        micro-batch changes nothing.  Without, every call is a write of its own.
        """
        if "." in writer or "/" in writer:
            raise ValueError("writer: a name without '.' and '/'")
        entries = self._entries()
        label = writer if batch is None else f"{writer}.{batch}"
        if batch is not None:
            done = [int(w.rsplit(".", 1)[1]) for _, kind, w in entries if kind == "done" and w.rpartition(".")[0] == writer]
            if done and max(done) >= batch:
                return
        begun = [seq for seq, kind, w in entries if kind == "begun" and w == label]
        seq = begun[0] if begun and batch is not None else self._take()
        self.fs.write_text(self._file(seq, "begun", label), "")
        day = F.coalesce(F.to_date(self.day).cast("string"), F.lit(NO_DAY))
        out = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn(REPLACES, F.lit(replaces)).withColumn("day_", day)
        # by day first: else every task writes a file of every day
        (out.withColumnRenamed("day_", "day").hint("rebalance", "day").sortWithinPartitions("day").write.mode("overwrite").partitionBy("day")
         .parquet(f"{self.path}/{DELTAS}/seq={seq}"))
        self.fs.move(self._file(seq, "begun", label), self._file(seq, "done", label))

    def _take(self) -> int:
        seq = max((s for s, _, _ in self._entries()), default=0) + 1
        while not self.fs.claim(self._file(seq, "seq")):
            seq += 1
        return seq

    # -- reading -----------------------------------------------------------------------------------

    def _stored(self, versions: dict[str, int], days: Iterable[str] | None = None) -> DataFrame:
        """Rows of the base, with their ``day``: a partition column, so that filters on it prune."""
        names = sorted(versions) if days is None else sorted(set(days) & set(versions))
        schema = StructType([*self.schema.fields, StructField("day", StringType())])
        if not names:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{BASE}/day={d}/version={versions[d]}" for d in names]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{BASE}").parquet(*paths)

    def _added(self, deltas: Sequence[int]) -> DataFrame:
        more = [StructField(REPLACES, BooleanType()), StructField("seq", LongType()), StructField("day", StringType())]
        schema = StructType([*self.schema.fields, *more])
        root = f"{self.path}/{DELTAS}"
        there = set(self.fs.folders(root, "seq="))
        deltas = [n for n in deltas if f"seq={n}" in there]
        if not deltas:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/seq={n}" for n in deltas])

    def _merged(self, stored: DataFrame, added: DataFrame) -> DataFrame:
        """One row a key: partial aggregates, so many versions of one key combine before the shuffle."""
        names = self.schema.fieldNames()
        at = [F.col(self.order).alias("at")] if self.order else []
        version = F.struct(*at, "seq") if self.by_order else F.struct("seq", *at)
        both = (stored.withColumn(REPLACES, F.lit(False)).withColumn("seq", F.lit(-1).cast("long")).select(*names, REPLACES, "seq")
                .unionByName(added.select(*names, REPLACES, "seq")).withColumn("v", version))
        last = [c for c in names if c not in (*self.key, *self.kept, *self.summed)]
        aggs = [F.sum(c).cast(self.schema[c].dataType).alias(c) for c in self.summed]
        if last:
            aggs.append(F.max_by(F.struct(*last), "v").alias("l"))
        if self.kept:
            first = F.struct(*self.kept)
            aggs.append(F.coalesce(F.max_by(first, F.when(F.col(REPLACES), F.col("v"))), F.min_by(first, "v")).alias("f"))
        out = both.groupBy(*self.key).agg(*aggs)
        return out.select(*(c if c in (*self.key, *self.summed) else F.col(f"f.{c}" if c in self.kept else f"l.{c}").alias(c) for c in names))

    def _of(self, stored: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """``stored`` with or without the rows of ``keys``; a null in a key equals a null."""
        keys = keys.select(*(F.col(k).alias(f"_{k}") for k in self.key))
        return stored.join(keys, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key], how)

    def _day(self):
        return F.coalesce(F.to_date(self.day).cast("string"), F.lit(NO_DAY))

    def read(self, days: Iterable | None = None, date_col: str | None = None) -> DataFrame:
        """The table as it stands.

        ``days`` (dates) reads those days of the base alone, and every unfolded delta; so does a filter on
        ``date_col``, a further column with the date.  Rows that no delta touches pass through: only
        keys of the deltas are merged.
        """
        state = self.state()
        names = self.schema.fieldNames()
        wanted = None if days is None else [str(d) for d in days]
        out = stored = self._stored(state.versions, wanted)
        if state.deltas:
            added = self._added(state.deltas)
            keys = added.select(*self.key).distinct()
            merged = self._merged(self._of(stored, keys, "left_semi"), added).withColumn("day", self._day())
            out = self._of(stored, keys, "left_anti").select(*names, "day").unionByName(merged)
        if wanted is not None:
            out = out.where(F.col("day").isin(wanted))
        date = [F.when(F.col("day") != NO_DAY, F.col("day")).cast("date").alias(date_col)] if date_col else []
        return out.select(*names, *date)

    def _days_of(self, deltas: Sequence[int]) -> dict[int, set[str]]:
        return {s: {n.split("=", 1)[1] for n in self.fs.folders(f"{self.path}/{DELTAS}/seq={s}", "day=")} for s in deltas}

    def signatures(self) -> dict[str, str]:
        """day -> what changes whenever its rows may have changed."""
        state = self.state()
        added = self._days_of(state.deltas)
        return {d: f"{state.versions.get(d, -1)}-{'-'.join(str(s) for s in state.deltas if d in added[s])}"
                for d in sorted(set(state.versions).union(*added.values()))}

    # -- upkeep ------------------------------------------------------------------------------------

    def fold(self, anywhere: bool = False) -> int:
        """Merge the done deltas into the base; returns their number.  Only the days they touch are rewritten."""
        state = self.state()
        if state.deltas:
            added = self._added(state.deltas)
            days = set().union(*self._days_of(state.deltas).values())
            if anywhere or not added.where(REPLACES).isEmpty():
                keys = added.select(*self.key).distinct()
                found = self._of(self._stored(state.versions).select(*self.key, "day"), keys, "left_semi")
                days |= {r.day for r in found.select("day").distinct().collect()}
            seq = self._take()
            merged = self._merged(self._stored(state.versions, days), added).withColumn("day", self._day()).hint("rebalance", "day")
            (merged.withColumn("version", F.lit(seq)).sortWithinPartitions("day", *self.key).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(f"{self.path}/{BASE}"))
            versions = {d: v for d, v in state.versions.items() if d not in days}
            for name in self.fs.folders(f"{self.path}/{BASE}", "day="):
                if self.fs.exists(f"{self.path}/{BASE}/{name}/version={seq}"):
                    versions[name.split("=", 1)[1]] = seq
            found = {"days": versions, "folded": sorted({*state.folded, *state.deltas})}
            self.fs.write_text(self._file(seq, "base"), json.dumps(found, sort_keys=True))
        self._sweep()
        return len(state.deltas)

    def _sweep(self) -> None:
        """Remove what neither the newest base file nor the one before it needs."""
        entries = self._entries()
        newest, base = self._base(entries)
        if newest < 0:
            return
        before, older = self._base(entries, below=newest)
        for name in self.fs.folders(f"{self.path}/{BASE}", "day="):
            day = name.split("=", 1)[1]
            for v in self.fs.folders(f"{self.path}/{BASE}/{name}", "version="):
                number = int(v.split("=", 1)[1])
                if number <= newest and number not in (base["days"].get(day), older["days"].get(day)):
                    self.fs.delete(f"{self.path}/{BASE}/{name}/{v}")
        batches = [(w.rpartition(".")[0], int(w.rpartition(".")[2])) for _, kind, w in entries if kind == "done" and "." in w]
        old = set(older["folded"])
        for seq, kind, w in entries:
            if kind == "done" and seq in old:
                self.fs.delete(f"{self.path}/{DELTAS}/seq={seq}")
                name, _, batch = w.rpartition(".")
                if name and all(b <= int(batch) for n, b in batches if n == name):
                    continue                     # tells a replay of the writer's newest batch
                self.fs.delete(self._file(seq, kind, w))
            elif seq < before and kind in ("seq", "base"):
                self.fs.delete(self._file(seq, kind))
