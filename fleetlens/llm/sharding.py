"""Sharding (5): Karmarkar-Karp differencing of indivisible groups into shards of near-equal bytes.

Equal texts form a group that stays together.  Every group starts as a partial partition: its bytes
in one shard, nothing in the others.  Differencing takes the two partial partitions with the largest
spread and adds them oppositely ordered (largest of one onto smallest of the other), until one is
left.

The last differencing runs on the driver over a bounded number of members: groups of at least
1 / ``FAN`` of all bytes (at most ``FAN``), ``FAN`` of the other groups (those with the smallest
keys, as fine filling), and all the rest in bundles.  Spark makes the bundles: tasks of a bounded
number of groups difference their own into ``BUNDLES`` bundles of near-equal bytes; while there are
more than ``FAN`` bundles, they are bundled again.  A group larger than a fair shard simply keeps the
bundles away from its shard.

Null and empty texts are one group (no bytes); a row's size is the bytes of its text plus one.
Ties go by group key, so a rerun gives the same shards.  Rows with a null id and repeated rows are
rows like others.  An empty table gives no rows.  Only the two named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed

GROUPS_PER_TASK = 50_000
FAN = 4096
BUNDLES = 64
LEAST_IN_BUNDLE = 16
ROWS_PER_BUCKET = 50_000


def difference(partials: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Partial partitions (sums, largest first) combined into one.

    Returns its sums, largest first, and for each partial the final place of each of its sums.
    """
    ways = len(partials[0])
    sums = list(partials)
    made = []                                           # (left, right, place of raw slot j)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        raw = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(ways), key=raw.__getitem__, reverse=True)
        place = [0] * ways
        for at, j in enumerate(order):
            place[j] = at
        made.append((a, b, place))
        sums.append([raw[j] for j in order])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    final: list = [None] * len(sums)
    final[heap[0][1]] = list(range(ways))
    for k in range(len(made) - 1, -1, -1):
        a, b, place = made[k]
        mine = final[len(partials) + k]
        final[len(partials) + k] = None
        final[a] = [mine[p] for p in place]
        final[b] = [mine[p] for p in reversed(place)]
    return sums[heap[0][1]], final[:len(partials)]


def _bundled(members: DataFrame, tasks: int) -> DataFrame:
    """(k1, k2, bundle, sums): members (k1, k2, bytes) differenced per task into ``BUNDLES`` bundles; the
    bundles' bytes come with one of the task's members."""
    most = BUNDLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if not rows:
            return
        rows.sort(key=lambda r: (-r[2], r[0], r[1]))
        ways = min(most, max(1, len(rows) // LEAST_IN_BUNDLE))     # however few rows a task has, bundles are fewer
        total, places = difference([[r[2]] + [0] * (ways - 1) for r in rows])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([part * most + p[0] for p in places], pa.int64()),
             pa.array([total] + [None] * (len(rows) - 1), pa.list_(pa.int64()))], ["k1", "k2", "bundle", "sums"])

    schema = "k1 long, k2 long, bundle long, sums array<long>"
    return checkpointed(members.repartition(tasks, "k1", "k2").mapInArrow(run, schema))


def balance(groups: DataFrame, shards: int) -> DataFrame:
    """(k1, k2, shard): groups (k1, k2, bytes) put into ``shards`` shards."""
    spark = groups.sparkSession
    total = groups.agg(F.sum(F.col("bytes").cast("decimal(38,0)")).alias("t")).first().t
    large = F.col("bytes").cast("decimal(38,0)") * FAN >= F.lit(total)
    filling = groups.where(~large).orderBy("k1", "k2").limit(FAN).collect()
    single = groups.where(large).collect() + filling                          # at most FAN each
    last = filling[-1] if filling else None
    rest = groups.where(~large & (F.struct("k1", "k2") > F.struct(F.lit(last.k1), F.lit(last.k2)))) if last else groups.limit(0)
    placed, units = None, rest
    while placed is None or units.count() > FAN:
        found = _bundled(units, max(1, -(-units.count() // GROUPS_PER_TASK)))
        here = found.select("k1", "k2", "bundle")
        if placed is None:
            placed = here
        else:
            upper = here.select(F.col("k1").alias("bundle"), F.col("bundle").alias("upper"))
            placed = placed.join(upper, "bundle").select("k1", "k2", F.col("upper").alias("bundle"))
        first = F.col("bundle") - F.pmod("bundle", F.lit(BUNDLES))
        units = found.where("sums is not null").select(first.alias("first"), F.posexplode("sums").alias("at", "bytes")).where(
            "bytes > 0").select((F.col("first") + F.col("at")).alias("k1"), F.lit(0).cast("long").alias("k2"), "bytes")
    bundles = units.collect()                                                   # at most FAN
    members = [(r.bytes, 0, r.k1, r.k2) for r in single] + [(r.bytes, 1, r.k1, 0) for r in bundles]
    members.sort(key=lambda m: (-m[0], *m[1:]))
    places = difference([[m[0]] + [0] * (shards - 1) for m in members])[1] if members else []
    of_single = spark.createDataFrame([(m[2], m[3], p[0]) for m, p in zip(members, places) if m[1] == 0], "k1 long, k2 long, shard int")
    of_bundle = spark.createDataFrame([(m[2], p[0]) for m, p in zip(members, places) if m[1] == 1], "bundle long, shard int")
    return of_single.union(placed.join(F.broadcast(of_bundle), "bundle").select("k1", "k2", "shard"))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots count a shard's rows from 0, without gaps."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")))
    # slots: rows before this one's bucket in its shard, then the row's place in the bucket
    buckets = max(1, rows.count() // ROWS_PER_BUCKET)
    bucket = F.pmod(F.xxhash64("doc_id", "k1"), F.lit(buckets)).alias("bucket")
    placed = checkpointed(rows.join(balance(groups, shards), ["k1", "k2"]).select("doc_id", "size", "text_crc32", "k1", "shard", bucket))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").count().select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "k1")
    return placed.withColumn("n", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n")).alias("slot"))
