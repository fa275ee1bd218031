"""Approximate nearest neighbours (4): stable projections, kd-trees, a chi-square stopping test.

Vectors are scaled to unit length (largest cosine = smallest Euclidean distance) and projected by
``projections`` (M) Gaussian (2-stable) directions: the squared projected distance of two vectors is
their squared distance times a chi-square variable with M degrees of freedom.  A query meets its neighbours in
order of projected distance and verifies each on the original vectors.  It stops when the next
projected distance delta satisfies CHI2_M(delta^2 / d_k^2) >= ``confidence``, d_k being the distance
of the k-th neighbour verified so far: anything closer would by then have been met with that
probability.

The index is distributed.  A kd-tree of median splits, fitted on a bounded sample of ``SAMPLE``
rows, divides the projected space into cells; every vector is indexed in its cell.  Equal vectors are
one class: its k + 1 smallest ids are indexed (others cannot be among the k nearest of anything), and
it is searched for once, for k + 1 rows, of which each of its queries takes the first k but itself.  A
cell with more than twice ``BLOCK`` rows is dealt out by hash into blocks of about ``BLOCK``, and the
classes that ask a cell into groups of about ``ASKS``, each with its copy of the block, so no task
grows with a cell.  A block has its own kd-tree with leaves of
``LEAF`` rows, whose boxes give the order of the projected distances.  A query first searches its own
block, which gives it a d_k; then the cells that the ball of its stopping radius touches, each with
that d_k to start from.  The few best of every block are merged.

Null vectors, those with a null or non-finite component, zero vectors and rows with a null id take no
part.  A cosine takes two vectors of one length: vectors of different lengths share no cell, each length
has its own tree, and a query's neighbours are among those of its length.  Vectors are first divided by
a power of two near their largest component, which changes no cosine, so components of any finite size
(1e200, 1e-200) neither overflow nor vanish.  Of rows with the same id the smallest vector counts.  Equal scores go to the smaller id.  With fewer than k
others, a query returns all it has.  An empty table gives no rows.  Only the two named columns are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed

M = 8                     # even: the chi-square distribution then has a closed form
LENGTH_AT = 1 << 32       # a cell's number is its length times this, and its node in the length's tree
SAMPLE = 20_000
BLOCK = 16_384
ASKS = 16_384
LEAF = 32
LEAVES_AT_ONCE = 8
SEED = 20
FOUND = "query_id long, vec_id long, score double"


def chi2_cdf(x: float, m: int = M) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def chi2_quantile(p: float, m: int = M) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def directions(size: int, m: int = M) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).normal(size=(size, m))


def median_tree(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Splits (dimension, threshold) of a complete binary tree with ``cells`` leaves (a power of two), in heap order."""
    tree: list[tuple[int, float]] = [(0, 0.0)] * cells
    member = {1: points}
    for node in range(1, cells):
        p = member.pop(node)
        spread = np.ptp(p, axis=0) if len(p) else np.zeros(points.shape[1])
        dim = int(spread.argmax())
        cut = float(np.median(p[:, dim])) if len(p) else 0.0
        tree[node] = (dim, cut)
        right = p[:, dim] >= cut
        member[2 * node], member[2 * node + 1] = p[~right], p[right]
    return tree


def cells_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    dims, cuts = np.array([d for d, _ in tree]), np.array([c for _, c in tree])
    for _ in range(len(tree).bit_length() - 1):
        node = 2 * node + (points[np.arange(len(points)), dims[node]] >= cuts[node])
    return node


def cells_within(point: np.ndarray, radius: float, tree: list[tuple[int, float]]) -> list[int]:
    """Cells whose region has a point at most ``radius`` from ``point``."""
    out, todo = [], [(1, np.zeros(len(point)))]
    while todo:
        node, off = todo.pop()
        if node >= len(tree):
            out.append(node)
            continue
        dim, cut = tree[node]
        near = 2 * node + (point[dim] >= cut)
        todo.append((near, off))
        far = off.copy()
        far[dim] = max(far[dim], abs(point[dim] - cut))
        if far @ far <= radius * radius:
            todo.append((near ^ 1, far))
    return out


class Block:
    """Vectors of one block in a kd-tree over their projections, as leaves with bounding boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.points = (vectors / self.norms[:, None]) @ project
        parts, leaves = [np.arange(len(ids))], []
        while parts:
            part = parts.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            p = self.points[part]
            order = np.argpartition(p[:, np.ptp(p, axis=0).argmax()], len(part) // 2)
            parts += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
        self.leaves = leaves
        self.verified = 0         # vectors compared with a query so far
        self.low = np.array([self.points[x].min(axis=0) for x in leaves])
        self.high = np.array([self.points[x].max(axis=0) for x in leaves])

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, d2: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest met before the stopping test holds; ``d2`` is a d_k^2 known before."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        bound = (gap * gap).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        norm = np.sqrt((vector * vector).sum())
        ids, scores = np.empty(0, np.int64), np.empty(0)
        for lo in range(0, len(order), LEAVES_AT_ONCE):
            if bound[order[lo]] > stop * d2:              # CHI2(delta^2 / d_k^2) >= confidence
                break
            some = order[lo:lo + LEAVES_AT_ONCE]
            rows = np.concatenate([self.leaves[i] for i in some])
            self.verified += len(rows)
            # one sum per row, in one order: equal vectors get equal scores
            score = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, score])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                d2 = min(d2, max(0.0, 2 - 2 * scores[-1]) + 1e-12)
        return ids, scores


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each divided by a power of two so that its largest component is in [0.5, 1)."""
    flat = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for every length that occurs."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, _matrix(column.take(pa.array(at)))


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, queries, k: int = 5, confidence: float = 0.95, id_col: str = "vec_id",
            vector_col: str = "embedding", projections: int = M) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every vector whose id satisfies ``queries``
    (a function from the id column to a condition).  ``projections`` is even; with a smaller ``confidence``
    less is verified, at the price of recall."""
    spark = vectors.sparkSession
    every = checkpointed(clean(vectors, id_col, vector_col))
    equal = Window.partitionBy("v").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = every.select("*", F.row_number().over(equal).alias("place"), F.min("vec_id").over(equal).alias("class"))
    rows = checkpointed(rows.where(F.col("place") <= k + 1).select("vec_id", "v", "class"))      # cut before the shuffle too
    totals = {r.length: r.n for r in rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).collect()}   # one per length
    if not totals:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()          # bounded
    trees = {}
    for _, x in _by_length(sample.column("v").combine_chunks()):
        cells = 1 << max(0, math.ceil(math.log2(max(1, min(totals[x.shape[1]] / BLOCK, len(x) / 8)))))
        trees[x.shape[1]] = median_tree(_unit(x) @ directions(x.shape[1], projections), cells)
    stop = chi2_quantile(confidence, projections)
    one_cell = [(0, 0.0)]                                                                  # of a length that the sample lacks

    def points_of(x: np.ndarray) -> np.ndarray:
        return _unit(x) @ directions(x.shape[1], projections)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.empty(batch.num_rows, np.int64)
                for at, x in _by_length(batch.column(1)):
                    cell[at] = cells_of(points_of(x), trees.get(x.shape[1], one_cell)) + x.shape[1] * LENGTH_AT
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "class", "cell"])

    placed = rows.mapInArrow(place, "vec_id long, v array<double>, class long, cell long")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))   # one row per cell
    parts = checkpointed(parts)
    placed = checkpointed(placed.join(F.broadcast(parts), "cell").select(
        "vec_id", "v", "class", "cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part")))
    heads = placed.where(F.col("vec_id") == F.col("class")).drop("class")
    wanted = every.where(queries(F.col("vec_id"))).join(heads.select("v", F.col("vec_id").alias("class")), "v").select("vec_id", "class")
    wanted = checkpointed(wanted)                                                                # every query and its class
    asked = checkpointed(heads.join(wanted.select(F.col("class").alias("vec_id")).distinct(), "vec_id", "left_semi"))
    placed = placed.drop("class")

    def search(asked: DataFrame, placed: DataFrame, *group: str) -> DataFrame:
        """Of (vec_id, v, cell, part, d2, group): the k + 1 nearest of each class in that block, itself included."""
        def run(key, block: pa.Table, asks: pa.Table) -> pa.Table:
            out = []
            if len(asks) and len(block):
                q = _matrix(asks.column("v").combine_chunks())
                index = Block(block.column("vec_id").to_numpy(), _matrix(block.column("v").combine_chunks()),
                              directions(q.shape[1], projections))
                points = points_of(q)
                for i, (qid, d2) in enumerate(zip(asks.column("vec_id").to_pylist(), asks.column("d2").to_pylist())):
                    ids, scores = index.search(q[i], points[i], k + 1, d2, stop)
                    out.append((np.full(len(ids), qid, np.int64), ids, scores))
            columns = [np.concatenate([o[j] for o in out]) if out else [] for j in range(3)]
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        return placed.groupBy("cell", "part", *group).cogroup(asked.groupBy("cell", "part", *group)).applyInArrow(run, FOUND)

    first = checkpointed(search(asked.withColumn("d2", F.lit(4.0)), placed))                      # a block asks itself: bounded
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    d2 = F.when(F.col("n") > k, F.least(F.greatest(F.lit(2.0) - 2 * F.col("worst"), F.lit(0.0)) + 1e-12, F.lit(4.0))).otherwise(4.0)
    known = asked.join(known, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "cell", "part", F.coalesce(d2, F.lit(4.0)).alias("d2"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d2, reach = batch.column(4).to_numpy(), [[]] * batch.num_rows
                for at, x in _by_length(batch.column(1)):
                    tree, base = trees.get(x.shape[1], one_cell), x.shape[1] * LENGTH_AT
                    for i, p in zip(at, points_of(x)):
                        reach[i] = [base + c for c in cells_within(p, math.sqrt(stop * d2[i]), tree)]
                which = np.repeat(np.arange(batch.num_rows), [len(r) for r in reach])
                part = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), part.column(3), part.column(4),
                     pa.array([c for r in reach for c in r], pa.int64())], ["vec_id", "v", "cell", "part", "d2", "to"])

    far = checkpointed(known.mapInArrow(spread, "vec_id long, v array<double>, cell long, part int, d2 double, to long"))
    groups = checkpointed(far.groupBy("to").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("groups")))   # one row per cell
    far = far.join(F.broadcast(parts.withColumnRenamed("cell", "to")), "to").join(F.broadcast(groups), "to").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
    far = far.where((F.col("to") != F.col("cell")) | (F.col("to_part") != F.col("part"))).select(
        "vec_id", "v", F.col("to").alias("cell"), F.col("to_part").alias("part"), "d2",
        F.pmod(F.xxhash64("vec_id"), "groups").cast("int").alias("group"))
    copies = placed.join(F.broadcast(groups.withColumnRenamed("to", "cell")), "cell").select(
        "vec_id", "v", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.union(search(far, copies, "group")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    found = found.groupBy(F.col("query_id").alias("class")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    others = F.filter("best", lambda x: x["vec_id"] != F.col("vec_id"))
    out = wanted.join(found, "class").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
