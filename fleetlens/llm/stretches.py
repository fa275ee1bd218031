"""Tables in order: groups whose rows lie one after another over several partitions.

``in_order`` deals rows by range, so a group of any size is cut into stretches, one a task.  A running
value over a group is then two passes: each task sums up its first and last group (``summaries``), the
driver combines these (at most two rows a partition), and the second pass starts from what precedes.
``digests`` hashes the pieces of each group in order; SHA-256 has no parallel form, so of a group that
is cut or long the pieces meet again, joined to blocks, in one stream that holds one block at a time.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed, lean

#: Bytes of a group that travel together to be hashed.
BLOCK = 1 << 16


def in_order(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` dealt by range over ``group + order`` and sorted (nulls first), written to the checkpoint folder."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    return checkpointed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))


def summaries(df: DataFrame, summed: Callable[[Iterator[pa.RecordBatch]], tuple | None]) -> dict[int, tuple]:
    """What ``summed`` gives for each partition that has rows, by partition, on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = summed(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(found)], pa.binary())], ["p", "s"])

    return {r.p: pickle.loads(bytes(r.s)) for r in df.mapInArrow(lean(run), "p long, s binary").collect()}


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``batches`` as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class Out:
    """Rows collected into record batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 8192, most_bytes: int = 1 << 22):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.held, self.size = [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.size += size
        if len(self.held) >= self.most or self.size >= self.most_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = zip(*self.held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.held, self.size = [], 0


class _Group:
    """One group of a partition: its first block is held, what is beyond goes out block by block."""

    def __init__(self, key: tuple, cut: bool):
        self.key, self.cut = key, cut           # cut: it may go on from the partition before, or has sent a block
        self.block, self.marks, self.size, self.sent, self.pieces = [], [], 0, 0, 0

    def take(self) -> tuple:
        row = (b"".join(self.block), "".join(self.marks), self.pieces)
        self.block, self.marks, self.size, self.pieces = [], [], 0, 0
        self.sent += 1
        return row


def digests(df: DataFrame, group: list[str], piece: str, mark: str, sep: str) -> DataFrame:
    """(group columns, sha256 of the group's pieces joined by ``sep``, marks joined), one row a group.

    ``df`` has its rows in order within and across partitions.  A null piece is not hashed; its mark counts.
    """
    schema = df.select(*group).schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    df = df.select(*group, F.col(piece).cast("binary"), F.col(mark))
    arrow = [pa.field(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.int64()) for f in schema]
    first_pass = pa.schema([*arrow, ("part", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary()), ("marks", pa.string()),
                            ("pieces", pa.int64()), ("sha256", pa.string())])
    width, glue = len(arrow), sep.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, now = TaskContext.get().partitionId(), Out(first_pass), None

        def close(last: bool):
            if now.cut or last:
                block, marks, pieces = now.take()
                yield from out.add((*now.key, part, now.sent, block, marks, pieces, None), len(block))
            else:
                yield from out.add((*now.key, part, 0, None, "".join(now.marks), now.pieces, hashlib.sha256(b"".join(now.block)).hexdigest()))

        for row in rows(batches):
            if now is None or row[:width] != now.key:
                if now is not None:
                    yield from close(False)
                now = _Group(row[:width], now is None)
            data, letter = row[width], row[width + 1]
            if data is not None:
                if now.pieces:
                    now.block.append(glue)
                now.block.append(data)
                now.pieces += 1
                now.size += len(data) + len(glue)
            now.marks.append(letter)
            if now.size + len(now.marks) >= BLOCK:
                block, marks, pieces = now.take()
                now.cut = True
                yield from out.add((*now.key, part, now.sent, block, marks, pieces, None), len(block))
        if now is not None:
            yield from close(True)
        yield from out.flush()

    done = pa.schema([*arrow, ("sha256", pa.string()), ("marks", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key = Out(done), None
        for row in rows(batches):
            if key is None or row[:width] != key:
                if key is not None:
                    yield from out.add((*key, digest.hexdigest(), "".join(marks)))
                key, digest, marks, any_piece = row[:width], hashlib.sha256(), [], False
            _, _, block, letters, pieces, _ = row[width:]
            if pieces:
                digest.update(glue + block if any_piece else block)
                any_piece = True
            marks.append(letters)
        if key is not None:
            yield from out.add((*key, digest.hexdigest(), "".join(marks)))
        yield from out.flush()

    found = checkpointed(df.mapInArrow(lean(cut), f"{kinds}, part long, n long, bytes binary, marks string, pieces long, sha256 string"))
    whole = found.where(F.col("sha256").isNotNull()).select(*group, "sha256", "marks")
    parts = found.where(F.col("sha256").isNull()).repartition(*group).sortWithinPartitions(*group, "part", "n")
    return whole.unionByName(parts.mapInArrow(lean(fold), f"{kinds}, sha256 string, marks string"))
