"""Helpers shared by the operators: table access, lineage cuts, byte-level words."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config


#: Rows per Arrow batch: whole texts are long, and a worker holds a batch in memory twice.
ARROW_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Session settings of the registered queries and the pipeline, changed only where they hold the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names: (doc_id, text as UTF-8 bytes)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it (names differ by more than case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of the row by id and text (128 bits of hash), ordered by id, null ids last; no part of it is null."""
    number, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    return F.struct(number.isNull().alias("unknown"), F.coalesce(number, F.lit(0)).alias("id"),
                    F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text, text.isNull()).alias("h2"))


def with_own_ids(docs: DataFrame, own: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``own`` (long): the id, but for rows with a null id or an id that an earlier text
    (by ``row_key``) has too; these get numbers of their own above all ids, in the order of ``row_key``.  Rows alike in id and text share one."""
    rows = docs.select(row_key(id_col, text_col).alias("key"))
    ids = rows.groupBy("key.unknown", "key.id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    clashes = checkpointed(ids.where("unknown or low != high"))
    number = F.col(f"`{id_col}`").cast("long")
    if clashes.isEmpty():
        return docs.withColumn(own, number)
    top = docs.agg(F.max(number)).first()[0] or 0
    extra = rows.join(clashes, (F.col("key.unknown") == F.col("unknown")) & (F.col("key.id") == F.col("id")))
    extra = checkpointed(extra.where("unknown or key != low").select("key").distinct().orderBy("key"))
    key, place = free_name("key", docs.columns), free_name("place", docs.columns)
    numbers = checkpointed(extra.select(F.col("key").alias(key), (F.monotonically_increasing_id() + F.lit(top + 1)).alias(place)))
    out = docs.join(numbers, row_key(id_col, text_col) == F.col(key), "left")
    return out.withColumn(own, F.coalesce(F.col(place), number)).select(*[F.col(f"`{c}`") for c in docs.columns], own)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    Shuffle files of earlier steps that nothing refers to any more are released here: Spark frees
    them when the driver collects garbage, which may otherwise not happen during a long job.
    """
    config.checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def lean(run):
    """``run`` (a function of batches for mapInArrow) that hands freed memory back to the system when it
    ends; a worker that waits for its next task would keep it."""
    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes: exactly the white space ``bytes.split`` knows."""
    return text.split() if text else []
