"""Benchmark decontamination (6), native: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased and cut into words of letters and digits; a document contains an item if at
least ``threshold`` of the item's distinct five-word shingles occur in the document.

Search.  Shingles are ordered by a 64-bit hash.  An item's sketch is its k smallest hashes, with
k = s - ceil(threshold s) + 1 for s shingles: a document that contains the item misses at most k - 1
of its shingles, so it has at least one of the sketch.  Documents are partitioned by size (powers of
two of their number of shingles).  A partition is only searched for items it can hold, and has a
bound of its own: the largest sketch hash of those items.  Only a document's hashes up to that bound
are exploded and joined to the sketches, so no candidate is missed and most shingles never leave
their row.  Short items in long documents cost nothing extra, as documents are not sketched.

Verification.  Only candidate documents are read again; their distinct shingles are joined, as text,
to the items' shingles and counted.

The items' tables are broadcast only below ``BROADCAST_ROWS`` rows; above, the joins shuffle.  A
passage found in a third of all documents gives one row per document and item.  Items with equal
words are one item, named by its smallest id, with their number in ``n_items``.

Null texts, and texts without a letter or digit, have no shingles and take no part; texts of fewer
than five words have one, the whole sequence.  Rows with a null id take no part.  Rows with the same
id count as one document (the best containment).  Empty tables give no rows.  Only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed

NOT_A_WORD = r"[^\p{L}\p{N}]+"
BROADCAST_ROWS = 200_000
PARTITIONS = 40


def word_list(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), NOT_A_WORD), "")


def _starts(words: Column, shingle: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1)))


def _with_hashes(rows: DataFrame, shingle: int) -> DataFrame:
    """``hashes``: the distinct hashes of the shingles of ``words``.  Words are hashed once, then runs of them."""
    rows = rows.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
    run = lambda i: F.xxhash64(*[F.get("wh", i - 1 + j) for j in range(shingle)])   # noqa: E731  missing words are null
    return rows.withColumn("hashes", F.array_distinct(F.transform(_starts(F.col("wh"), shingle), run))).drop("wh")


def _shingle_texts(words: Column, shingle: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, shingle), lambda i: F.array_join(F.slice(words, i, shingle), " ")))


def _bounded(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast if its counted rows allow it."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5,
                    doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_items, n_shingles, n_found, containment) of every contained item."""
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t is not null")
    tests = tests.select("item_id", word_list("t").alias("words")).where(F.size("words") > 0)
    tests = tests.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    tests = checkpointed(_with_hashes(tests, shingle))
    # the product is rounded first: 0.8 * 5 must count as 4, not as a little more
    need = F.ceil(F.round(F.lit(threshold) * F.size("hashes"), 9)).cast("int")
    sketches = tests.select("item_id", need.alias("need"), F.slice(F.array_sort("hashes"), 1, F.size("hashes") - need + 1).alias("sketch"))
    part = F.floor(F.log2(F.col("need").cast("double"))).cast("int")
    bounds = sketches.groupBy(part.alias("part")).agg(F.max(F.element_at("sketch", -1)).alias("bound")).collect()   # at most 64 rows
    bound_of, best = [], None
    for p in range(PARTITIONS):
        best = max([r.bound for r in bounds if r.part == p] + ([best] if best is not None else []), default=None)
        bound_of.append(best)
    bound_array = F.array(*[F.lit(b).cast("long") for b in bound_of])

    # asked of the text, not of its words, which would be cut twice
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("t")).where(
        F.col("doc_id").isNotNull() & F.col("t").rlike(r"[\p{L}\p{N}]"))
    hashed = _with_hashes(rows.select("doc_id", word_list("t").alias("words")), shingle)
    size_part = F.least(F.floor(F.log2(F.size("hashes").cast("double"))).cast("int"), F.lit(PARTITIONS - 1))
    hashed = hashed.select("doc_id", "hashes", F.get(bound_array, size_part).alias("bound"))
    low = hashed.select("doc_id", F.explode(F.filter("hashes", lambda h: h <= F.col("bound"))).alias("h"))
    probes = _bounded(sketches.select(F.explode("sketch").alias("h")).distinct())
    candidates = checkpointed(low.join(probes, "h", "left_semi").select("doc_id").distinct())

    wanted = rows.join(_bounded(candidates), "doc_id", "left_semi").select("doc_id", "t")
    wanted = wanted.select("doc_id", F.monotonically_increasing_id().alias("row"), word_list("t").alias("words"))
    have = wanted.select("doc_id", "row", F.explode(_shingle_texts(F.col("words"), shingle)).alias("s"))
    asked = tests.select("item_id", "n_items", _shingle_texts(F.col("words"), shingle).alias("all"))
    asked = asked.select("item_id", "n_items", F.size("all").cast("long").alias("n_shingles"), F.explode("all").alias("s"))
    found = have.join(_bounded(asked), "s").groupBy("doc_id", "row", "item_id", "n_items", "n_shingles").agg(F.count("*").alias("n_found"))
    found = found.groupBy("doc_id", "item_id", "n_items", "n_shingles").agg(F.max("n_found").alias("n_found"))
    return found.where(F.col("n_found") >= F.round(F.lit(threshold) * F.col("n_shingles"), 9)).select(
        "doc_id", "item_id", "n_items", "n_shingles", "n_found",
        (F.col("n_found").cast("double") / F.col("n_shingles").cast("double")).alias("containment"))


ORACLE = r"""
WITH words AS (
  SELECT 'doc' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL
  SELECT 'item', min(id), w FROM (
    SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY w),
n_equal AS (
  SELECT min(id) AS id, count(*) AS n_items FROM (
    SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY w),
sh AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n_shingles FROM sh WHERE kind = 'item' GROUP BY id),
found AS (
  SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_found
  FROM sh d JOIN sh q ON d.s = q.s AND d.kind = 'doc' AND q.kind = 'item' GROUP BY 1, 2)
SELECT doc_id, item_id, n_items, n_shingles, n_found, n_found::DOUBLE / n_shingles::DOUBLE AS containment
FROM found JOIN sizes ON item_id = sizes.id JOIN n_equal ON item_id = n_equal.id
WHERE n_found >= round(0.8 * n_shingles, 9)
"""
