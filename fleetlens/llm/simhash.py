"""SimHash near-dedup (1): fingerprints of word shingles, linked by bit-sliced comparison.

Fingerprints are compared in buckets.  Two fingerprints at most ``radius`` bits apart agree on at
least one of radius + 1 bit blocks, so each distinct fingerprint goes into one bucket per block.  A
bucket above ``split_at`` is divided again by the blocks of its remaining bits (the same argument
holds there), and what is still above it after ``DEPTH`` divisions is compared chunk against chunk,
so no task grows with a bucket and no link is lost.

Within a bucket the comparison is bit-sliced: bit plane p holds bit p of 64 fingerprints in one
word, the distances of a fingerprint to all 64 are counted at once by carry-save bitwise counters,
and a block whose 64 lanes have all passed the radius is abandoned.  A bucket reports a spanning
forest of its links (its members linked to the smallest reachable one), never all its pairs.

Null and empty texts and texts without a word have fingerprint zero, linked like any other.
Equal texts share a fingerprint.  Rows with a null id keep their row; their component takes the
smallest known id (null if there is none).  Repeated rows stay.  An empty table gives no rows.
Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed, free_name, lean, row_key, texts, words
from fleetlens.llm.graph import components

SEED = 42
BITS = 64
DEPTH = 3
SPLIT_AT = 4096
SHINGLES_AT_ONCE = 1 << 16
COMBOS_AT_ONCE = 1 << 18
PLANES_BETWEEN_CHECKS = 8
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    seq = words(text.lower()) if text else []
    if not seq:
        return 0
    joined = b" ".join(seq)
    lengths = np.fromiter(map(len, seq), np.int64, len(seq))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(seq) - shingle + 1)
    last = ends[shingle - 1:] if len(seq) >= shingle else ends[-1:]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, SHINGLES_AT_ONCE):
        spans = zip(starts[lo:min(n, lo + SHINGLES_AT_ONCE)].tolist(), last[lo:lo + SHINGLES_AT_ONCE].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long), one row per row of ``docs``."""
    rows = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, fingerprint long")


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; a root is always the smallest index of its set."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))


def bucket_links(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (higher index, root index) of fingerprints within ``radius`` in the same bucket.

    ``prints`` (uint64) come sorted by ``bucket``.
    """
    n = len(prints)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.repeat(np.r_[new[1:], n], np.diff(np.r_[new, n]))
    rows = np.flatnonzero(end > np.arange(n) + 1)
    parent = np.arange(n)
    if len(rows) == 0:
        return rows, rows
    padded = np.zeros((n + 63) // 64 * 64, np.uint64)
    padded[:n] = prints
    planes = np.stack([np.packbits(((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
                       for p in range(BITS)])
    first, stop = (rows + 1) // 64, (end[rows] + 63) // 64
    width = stop - first
    total = np.cumsum(width)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + COMBOS_AT_ONCE, "right")))
        w = width[lo:hi]
        row = np.repeat(rows[lo:hi], w)
        word = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[lo:hi], w)
        _compare(prints, planes, row, word, end, radius, parent)
        lo = hi
    _unite(parent, rows[:0], rows[:0])
    linked = np.flatnonzero(parent != np.arange(n))
    return linked, parent[linked]


def _compare(prints, planes, row, word, end, radius, parent) -> None:
    """Distances of fingerprint row[i] to the 64 lanes of word[i]; lanes within radius are united."""
    lane0 = word * 64
    below = np.clip(row + 1 - lane0, 0, 63).astype(np.uint64)      # lanes at or before the row itself
    above = np.clip(lane0 + 64 - end[row], 0, 63).astype(np.uint64)   # lanes after the bucket
    out = ~((FULL << below) & (FULL >> above))
    counters = [np.zeros(len(row), np.uint64) for _ in range(max(1, radius.bit_length()))]
    query = prints[row]
    for p in range(BITS):
        carry = planes[p][word] ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))
        for c in range(len(counters)):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        out |= carry
        if p % PLANES_BETWEEN_CHECKS == PLANES_BETWEEN_CHECKS - 1:
            live = out != FULL
            if not live.any():
                return
            if live.mean() < 0.75:
                row, word, query, out = row[live], word[live], query[live], out[live]
                counters = [c[live] for c in counters]
    live = np.flatnonzero(out != FULL)
    for part in np.array_split(live, max(1, len(live) // 4096)):
        near = np.unpackbits((~out[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(near)
        a, b = row[part][i], word[part][i] * 64 + lane
        close = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        _unite(parent, a[close], b[close])


def _divide(rows: DataFrame, bits: int, radius: int) -> tuple[DataFrame, int]:
    """Rows (fingerprint, bucket, rest of ``bits`` bits) once per block of the rest, and the bits left."""
    width = bits // (radius + 1)
    rest = F.col("rest")
    parts = []
    for j in range(radius + 1):
        low = j * width
        take = width if j < radius else bits - low
        value = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << take) - 1))
        high = F.shiftleft(F.shiftrightunsigned(rest, low + take), low) if low + take < 64 else F.lit(0).cast("long")
        parts.append(F.struct(F.xxhash64("bucket", F.lit(j), value).alias("bucket"),
                              high.bitwiseOR(rest.bitwiseAND(F.lit((1 << low) - 1))).alias("rest")))
    out = rows.select("fingerprint", F.explode(F.array(*parts)).alias("p")).select("fingerprint", "p.bucket", "p.rest")
    return out, bits - width


def links(prints: DataFrame, radius: int = 3, split_at: int = SPLIT_AT) -> DataFrame:
    """(a, b): links between distinct fingerprints at most ``radius`` bits apart, spanning every component.

    ``prints`` has one column ``fingerprint`` of distinct signed longs.
    """
    rows = prints.select("fingerprint", F.lit(0).cast("long").alias("bucket"), F.col("fingerprint").alias("rest"))
    bits, ready = BITS, None
    for depth in range(DEPTH):
        rows, bits = _divide(rows, bits, radius)
        size = rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > split_at)
        if depth == DEPTH - 1:
            chunks = F.ceil(F.col("size") * 2 / split_at).cast("int")
            mine = F.pmod(F.xxhash64("fingerprint", F.lit(depth)), chunks).cast("int")
            pair = F.transform(F.sequence(F.lit(0), chunks - 1),
                               lambda c: F.xxhash64("bucket", F.least(c, mine), F.greatest(c, mine)))
            hot = rows.join(checkpointed(size), "bucket")
            small = rows.join(size, "bucket", "left_anti").select("fingerprint", "bucket")
            small = small.union(hot.select("fingerprint", F.explode(pair).alias("bucket")))
            ready = small if ready is None else ready.union(small)
            break
        size = checkpointed(size)
        if size.isEmpty():
            small, rows = rows, None
        else:
            small, rows = rows.join(size, "bucket", "left_anti"), rows.join(size, "bucket", "left_semi")
        small = small.select("fingerprint", "bucket")
        ready = small if ready is None else ready.union(small)
        if rows is None:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(f, b):
            hi, root = bucket_links(f.view(np.uint64), b, radius)
            return pa.RecordBatch.from_arrays([pa.array(f[hi]), pa.array(f[root])], ["a", "b"])

        f, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            f = np.concatenate([f, batch.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(f) >= 1 << 16 and b[0] != b[-1]:      # the last bucket may go on in the next batch
                cut = int(np.searchsorted(b, b[-1], "left"))
                yield report(f[:cut], b[:cut])
                f, b = f[cut:], b[cut:]
        yield report(f, b)

    return ready.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3, split_at: int = SPLIT_AT) -> DataFrame:
    """(doc_id, fingerprint long, component_id): component_id is the smallest id reachable by links."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = checkpointed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fingerprint"), radius, split_at))
    linked = classes.join(roots, classes.fingerprint == roots.node).select("fingerprint", "root", "first_id")
    low = linked.groupBy("root").agg(F.min("first_id").alias("low_id"))
    linked = linked.join(low, "root").select("fingerprint", "low_id")
    classes = classes.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("low_id", "first_id").alias("component_id"))
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                radius: int = 3, split_at: int = SPLIT_AT) -> DataFrame:
    """``docs``, all columns, with one row of every group of linked documents: the least by ``row_key`` (smallest
    id, null last; of one id the smaller hash of the text).  Rows alike in id and text are one document,
    of which the least row stays.  Other texts under a repeated id are documents of their own."""
    keyed = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = checkpointed(fingerprints(keyed, shingle=shingle))
    classes = checkpointed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fingerprint"), radius, split_at))
    linked = classes.join(roots, classes.fingerprint == roots.node, "left").select(F.coalesce("root", "fingerprint").alias("root"), "least")
    stay = linked.groupBy("root").agg(F.min("least").alias("key"))
    key = free_name("key", docs.columns)
    counts = prints.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n"))
    counts = counts.join(stay.select("key", F.lit(True).alias("stays")), "key", "left")
    # the rows to look at again: those of a document that goes, and repeated rows of one that stays
    marked = checkpointed(counts.where("stays is null or n > 1").select(F.col("key").alias(key), F.coalesce("stays", F.lit(False)).alias("stays")))
    mine = row_key(id_col, text_col)
    kept = docs.join(marked.select(key), mine == F.col(key), "left_anti")
    again = marked.where("stays").select(key)
    if again.isEmpty():
        return kept
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = free_name("row", docs.columns)
    least = docs.join(again, mine == F.col(key), "left_semi").groupBy(mine.alias(key)).agg(F.min(F.struct(*columns)).alias(row))
    return kept.unionByName(least.select(f"{row}.*"))
