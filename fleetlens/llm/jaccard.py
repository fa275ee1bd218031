"""N-gram Jaccard join (12): an exact set similarity join by segments of the token universe.

A document's set is its distinct shingles.  Sets whose sizes add up to t and whose Jaccard similarity
reaches num/den differ in at most H(t) = (den - num) t / (den + num) tokens.  Sizes fall into bands;
within a band the universe of tokens is hashed into m segments, a fixed number above the band's largest
H.  By pigeonhole a similar pair differs in few segments, so

1. it shares at least m - H segment subsets.  Every set posts its subsets (one key a segment); keys
   that only one set has are of no use, and a set left with too few shared keys has no partner at all.
   This leaves the sets that do have near ones, and few others;
2. for those a cost-based allocation picks the segments to probe: v = -1 (not), 0 (equal subset) or 1
   (also subsets that differ by one token, found through one-deletion neighbourhoods, which every
   ``DELETIONS``-th segment has), such that v + 1 over the segments adds up to more than H at the least
   number of postings visited.  Segments without a partner cost nothing, so common passages, empty
   segments and other long posting lists are avoided;
3. each key's most central set is first compared with the others of that key (one star a key; these
   comparisons are screened and verified as below).  The groups that this links need no further pair inside them, so a large group of near copies costs as
   many comparisons as it has postings, not pairs;
4. probes meet postings key by key; a pair of different groups is a candidate unless its parity bitmaps
   already differ in more than H bits.  Keys with many rows are dealt out chunk against chunk;
5. the bitmaps that go along with postings are short, and those of long sets say little.  So every pair is
   screened once more by sketches, parity bitmaps that grow with the set, before the sets themselves
   are sent;
6. the pairs that are left are verified on the whole sets.

A size band reaches into the one below it at most: a set posts its subsets in its own band and, if a
partner may be there, probes the band below with that band's segments.

Equal sets are one class (by 128 bits), of which each task posts one.  Shingles are compared by 64-bit
hashes.  Texts without a word, null texts included, have an empty set and are linked with nothing.  Rows
with a null id keep their row; their component takes the smallest known id (null if there is none).
Repeated rows stay.  A very long text is one array of hashes, 8 bytes a word.  An empty table gives no
rows.  Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed, lean, words
from fleetlens.llm.graph import components
from fleetlens.llm.stretches import Out, rows

#: Segments above the pigeonhole bound, as a share of it: what the allocation may leave out.
SPARE = 0.25
#: Every so many segments one has a one-deletion neighbourhood.
DELETIONS = 4
#: Bits of a parity bitmap for each token that two similar sets may differ in, and its largest size.
BITS_PER_TOKEN, MOST_BITS = 8, 1024
#: Rows of a key that one task compares; more are dealt out chunk against chunk.
SPLIT_AT = 4096
#: Parts that the comparisons with one set are dealt to.
PARTS = 4096
PAIRS_AT_ONCE = 1 << 18


@lru_cache(maxsize=None)
def _odd(label: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(label.encode()) | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _odd("mix/0")
    x = (x ^ (x >> np.uint64(29))) * _odd("mix/1")
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes | None, shingle: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (fewer words: of the whole sequence; no word: none)."""
    seq = words(text.lower()) if text else []
    if not seq:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, seq), np.uint64, len(seq))
    k = min(shingle, len(seq))
    n = len(seq) - k + 1
    s = np.full(n, _odd(f"length/{k}"), np.uint64)
    for j in range(k):
        s += h[j:j + n] * _odd(f"word/{j}")
    return np.unique(mix(s))


@dataclass(frozen=True)
class Law:
    """Similarity num / den as sizes and bands."""

    num: int
    den: int

    def apart(self, s: int, t: int) -> int:
        """Most tokens that similar sets of sizes s and t differ in."""
        return (self.den - self.num) * (s + t) // (self.den + self.num)

    def largest(self, s: int) -> int:
        return s * self.den // self.num

    def smallest(self, s: int) -> int:
        return -(-s * self.num // self.den)

    def band(self, s: int) -> tuple[int, int]:
        """The sizes (from, to) of the band of s: each band reaches so far beyond the one before that similar sets are in the same or in neighbours."""
        low = 1
        while (high := self._top(low)) < s:
            low = high + 1
        return low, high

    def _top(self, low: int) -> int:
        return max(low, self.largest(low), low * 3 // 2 - 1)

    def below(self, s: int) -> tuple[int, int] | None:
        """The band below that of s, if a partner may be there."""
        low, _ = self.band(s)
        return self.band(low - 1) if self.smallest(s) < low else None

    @lru_cache(maxsize=None)
    def segments(self, band: tuple[int, int]) -> int:
        most = self.apart(band[1], self.largest(band[1])) + 1
        return most + int(SPARE * most)

    def bits(self, band: tuple[int, int]) -> int:
        wanted = BITS_PER_TOKEN * (self.apart(band[1], self.largest(band[1])) + 1)
        return min(MOST_BITS, max(64, 1 << (wanted - 1).bit_length()))

    def sketch_bits(self, s: int) -> int:
        """Bits of the sketch of a set of size s: as many as its differences ask for, a small part of the set's own."""
        wanted = BITS_PER_TOKEN * (self.apart(s, self.largest(s)) + 1)
        return max(64, 1 << (wanted - 1).bit_length())

    @lru_cache(maxsize=1 << 16)
    def places(self, s: int) -> list[tuple[int, tuple[int, int], int]]:
        """(flag, band, most tokens apart) of a set of size s: 0 its own band, 1 the band below."""
        out = [(0, self.band(s), self.apart(s, self.largest(s)))]
        if (low := self.below(s)) is not None:
            out.append((1, low, self.apart(s, low[1])))
        return out


def _cut(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the m segments in the sorted hashes, and the sum of mixed tokens before each place."""
    segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    edges = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    return edges, np.r_[np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)]


def _named(sums: np.ndarray, segment: np.ndarray, band: tuple[int, int]) -> np.ndarray:
    name = np.uint64(int(_odd("band")) * band[0] % 2**64)
    return mix(mix(sums + segment.astype(np.uint64) * _odd("segment")) + name).view(np.int64)


def segment_keys(h: np.ndarray, band: tuple[int, int], m: int) -> np.ndarray:
    """One key for the subset of ``h`` in each of the m segments."""
    edges, before = _cut(h, m)
    return _named(before[edges[1:]] - before[edges[:-1]], np.arange(m), band)


def deletion_keys(h: np.ndarray, band: tuple[int, int], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, key) for each subset without one of its tokens, of the segments that have neighbourhoods."""
    edges, before = _cut(h, m)
    segment = np.repeat(np.arange(m), np.diff(edges))
    at = np.flatnonzero(segment % DELETIONS == 0)
    segment = segment[at]
    sums = before[edges[segment + 1]] - before[edges[segment]]
    return segment, _named(sums - mix(h[at]), segment, band)


def bitmap(h: np.ndarray, bits: int) -> bytes:
    """Bit b is the parity of the number of tokens that hash to it: two bitmaps differ in no more bits than the sets in tokens."""
    place = (mix(h) >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketches_apart(x: bytes, y: bytes) -> int:
    """Bits that two parity bitmaps differ in, the longer one folded to the size of the other: places are remainders by
    powers of two, so the parts of a bitmap add up to the shorter one of the same set."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, law: Law) -> DataFrame:
    """One row a row of ``docs``: doc_id, t (MD5 of the text), n, k1, k2 (class), and for the first row of a class in a
    task the keys of its own band and of the band below, each with the number that a partner must share."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col).cast("binary")).alias("t"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    names = ["n", "k1", "k2", "own", "own_need", "low", "low_need"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out: list[list] = [[] for _ in names]
                for text in part.column(2):
                    h = shingle_hashes(text.as_py(), shingle)
                    digest = xxhash.xxh3_128_intdigest(h.tobytes()) if len(h) else 0
                    k1, k2 = (np.array([digest >> 64, digest & (2**64 - 1)], np.uint64) & ~np.uint64(1)).view(np.int64).tolist()
                    row = [len(h), k1, k2, None, None, None, None]
                    if len(h) and digest not in seen:
                        seen.add(digest)
                        for flag, band, most in law.places(len(h)):
                            m = law.segments(band)
                            row[3 + 2 * flag:5 + 2 * flag] = segment_keys(h, band, m), m - most
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc_id", "t", *names])

    return checkpointed(given.mapInArrow(lean(run), f"doc_id {kind}, t string, n long, k1 long, k2 long, own array<long>, own_need long, "
                                                    "low array<long>, low_need long"))


def _let_go(df: DataFrame) -> None:
    """Shuffle files of finished steps are freed now: a step's own are still in use when it cuts its lineage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(1)


def _postings(sets: DataFrame) -> DataFrame:
    """(key, ref): a ref is a class with its last bit for the band below."""
    own = sets.select(F.explode("own").alias("key"), F.col("k1").alias("ref"))
    return own.unionAll(sets.select(F.explode("low").alias("key"), F.col("k1").bitwiseOR(F.lit(1)).alias("ref")))


def _shared(postings: DataFrame) -> DataFrame:
    """(key, n): keys of at least two refs, one of them in its own band."""
    return postings.groupBy("key").agg(F.count("*").alias("n"), F.min("ref").alias("a"), F.max("ref").alias("b"),
                                       F.min(F.col("ref").bitwiseAND(F.lit(1))).alias("flag")).where("a <> b AND flag = 0").select("key", "n")


def _hits(sets: DataFrame) -> DataFrame:
    """(key, ref, n) of the shared keys of the refs that may have a partner."""
    postings = _postings(sets)
    ends = postings.groupBy("key").agg(F.min("ref").alias("a"), F.max("ref").alias("b"))
    several = checkpointed(ends.where("a <> b").select("key"))      # few; written, so that what was shuffled for it goes
    _let_go(sets)
    hits = checkpointed(postings.join(several, "key").distinct())
    needs = sets.where("own IS NOT NULL").select(F.col("k1").alias("ref"), F.col("own_need").alias("need")).unionAll(
        sets.where("low IS NOT NULL").select(F.col("k1").bitwiseOR(F.lit(1)).alias("ref"), F.col("low_need").alias("need")))
    needs = needs.groupBy("ref").agg(F.max("need").alias("need"))
    _let_go(sets)
    alive = hits.groupBy("ref").agg(F.count("*").alias("found")).join(needs, "ref").where("found >= need").select("ref")
    hits = hits.join(alive, "ref", "left_semi").select("key", "ref")
    hits = checkpointed(hits.join(_shared(hits), "key"))      # what has no partner left no longer counts
    _let_go(sets)
    return hits


def _near_sets(docs: DataFrame, sets: DataFrame, hits: DataFrame, text_col: str, shingle: int, law: Law) -> DataFrame:
    """The classes that may have a partner: c, k2, n, h (sorted hashes), sketch, and for each band the keys, the one-deletion keys and the bitmap."""
    wanted = hits.select(F.col("ref").bitwiseAND(F.lit(-2)).alias("k1"), F.col("ref").bitwiseAND(F.lit(1)).alias("flag"))
    wanted = wanted.groupBy("k1").agg(F.min("flag").alias("first"), F.max("flag").alias("last"))
    chosen = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("t").alias("t")).join(wanted, "k1").groupBy("t").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = docs.select(F.md5(F.col(text_col).cast("binary")).alias("t"), F.col(text_col).cast("binary").alias("text")).join(chosen, "t")
    found = found.groupBy("t").agg(F.first("text").alias("text"), F.first("first").alias("first"), F.first("last").alias("last"))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("c", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("h", pa.binary()), ("sketch", pa.binary())]
                       + [(f"{x}{flag}", kind) for flag in (0, 1) for x, kind in (("keys", longs), ("segment", longs), ("deleted", longs), ("bitmap", pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema, 200)
        for _, text, first, last in rows(batches):
            h = shingle_hashes(text, shingle)
            digest = xxhash.xxh3_128_intdigest(h.tobytes())
            k1, k2 = (np.array([digest >> 64, digest & (2**64 - 1)], np.uint64) & ~np.uint64(1)).view(np.int64).tolist()
            given: list = [None] * 8
            for flag, band, _ in law.places(len(h)):
                if first <= flag <= last:
                    m = law.segments(band)
                    segment, deleted = deletion_keys(h, band, m)
                    given[4 * flag:4 * flag + 4] = segment_keys(h, band, m), segment, deleted, bitmap(h, law.bits(band))
            yield from out.add((k1, k2, len(h), h.tobytes(), bitmap(h, law.sketch_bits(len(h))), *given), 40 * len(h))
        yield from out.flush()

    kinds = ", ".join(f"keys{f} array<long>, segment{f} array<long>, deleted{f} array<long>, bitmap{f} binary" for f in (0, 1))
    found = checkpointed(found.mapInArrow(lean(run), f"c long, k2 long, n long, h binary, sketch binary, {kinds}"))
    twice = found.groupBy("c").agg(F.min("k2").alias("a"), F.max("k2").alias("b")).where("a <> b")
    if not twice.isEmpty():
        raise RuntimeError("two sets share 63 bits of their hash; give another seed in _odd")
    return found


def screened(pairs: DataFrame, near: DataFrame, law: Law) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sketches are close enough; no similar pair leaves."""
    left = near.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = near.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for a, b, n_a, n_b, x, y in rows(batches):
            if sketches_apart(x, y) <= law.apart(n_a, n_b):
                yield from out.add((a, b))
        yield from out.flush()

    return checkpointed(met.mapInArrow(lean(run), "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame, law: Law) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are similar, by their whole sets (c, h)."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    own = sets.select("c", "h")
    heads = pairs.select("a", "part").distinct().join(own, F.col("a") == F.col("c")).select("a", "part", F.lit(None).cast("long").alias("b"), "h")
    each = pairs.join(own, F.col("b") == F.col("c")).select("a", "part", "b", "h")
    met = heads.unionAll(each).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mine = Out(schema), np.empty(0, np.uint64)
        for a, _, b, h in rows(batches):
            theirs = np.frombuffer(h, np.uint64)
            if b is None:
                mine = theirs
                continue
            both = len(mine) + len(theirs)
            if min(len(mine), len(theirs)) * law.den < max(len(mine), len(theirs)) * law.num:
                continue
            merged = np.concatenate([mine, theirs])
            merged.sort(kind="stable")
            same = int((merged[1:] == merged[:-1]).sum())
            if law.den * same >= law.num * (both - same):
                yield from out.add((a, b))
        yield from out.flush()

    return checkpointed(met.mapInArrow(lean(run), "a long, b long"))


def _stars(hits: DataFrame, near: DataFrame, law: Law) -> DataFrame:
    """(a, b): the most central class of each key and every other class of that key that its bitmap is close enough to."""
    hits = hits.select("key", F.col("ref").bitwiseAND(F.lit(-2)).alias("c"), F.col("ref").bitwiseAND(F.lit(1)).alias("flag"), "n")
    centre = hits.groupBy("c").agg(F.sum("n").alias("weight"))
    hits = checkpointed(hits.join(centre, "c"))
    star = hits.where("flag = 0").groupBy("key").agg(F.max(F.struct("weight", "c")).alias("top")).select("key", F.col("top.c").alias("a"))
    pairs = hits.join(star, "key").where("a <> c").select("a", F.col("c").alias("b"), "flag").distinct()
    left = near.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("bitmap0").alias("bits_a"))
    right = near.select(F.col("c").alias("b"), F.col("n").alias("n_b"), "bitmap0", "bitmap1")
    met = pairs.join(right, "b").select("a", "b", "n_b", F.when(F.col("flag") == 0, F.col("bitmap0")).otherwise(F.col("bitmap1")).alias("bits_b"))
    met = met.join(left, "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for a, b, n_a, n_b, x, y in rows(batches):
            apart = np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()
            if apart <= law.apart(n_a, n_b):
                yield from out.add((a, b))
        yield from out.flush()

    return checkpointed(met.mapInArrow(lean(run), "a long, b long").distinct())


def allocate(found: list[dict], m: int, most: int) -> dict[int, int]:
    """v of each segment in ``found``: the cheapest choice whose v + 1 add up to more than ``most``.

    ``found`` has (segment, kind, n_full, n_deleted) for the keys that others have too: kind 0 is the
    segment's subset, 1 a subset without one token.
    """
    first: dict[int, int] = {}
    second: dict[int, int] = {}
    for x in found:
        s = x["segment"]
        if x["kind"] == 0:
            first[s] = first.get(s, 0) + x["full"] - 1
            second[s] = second.get(s, 0) + x["less"]
        else:
            first.setdefault(s, 0)
            second[s] = second.get(s, 0) + x["full"]
    v = {s: -1 for s in first}
    units = sum(1 + (s % DELETIONS == 0) for s in range(m) if s not in first)      # no partner, no cost
    steps = [(cost, 0, s) for s, cost in first.items()]
    steps += [(max(second[s], first[s]), 1, s) for s in first if s % DELETIONS == 0]
    for _, step, s in sorted(steps):
        if units > most:
            break
        v[s] = step
        units += 1
    return v


def _probes(near: DataFrame, law: Law) -> DataFrame:
    """(key, ref, kind, v) of every key that others have too, with the allocation of its set."""
    def of(flag: int) -> DataFrame:      # at: twice the segment, plus the kind
        ref = F.col("c").bitwiseOR(F.lit(flag)).alias("ref")
        full = near.select(ref, F.posexplode(f"keys{flag}").alias("segment", "key")).select("key", "ref", (F.col("segment").cast("long") * 2).alias("at"))
        less = near.select(ref, F.explode(F.arrays_zip(F.col(f"segment{flag}").alias("s"), F.col(f"deleted{flag}").alias("k"))).alias("x"))
        return full.unionAll(less.select(F.col("x.k").alias("key"), "ref", (F.col("x.s") * 2 + 1).alias("at")))

    keys = of(0).unionAll(of(1))
    ends = keys.groupBy("key").agg(F.min("ref").alias("a"), F.max("ref").alias("b"))
    several = checkpointed(ends.where("a <> b").select("key"))
    keys = checkpointed(keys.join(several, "key").select("key", "ref", F.shiftright("at", 1).alias("segment"), F.col("at").bitwiseAND(F.lit(1)).alias("kind")))
    counts = keys.groupBy("key").agg(F.count_if(F.col("kind") == 0).alias("full"), F.count_if(F.col("kind") == 1).alias("less")).where("full > 0")
    _let_go(near)
    found = keys.join(counts, "key").groupBy("ref").agg(F.collect_list(F.struct("segment", "kind", "full", "less", "key")).alias("found"))
    found = found.withColumn("c", F.col("ref").bitwiseAND(F.lit(-2))).join(near.select("c", "n"), "c").select("ref", "n", "found")
    schema = pa.schema([("key", pa.int64()), ("ref", pa.int64()), ("kind", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for ref, n, found in rows(batches):
            _, band, most = law.places(n)[ref & 1]
            v = allocate(found, law.segments(band), most)
            for x in found:
                yield from out.add((x["key"], ref, x["kind"], v[x["segment"]]))
        yield from out.flush()

    return checkpointed(found.mapInArrow(lean(run), "key long, ref long, kind long, v long"))


def close_pairs(n: np.ndarray, bits: np.ndarray, group: np.ndarray, c: np.ndarray, probes: np.ndarray, kind: np.ndarray, flag: np.ndarray,
                chunk: np.ndarray, law: Law) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of one key that may be similar; rows come sorted by group.

    A pair counts if one side probes for what the other is: v >= 0 for two subsets, v = 1 for a subset
    and one without a token.  ``chunk`` (0 or 1) keeps rows of the same chunk of a divided key apart: -1 for none.
    """
    ends = np.searchsorted(group, group, "right")
    todo = np.flatnonzero(ends < len(group))
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, lo + PAIRS_AT_ONCE // len(group))
        i = np.repeat(todo[lo:hi], len(group) - ends[todo[lo:hi]])
        width = len(group) - ends[todo[lo:hi]]
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(ends[todo[lo:hi]], width)
        full = (kind[i] == 0) & (kind[j] == 0)
        one = kind[i] + kind[j] == 1
        reach = np.maximum(probes[i], probes[j])
        ok = (full & (reach >= 0) | one & (reach == 1)) & (flag[i] + flag[j] < 2) & ((chunk[i] < 0) | (chunk[i] != chunk[j]))
        ok &= law.den * np.minimum(n[i], n[j]) >= law.num * np.maximum(n[i], n[j])
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = apart <= (law.den - law.num) * (n[i] + n[j]) // (law.den + law.num)
        yield i[ok], j[ok]
        lo = hi


def _candidates(probes: DataFrame, near: DataFrame, groups: DataFrame, law: Law, split_at: int) -> DataFrame:
    """(a, b): pairs of classes of different groups that meet under a key and whose bitmaps are close enough."""
    about = near.select(F.col("c").alias("c"), "n", F.col("bitmap0"), F.col("bitmap1")).join(groups, F.col("c") == F.col("node"), "left")
    about = about.select("c", "n", F.coalesce("root", "c").alias("group"), "bitmap0", "bitmap1")
    each = probes.withColumn("c", F.col("ref").bitwiseAND(F.lit(-2))).withColumn("flag", F.col("ref").bitwiseAND(F.lit(1)))
    grouped = each.join(about.select("c", "group"), "c")
    live = grouped.groupBy("key").agg(F.count("*").alias("size"), F.min("group").alias("x"), F.max("group").alias("y"), F.max("v").alias("most"),
                                      F.min("flag").alias("low")).where("x <> y AND most >= 0 AND low = 0").select("key", "size")
    each = each.join(live, "key").join(about, "c")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") * 2 / split_at)).cast("int")
    mine = F.pmod(F.xxhash64("c", "group"), chunks).cast("int")
    each = each.select("key", "c", "kind", "v", "flag", "n", "group", F.when(F.col("flag") == 0, F.col("bitmap0")).otherwise(F.col("bitmap1")).alias("bits"),
                       chunks.alias("chunks"), mine.alias("mine"))
    each = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("mine", "with"), F.greatest("mine", "with")
    # of a divided key: each pair of chunks is one task's; a chunk with itself where the pair is equal
    side = F.when(F.col("mine") == F.col("with"), -1).when(F.col("mine") < F.col("with"), 0).otherwise(1)
    each = each.select(F.xxhash64("key", low, high).alias("key"), "group", "c", "n", "kind", "v", "flag", side.cast("long").alias("side"), "bits")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Out = Out(schema)

        def met(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(held) < 2 or held[0][0] == held[-1][0] or min(x[5] for x in held) == 1:
                return
            group, c, n, kind, v, flag, side = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:7])
            bits = np.frombuffer(b"".join(x[7] for x in held), np.uint64).reshape(len(held), -1)
            found = set()
            for i, j in close_pairs(n, bits, group, c, v, kind, flag, side, law):
                found.update(zip(np.minimum(c[i], c[j]).tolist(), np.maximum(c[i], c[j]).tolist(), strict=True))
            for pair in found:
                yield from out.add(pair)

        now, held = None, []
        for key, *row in rows(batches):
            if key != now:
                yield from met(held)
                now, held = key, []
            held.append(row)
        yield from met(held)
        yield from out.flush()

    met = each.repartition("key").sortWithinPartitions("key", "group").mapInArrow(lean(run), "a long, b long")
    return met.distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, num: int = 85, den: int = 100,
         split_at: int = SPLIT_AT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a row of ``docs``: documents link where den * intersection >= num * union."""
    law = Law(num, den)
    sets = _sets(docs, id_col, text_col, shingle, law)
    classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low_id"))
    hits = _hits(sets)
    sets = checkpointed(sets.select("doc_id", "t", "n", "k1", "k2"))      # the keys have done their work
    _let_go(docs)
    near = _near_sets(docs, sets, hits, text_col, shingle, law)
    _let_go(docs)
    first = verified(screened(_stars(hits, near, law), near, law), near, law)
    groups = components(first)
    rest = verified(screened(_candidates(_probes(near, law), near, groups, law, split_at), near, law), near, law)
    links = first.unionAll(rest)
    groups = checkpointed(components(links))
    lows = classes.join(groups, F.col("k1") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k1"))
    lows = checkpointed(lows.select("k1", "k2", "root", "low_id"))
    smallest = lows.groupBy("root").agg(F.min("low_id").alias("component_id"))
    lows = lows.join(smallest, "root").select("k1", "k2", "component_id")
    out = sets.select("doc_id", "n", "k1", "k2").join(lows, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: Every pair that shares a shingle is counted; components by repeated reaching.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' '))) END AS s FROM d),
classes AS (SELECT min(r) AS c, min(doc_id) AS low, len(s) AS n, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reached(c, x) AS (SELECT a, a FROM links UNION SELECT reached.c, links.b FROM reached JOIN links ON links.a = reached.x),
lows AS (SELECT reached.c, min(low) AS component_id FROM reached JOIN classes ON classes.c = reached.x GROUP BY reached.c)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles,
  CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE coalesce(lows.component_id, classes.low) END AS component_id
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN lows ON lows.c = classes.c
"""
