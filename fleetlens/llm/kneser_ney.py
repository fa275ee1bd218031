"""LM scoring (9): an interpolated modified Kneser-Ney bigram model in memory-mapped sorted hash arrays.

Tokens are the words of a text, A-Z lower-cased, then one end; the end of a text is the context of
the next text's first word.  With c counts, and D(1), D(2), D(3+) the discounts estimated from the
counts of counts of each order,

    p(w | u) = (c(u w) - D(c(u w))) / c(u) + gamma(u) p(w)      (p(w) alone if u is unknown)
    p(w)     = (t(w) - D(t(w))) / B + gamma / (V + 1)

where t(w) is the number of different contexts of w, B the number of different bigrams, V the number
of different tokens; gamma takes what the discounts leave.  An unknown word has gamma / (V + 1).

Counting runs in Spark in three steps, each a map side that combines some millions of tokens into
sorted arrays, a shuffle of these arrays, delta-coded and compressed, by shard, and one task per
shard that merges them and writes the result, sorted by hash, into the model's folder:

1. words: sorted 64-bit word hashes and counts, sharded by hash range; a word's number is its rank;
2. bigrams: sorted keys (number of u times V plus number of w) and counts, sharded by a hash of the
   key, so that the bigrams of a frequent word are spread;
3. per word, its numbers of bigrams seen once, twice, and more often as context, and t(w).

Workers map the arrays into memory and look up the sorted, distinct words and bigrams of some texts
at a time; nothing of the model's size is read into a worker's or the driver's memory.  The folder
must be one that all workers can map (by default inside ``spark.checkpoint.dir``); files are written
under a temporary name and renamed, so a task that is run again replaces them by the same.

Null and empty texts are one token, the end.  Rows with a null id are scored like others.  Repeated
rows count and are scored each.  With no training text every token has probability 1 / (V + 1) = 1.
An empty table gives no rows.  Only the two named columns are read.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.llm.common import texts, words

#: Tokens that a map task combines, and scores, at a time; bytes of text per shard.
CHUNK = 1 << 20
SCORED = 1 << 18
SHARD_BYTES = 16 << 20
#: No word has a space in it.
END = xxhash.xxh3_64_intdigest(b" end")
MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Sorted or small numbers: differences, byte planes, compressed."""
    delta = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def shared_folder(spark, folder: str | None) -> str:
    """``folder``, or the shared checkpoint folder, as a path that workers can open."""
    at = folder or config.checkpoint_dir(spark)
    if at.startswith("file:"):
        at = "/" + at[5:].lstrip("/")
    if "://" in at:
        raise ValueError(f"workers cannot map files in {at}: name a mounted shared folder")
    return at


def _save(path: str, array: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _map(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the tokens of one text, the end last."""
    seq = words(text.lower()) if text else []
    out = np.empty(len(seq) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, seq), np.uint64, len(seq))
    out[-1] = END
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens of some rows one after another, their numbers of tokens)."""
    held, first, size = [], 0, 0
    for i, text in enumerate(column):
        held.append(tokens(text.as_py()))
        size += len(held[-1])
        if size >= SCORED or i + 1 == len(column):
            yield first, np.concatenate(held), np.array([len(h) for h in held], np.int64)
            held, first, size = [], i + 1, 0


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The tokens of whole texts, at least CHUNK at a time but for the last."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(1):
            held.append(tokens(text.as_py()))
            size += len(held[-1])
            if size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _merged(table: pa.Table, *columns: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts, of packed (keys, counts) rows."""
    keys = np.concatenate([unpack(x) for x in table.column(columns[0]).to_pylist()])
    counts = np.concatenate([np.diff(unpack(x), prepend=np.uint64(0)) for x in table.column(columns[1]).to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[start], np.add.reduceat(counts, start)


def _range_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _key_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * MIX
    return _range_shard(mixed ^ (mixed >> np.uint64(29)), shards)


def discounts(n: list[int]) -> list[float]:
    """D(0), D(1), D(2), D(3+) from the numbers of items seen once to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ask = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0] + [min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(ask, 1)]


@dataclass
class Model:
    folder: str
    shards: int
    offsets: list[int]          # first word number of every word shard, and V
    n_tokens: int
    n_bigrams: int
    of_bigrams: list[float]     # discounts
    of_words: list[float]
    gamma: float                # what the words' discounts leave

    @property
    def n_words(self) -> int:
        return self.offsets[-1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted distinct hashes, -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        shard = _range_shard(hashes, self.shards)
        for s in np.unique(shard).tolist():
            lo, hi = np.searchsorted(shard, [s, s + 1])
            if self.offsets[s + 1] > self.offsets[s]:
                known = _map(f"{self.folder}/words-{s}.npy")
                at = np.minimum(np.searchsorted(known, hashes[lo:hi]), len(known) - 1)
                out[lo:hi] = np.where(known[at] == hashes[lo:hi], at + self.offsets[s], -1)
        return out

    def word_rows(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Rows of a per-word array for sorted known numbers."""
        cut = np.searchsorted(numbers, self.offsets)
        parts = [_map(f"{self.folder}/{name}-{s}.npy")[numbers[cut[s]:cut[s + 1]] - self.offsets[s]]
                 for s in range(self.shards) if cut[s + 1] > cut[s]]
        return np.concatenate(parts).astype(np.float64)

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys, 0 if unseen."""
        out = np.zeros(len(keys))
        shard = _key_shard(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            mine = order[cut[s]:cut[s + 1]]
            path = f"{self.folder}/bigrams-{s}.npy"
            if len(mine) and os.path.exists(path):
                known = _map(path)
                at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                hit = known[at] == keys[mine]
                out[mine[hit]] = _map(f"{self.folder}/bigram-counts-{s}.npy")[at[hit]]
        return out

    def token_scores(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens of several texts: counts c(w), base probability and model probability."""
        distinct, which = np.unique(flat, return_inverse=True)
        number = self.numbers(distinct)
        count, stats = np.zeros(len(distinct)), np.zeros((len(distinct), 4))
        known = number >= 0
        if known.any():
            count[known] = self.word_rows("counts", number[known])
            stats[known] = self.word_rows("stats", number[known])
        uniform = 1 / (self.n_words + 1)
        if self.n_bigrams:
            t = stats[:, 3]
            low = np.maximum(t - np.array(self.of_words)[np.minimum(t, 3).astype(int)], 0) / self.n_bigrams + self.gamma * uniform
        else:
            low = np.full(len(distinct), uniform)
        base = (count + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1))
        seen = np.maximum(count, 1)
        gamma = np.where(count > 0, stats[:, :3] @ np.array(self.of_bigrams[1:]) / seen, 1.0)

        end = int(np.searchsorted(distinct, np.uint64(END)))
        before = np.empty(len(flat), np.int64)
        before[1:] = which[:-1]
        before[np.cumsum(lengths) - lengths] = end
        both = np.flatnonzero(known[before] & known[which])
        key = number[before[both]].astype(np.uint64) * np.uint64(max(1, self.n_words)) + number[which[both]].astype(np.uint64)
        keys, of_key = np.unique(key, return_inverse=True)
        pair = np.zeros(len(flat))
        pair[both] = self.bigram_counts(keys)[of_key]
        high = np.maximum(pair - np.array(self.of_bigrams)[np.minimum(pair, 3).astype(int)], 0) / seen[before]
        return count[which], base[which], high + gamma[before] * low[which]

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity): scores are log10 probabilities."""
        rows = texts(docs, id_col, text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, flat, lengths in _chunks(batch.column(1)):
                    count, base, model = self.token_scores(flat, lengths)
                    start = np.cumsum(lengths) - lengths
                    score = np.add.reduceat(np.log10(model), start)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(lengths)), pa.array(lengths), pa.array(np.add.reduceat((count > 0).astype(np.int64), start)),
                         pa.array(np.full(len(lengths), self.n_tokens)), pa.array(np.add.reduceat(np.log10(base), start)), pa.array(score),
                         pa.array(10 ** (-score / lengths))],
                        ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

    def delete(self) -> None:
        """Remove the model's own folder."""
        shutil.rmtree(self.folder)


def _sent(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row (shard, packed keys, packed counts) per shard, of keys sorted within their shard."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    some = [s for s in range(shards) if cut[s + 1] > cut[s]]
    body = [pack(keys[cut[s]:cut[s + 1]]) for s in some]
    sums = [pack(np.cumsum(counts[cut[s]:cut[s + 1]])) for s in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(body, pa.binary()), pa.array(sums, pa.binary())],
                                      ["shard", "keys", "counts"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> Model:
    """Count the model over all rows of ``docs``; its arrays go to a new folder inside ``folder``."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark, folder)}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(path)
    rows = texts(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-total // SHARD_BYTES))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in _joined(batches):
            hashes, counts = np.unique(flat, return_counts=True)
            yield _sent(hashes, counts, _range_shard(hashes, shards), shards)

    def merge_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        hashes, counts = _merged(table, "keys", "counts")
        _save(f"{path}/words-{s}.npy", hashes)
        _save(f"{path}/counts-{s}.npy", counts)
        return pa.table({"shard": [s], "n": [len(hashes)], "total": [int(counts.sum())]})

    sent = "shard long, keys binary, counts binary"
    found = rows.mapInArrow(count_words, sent).groupBy("shard").applyInArrow(merge_words, "shard long, n long, total long").collect()
    per_shard = {r.shard: r.n for r in found}                                  # one row per shard
    offsets = np.cumsum([0] + [per_shard.get(s, 0) for s in range(shards)]).tolist()
    if offsets[-1] >= 1 << 32:
        raise ValueError("more than 2^32 different words do not fit a 64-bit bigram key")
    model = Model(path, shards, offsets, sum(r.total for r in found), 0, [0.0] * 4, [0.0] * 4, 1.0)
    n_words = np.uint64(max(1, offsets[-1]))

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in _joined(batches):
            distinct, which = np.unique(flat, return_inverse=True)
            number = model.numbers(distinct).astype(np.uint64)[which]
            before = np.r_[number[-1:], number[:-1]]                            # every chunk ends with an end
            keys, counts = np.unique(before * n_words + number, return_counts=True)
            shard = _key_shard(keys, shards)
            order = np.argsort(shard, kind="stable")
            yield _sent(keys[order], counts[order], shard[order], shards)

    def merge_bigrams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Writes a shard; (shard of words, kind, numbers, values) rows carry its part of the words' statistics."""
        s = key[0].as_py()
        keys, counts = _merged(table, "keys", "counts")
        _save(f"{path}/bigrams-{s}.npy", keys)
        _save(f"{path}/bigram-counts-{s}.npy", counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
        out = [(-1, 0, pack(np.arange(4)), pack(np.cumsum([int((counts == k).sum()) for k in (1, 2, 3, 4)])))]
        context, word = keys // n_words, keys % n_words
        for kind, numbers in ((0, context[counts == 1]), (1, context[counts == 2]), (2, context[counts > 2]), (3, word)):
            distinct, n = np.unique(numbers, return_counts=True)
            cut = np.searchsorted(distinct, np.array(offsets, np.uint64))
            out += [(t, kind, pack(distinct[cut[t]:cut[t + 1]]), pack(np.cumsum(n[cut[t]:cut[t + 1]])))
                    for t in range(shards) if cut[t + 1] > cut[t]]
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int64()), "kind": pa.array([o[1] for o in out], pa.int32()),
                         "keys": pa.array([o[2] for o in out], pa.binary()), "counts": pa.array([o[3] for o in out], pa.binary())})

    def merge_stats(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        size = 4 if s < 0 else offsets[s + 1] - offsets[s]
        stats = np.zeros((size, 4), np.uint32 if s >= 0 else np.int64)
        for kind, k, c in zip(*(table.column(n).to_pylist() for n in ("kind", "keys", "counts"))):
            at = unpack(k).astype(np.int64) - (0 if s < 0 else offsets[s])
            stats[at, kind] += np.diff(unpack(c), prepend=np.uint64(0)).astype(stats.dtype)    # a row's keys are distinct
        if s >= 0:
            _save(f"{path}/stats-{s}.npy", stats)
            t = stats[:, 3].astype(np.int64)
            n = [int((t == k).sum()) for k in (1, 2, 3, 4)]
            return pa.table({"shard": [s], "n": [n], "more": [int((t > 2).sum())], "total": [int(t.sum())]})
        return pa.table({"shard": [s], "n": [stats[:, 0].tolist()], "more": [0], "total": [0]})

    parts = rows.mapInArrow(count_bigrams, sent).groupBy("shard").applyInArrow(merge_bigrams, "shard long, kind int, keys binary, counts binary")
    sums = parts.groupBy("shard").applyInArrow(merge_stats, "shard long, n array<long>, more long, total long").collect()   # one row per shard
    of = lambda rows: [sum(r.n[k] for r in rows) for k in range(4)]
    model.of_bigrams = discounts(of([r for r in sums if r.shard < 0]) or [0] * 4)
    of_words = [r for r in sums if r.shard >= 0]
    seen = of(of_words)
    model.of_words = discounts(seen)
    model.n_bigrams = sum(r.total for r in of_words)
    left = seen[0] * model.of_words[1] + seen[1] * model.of_words[2] + sum(r.more for r in of_words) * model.of_words[3]
    model.gamma = left / model.n_bigrams if model.n_bigrams else 1.0
    return model
