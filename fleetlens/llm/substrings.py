"""Substring dedup (2): word windows repeated across documents, found by level-wise doubling.

A window repeated in two documents has repeated halves, so windows are looked for at a short length
first and only those repeated there are extended to (about) twice the length, up to the length
asked for.  At the first level a document sends only the minimisers of its windows (the smallest
hash among a window's short sub-windows): equal windows have equal minimisers, so nothing is lost,
and about a quarter of the positions are shuffled instead of all.

A level is one shuffle.  A map task first combines what its own documents share, so a passage found
in a third of all documents arrives once per task, not once per document; what the task already
knows to be repeated is salted and passes through.  The documents are shuffled once, by id; every
level joins its finds to that same shuffle.

Hashes that only choose candidates have 48 bits; the level that decides has 96 bits, of two
independent families.

Null ids take no part (their rows keep all words).  Rows with the same id count as one document:
neither removes words of the other.  Null texts are empty, with no words.  Texts shorter than the
window keep everything.  An empty table gives no rows.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed, lean, texts, words

#: Longest window of the first level.
SHORT = 8
#: Rows a map task holds before it combines and sends them.
CHUNK = 1 << 20
CANDIDATE_BITS = 48
SALTS = 4096
ROWS = "k1 long, k2 long, doc_id long, salt long"
NAMES = ["k1", "k2", "doc_id", "salt"]


def lengths(window: int) -> list[int]:
    """Window lengths of the levels, each at most twice the one before: 13 -> [7, 13]."""
    out = [window]
    while out[0] > SHORT:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _coefficients(family: int, length: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{family}/{j}".encode()) | 1 for j in range(length)], np.uint64)


def word_hashes(seq: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, seq), np.uint64, len(seq))


def window_hashes(h: np.ndarray, length: int, family: int, bits: int = 64) -> np.ndarray:
    """A hash of every window of ``length`` words (multilinear in the words' hashes; its upper ``bits``), by start."""
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_coefficients(family, length)):
        out += h[j:j + n] * c
    return (out >> np.uint64(64 - bits)).view(np.int64)


def _minimisers(short: np.ndarray, per_window: int) -> np.ndarray:
    """For each window, the start of the smallest of its ``per_window`` short windows (the first, if tied)."""
    if per_window == 1:
        return np.arange(len(short))
    view = np.lib.stride_tricks.sliding_window_view(short, per_window)
    return view.argmin(axis=1) + np.arange(len(view))


def _candidates(h: np.ndarray, found: np.ndarray, window: int, length: int, first: bool) -> np.ndarray:
    """Starts of the windows that may be repeated, given the repeated windows of one level."""
    if len(h) < window:
        return np.empty(0, np.int64)
    short = window_hashes(h, length, 0, CANDIDATE_BITS)
    hit = np.isin(short, found)
    if first:
        return np.flatnonzero(hit[_minimisers(short, window - length + 1)])
    n = len(h) - window + 1
    return np.flatnonzero(hit[:n] & hit[window - length:])


def _combined(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, final: bool) -> pa.RecordBatch:
    """One open row per key for the shuffle, and salted rows for what is known to be repeated already."""
    order = np.lexsort((doc, k2, k1))
    k1, k2, doc = k1[order], k2[order], doc[order]
    key = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])][:len(k1)]
    keep = key | np.r_[True, doc[1:] != doc[:-1]][:len(k1)]
    k1, k2, doc, key = k1[keep], k2[keep], doc[keep], key[keep]
    starts = np.flatnonzero(key)
    if final:
        known = np.flatnonzero(~key)
    else:
        size = np.diff(np.r_[starts, len(k1)])
        known = np.flatnonzero(np.repeat(size > 1, size))
    rows = np.r_[starts, known]
    salt, k2 = doc[rows] % SALTS + 1, k2[rows]
    salt[:len(starts)] = 0
    k2[len(starts):] = 0
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[rows], k2, doc[rows], salt)], NAMES)


def _sent(rows: DataFrame, keys, final: bool) -> DataFrame:
    """(k1, k2, doc_id, salt) of the windows that ``keys(text, found)`` gives for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = batch.column(2) if batch.num_columns > 2 else [None] * len(ids)
            for doc, text, hits in zip(ids, batch.column(1), found):
                if doc is None or (hits is not None and not hits.is_valid):
                    continue
                k1, k2 = keys(text.as_py(), None if hits is None else np.asarray(hits.values))
                if len(k1):
                    held.append((k1, k2, np.full(len(k1), doc, np.int64)))
                    size += len(k1)
                if size >= CHUNK:
                    yield _combined(*map(np.concatenate, zip(*held)), final)
                    held, size = [], 0
        if held:
            yield _combined(*map(np.concatenate, zip(*held)), final)

    return rows.mapInArrow(lean(run), ROWS)


def _repeated(sent: DataFrame, final: bool) -> DataFrame:
    """(doc_id, found): per document, the hashes of its windows that repeat.

    Before the last level: those in at least two documents.  At the last: those that a document
    with a smaller id has too.
    """
    same = Window.partitionBy("k1", "k2", "salt")
    rows = sent.withColumn("low", F.min("doc_id").over(same))
    if final:
        hit = F.col("doc_id") > F.col("low")
    else:
        rows = rows.withColumn("high", F.max("doc_id").over(same))
        hit = F.col("low") < F.col("high")
    return rows.where((F.col("salt") > 0) | hit).groupBy("doc_id").agg(F.collect_list("k1").alias("found"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))


def repeated_windows(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text",
                     later: bool = True) -> DataFrame:
    """(doc_id, found): hashes (family 0) of the windows that also start in a document with a smaller
    id (``later``), or in any other document."""
    rows, levels = _documents(docs, id_col, text_col), lengths(window)

    def first(text, _):
        h = word_hashes(words(text))
        if len(h) < window:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(levels) == 1:
            return window_hashes(h, window, 0), window_hashes(h, window, 1, 32)
        short = window_hashes(h, levels[0], 0, CANDIDATE_BITS)
        k = short[np.unique(_minimisers(short, window - levels[0] + 1))]
        return k, np.zeros(len(k), np.int64)

    found = _repeated(_sent(rows, first, later and len(levels) == 1), later and len(levels) == 1)
    for i, length in enumerate(levels[1:]):
        def longer(text, hits, i=i, length=length):
            h = word_hashes(words(text))
            at = _candidates(h, hits, window, levels[i], i == 0)
            if length == window:
                return window_hashes(h, window, 0)[at], window_hashes(h, window, 1, 32)[at]
            k = window_hashes(h, length, 0, CANDIDATE_BITS)[np.union1d(at, at + window - length)]
            return k, np.zeros(len(k), np.int64)

        final = later and length == window
        # an outer join, as in dedup: all levels then share one shuffle of the texts
        found = _repeated(_sent(rows.join(found, "doc_id", "left"), longer, final), final)
    return found


def _left(seq: list[bytes], found: np.ndarray, window: int) -> list[bytes]:
    """The words that no found window covers."""
    starts = np.isin(window_hashes(word_hashes(seq), window, 0), found)
    edge = np.zeros(len(seq) + 1, np.int64)
    edge[:len(starts)] += starts
    edge[window:window + len(starts)] -= starts
    return [seq[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without the words covered by a window of ``window``
    words that also starts in a document with a smaller id.  ``kept``: the words left, joined by one space.
    """
    found = repeated_windows(docs, window, id_col, text_col)
    rows = _documents(docs, id_col, text_col).join(found, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, hits in zip(batch.column(1), batch.column(2)):
                seq = words(text.as_py())
                left = _left(seq, np.asarray(hits.values), window) if hits.is_valid else seq
                n_words.append(len(seq))
                n_removed.append(len(seq) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                    length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with the words of repeated windows taken out of the text (see ``dedup``).

    A text that loses words has the others joined by one space, and its length in characters goes to
    ``length_col`` if there is such a column; other texts stay as they are.  A row that loses all its
    words goes.
    """
    found = repeated_windows(docs, window, id_col, text_col).withColumnRenamed("found", "__found")
    rows = docs.join(found.withColumnRenamed("doc_id", "__id"), F.col(f"`{id_col}`").cast("long") == F.col("__id"), "left").drop("__id")
    names = docs.columns
    at = names.index(text_col)
    at_length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, length, stays = batch.column(at).to_pylist(), [], []
            for i, hits in enumerate(batch.column(batch.num_columns - 1)):
                stays.append(True)
                if hits.is_valid:
                    seq = words(text[i].encode())
                    left = _left(seq, np.asarray(hits.values), window)
                    stays[i] = len(left) > 0
                    if len(left) < len(seq):
                        text[i] = b" ".join(left).decode()
            columns = batch.columns[:-1]
            if at_length is not None:
                old = columns[at_length].to_pylist()
                hit = batch.column(batch.num_columns - 1).is_valid()
                length = [len(t) if h else n for t, n, h in zip(text, old, hit.to_pylist())]
                columns[at_length] = pa.array(length, columns[at_length].type)
            columns[at] = pa.array(text, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    return rows.mapInArrow(lean(run), docs.schema)


def longest_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, longest): the longest of the lengths window, 2 window, 4 window, ... at which the document
    shares a window with another document.  Only documents alive at one length are tried at twice that
    length, until none survives."""
    rows = _documents(docs, id_col, text_col)
    alive, length, out = rows, window, None
    while True:
        here = checkpointed(repeated_windows(alive, length, "doc_id", "text", later=False).select("doc_id"))
        if here.isEmpty():
            break
        here = here.withColumn("longest", F.lit(length).cast("long"))
        out = here if out is None else out.union(here)
        alive = rows.join(here.select("doc_id"), "doc_id", "left_semi")
        length *= 2
    if out is None:
        return rows.sparkSession.createDataFrame([], "doc_id long, longest long")
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))
