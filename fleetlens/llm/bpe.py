"""Byte-level BPE encoding and decoding (7), merges driven by a segment tree.

A text is split by the tokenizer's pattern; each piece is encoded on its own.  A piece that is a
token is that token.  Otherwise every byte starts as a symbol, a segment tree over the byte
positions holds the rank of the pair that starts at each live symbol, and its root names the
leftmost pair of least rank.  A merge updates only the pair at that position and the pair of its
left neighbour: two logarithmic point updates, so a piece of n bytes costs n log n, also where one
piece is a whole long text.

Pieces repeat, so a worker keeps the ids of the pieces it has met, up to a bounded number of pieces
of bounded length, then starts anew.  The new pieces of some texts are merged together: their trees
are the columns of one array, and each step does the next merge of every piece at once.  Longer
pieces are merged one by one.
Rank files are read once per worker from a path that every worker can read (a parameter).

Null and empty texts have no tokens and decode to empty.  Repeated rows are encoded alike.  Rows
keep their other columns; the added ones replace columns of the same name.  An empty table gives
no rows.  A byte that the vocabulary lacks is an error, as is an unknown id in decoding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import lean

#: Larger than every rank: no pair here.
NONE = 1 << 30
KEPT_PIECES = 1 << 17
KEPT_LENGTH = 64
CHARS_AT_ONCE = 1 << 20


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece that is not itself a token."""
    n = len(piece)
    size = 1 << max(0, (n - 2)).bit_length()       # leaves: pairs start at 0 .. n - 2
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i:i + 2], NONE)
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    after = list(range(1, n + 1))                 # start of the next live symbol
    before = list(range(-1, n - 1))
    while (low := tree[1]) < NONE:
        node = 1
        while node < size:                        # leftmost leaf of that rank
            node *= 2
            if tree[node] != low:
                node += 1
        at = node - size
        gone = after[at]
        end = after[at] = after[gone]
        if end < n:
            before[end] = at
        changed = [(gone, NONE), (at, get(piece[at:after[end]], NONE) if end < n else NONE)]
        prev = before[at]
        if prev >= 0:
            changed.append((prev, get(piece[prev:end], NONE)))
        for leaf, rank in changed:
            node = size + leaf
            if node >= 2 * size or tree[node] == rank:
                continue
            tree[node] = rank
            while node > 1:
                node //= 2
                left, right = tree[2 * node], tree[2 * node + 1]
                best = left if left <= right else right
                if tree[node] == best:
                    break
                tree[node] = best
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:after[at]]])
        at = after[at]
    return out


class PairRanks:
    """The rank of the token that two tokens make together, for arrays of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys[left << 32 | right] = rank
        self.keys = np.array(sorted(keys), np.int64)
        self.ranks = np.array([keys[k] for k in self.keys.tolist()], np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_many(pieces: list[bytes], size: int, byte_ids: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, number of ids of each), for pieces of 2 to ``size`` bytes.

    As ``merge``, a column per piece; ``size`` is a power of two.
    """
    count = len(pieces)
    n = np.fromiter(map(len, pieces), np.int64, count)
    data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size).T
    symbol = byte_ids[data]                                            # [position, piece]
    place = np.arange(size)[:, None]
    tree = np.full((2 * size, count), NONE, np.int32)
    tree[size:2 * size - 1] = np.where(place[:-1] < n - 1, pairs(symbol[:-1], symbol[1:]), NONE)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    after = np.repeat(np.arange(1, size + 2), count).reshape(size + 1, count)
    before = after - 2
    live = place < n
    levels = size.bit_length() - 1
    piece = np.flatnonzero(tree[1] < NONE)
    while len(piece):
        low = tree[1, piece]
        node = np.ones(len(piece), np.int64)
        for _ in range(levels):                                        # leftmost leaf of that rank
            node *= 2
            node += tree[node, piece] != low
        at = node - size
        gone = after[at, piece]
        end = after[gone, piece]
        symbol[at, piece] = low
        live[gone, piece] = False
        after[at, piece] = end
        before[end, piece] = at
        prev = before[at, piece]
        more = end < n[piece]
        right = np.where(more, pairs(low, symbol[np.minimum(end, size - 1), piece]), NONE)
        left = np.where(prev >= 0, pairs(symbol[prev, piece], low), tree[size, piece])
        tree[size + gone, piece] = NONE
        tree[size + at, piece] = right
        first = prev < 0
        left[first] = tree[size, piece[first]]                         # no left neighbour: leaf 0 stays
        tree[size + np.maximum(prev, 0), piece] = left
        for leaf in (gone, at, np.maximum(prev, 0)):
            node = (size + leaf) >> 1
            for _ in range(levels):
                tree[node, piece] = np.minimum(tree[2 * node, piece], tree[2 * node + 1, piece])
                node >>= 1
        piece = piece[tree[1, piece] < NONE]
    return symbol.T[live.T], live.sum(axis=0)


@lru_cache(maxsize=4)
def _pairs(path: str) -> tuple[PairRanks, np.ndarray]:
    ranks = load_ranks(path)
    return PairRanks(ranks), np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)


class Encoder:
    """Encodes texts with one vocabulary and pattern; keeps the ids of pieces it has met."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pairs, self.byte_ids = _pairs(path)
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path} lacks a single byte")
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}                  # piece -> its place in the arrays below
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.tokens = np.empty(0, np.int32)

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        counts = np.ones(len(new), np.int64)
        parts: list = [None] * len(new)
        groups: dict[int, list[int]] = {}
        data = [p.encode() for p in new]
        for i, d in enumerate(data):
            token = self.ranks.get(d)
            if token is not None:
                parts[i] = (token,)
            elif len(d) > KEPT_LENGTH:
                parts[i] = merge(d, self.ranks)
                counts[i] = len(parts[i])
            else:
                groups.setdefault(1 << (len(d) - 1).bit_length(), []).append(i)
        for size, members in groups.items():
            ids, n = merge_many([data[i] for i in members], size, self.byte_ids, self.pairs)
            counts[members] = n
            for i, end, k in zip(members, np.cumsum(n).tolist(), n.tolist()):
                parts[i] = ids[end - k:end]
        return np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else self.tokens[:0], counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text."""
        if len(self.start) > KEPT_PIECES or len(self.tokens) > 8 * KEPT_PIECES:
            self.forget()
        pieces = [self.split(t) if t else [] for t in texts]
        every = list(chain.from_iterable(pieces))
        which = np.fromiter(map(self.number.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(which < 0)
        new = list(dict.fromkeys(every[i] for i in missing.tolist()))
        if new:
            ids, counts = self.learn(new)
            self.number.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.concatenate([self.start, len(self.tokens) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.tokens = np.concatenate([self.tokens, ids])
            which[missing] = [self.number[every[i]] for i in missing.tolist()]
        n = self.count[which]
        stop = np.cumsum(n)
        flat = self.tokens[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.start[which] - (stop - n), n)]
        for p in new:
            if len(p) > KEPT_LENGTH:
                del self.number[p]
        cut = np.r_[0, stop][np.cumsum([len(p) for p in pieces])] if pieces else []
        return np.split(flat, cut[:-1]) if len(cut) else []

    def __call__(self, text: str | None) -> list[int]:
        return self.encode([text])[0].tolist()


class TokenBytes:
    """The bytes of every token, one after another in one array."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.length = np.full(max(ranks.values()) + 2, -1, np.int64)          # the last stands for any other id
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.start = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        self.data = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.length[np.clip(ids, -1, len(self.length) - 1)]
        if (n < 0).any():
            raise ValueError(f"unknown token id {ids[n < 0][0]}")
        stop = np.cumsum(n)
        at = np.repeat(self.start[ids] - (stop - n), n)
        at += np.arange(len(at))
        return self.data[at].tobytes()


def _groups(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``most`` in size, a longer row by itself."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes) or not sizes:
        yield batch.slice(start)


def _added(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    """``batch`` with its last column replaced."""
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], name])


def _schema(rows: DataFrame, added: str) -> str:
    """The columns of ``rows`` but the last, and those added."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [added])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``ids array<int>``, the tokens of the whole text."""
    names = [c for c in docs.columns if c != "ids"] if keep is None else list(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.columns[-1]), 0).to_pylist()
            for part in _groups(batch, sizes, CHARS_AT_ONCE):
                ids = encoder.encode(part.columns[-1].to_pylist())
                offsets = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([np.empty(0, np.int32), *ids])
                yield _added(part, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), "ids")

    return rows.mapInArrow(lean(run), _schema(rows, "ids array<int>"))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``tokens`` and ``decoded binary``, the bytes that the ids stand for."""
    names = [c for c in tokens.columns if c != "decoded"]
    rows = tokens.select(*[F.col(f"`{c}`") for c in names], F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.columns[-1]), 0).to_pylist()
            for part in _groups(batch, sizes, CHARS_AT_ONCE):
                data = [table.joined(np.asarray(i.values)) if i.is_valid else b"" for i in part.columns[-1]]
                yield _added(part, pa.array(data, pa.binary()), "decoded")

    return rows.mapInArrow(lean(run), _schema(rows, "decoded binary"))
