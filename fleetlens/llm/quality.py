"""Quality classifier (10): positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1; the web text is unlabelled: all rows of the documents,
whatever their label.  A linear model on features of the text is fitted by minimising

    pi R_p(+) + max(0, R_u(-) - pi R_p(-))

with the logistic loss, pi the class prior; where the second term would go below zero the step goes
the other way (as the method prescribes).  The score is the logistic function of the model's output,
so it estimates the probability of label 1.

The prior is estimated from positives and unlabelled rows alone: a first model tells the two apart on
one half of the texts (by their checksum); on the other half, of all score thresholds, the one with the
least upper bound on (share of unlabelled above) / (share of positives above) gives the ratio.  Labels 0
have no use.

Features come from whole texts, long ones in pieces: hashed frequencies of character-class trigrams
(letters by case, digits, white space, single ASCII punctuation marks, other symbols), and a few
measures of the words: their length, the shares of short words, of capitals, digits and marks, and
how much of the text repeats.  They are made once by Spark tasks over all documents and kept in the
shared checkpoint folder until the fit ends.  Mean, scale, thresholds and, at every step, the
unlabelled risk and its gradient are Spark sums over all rows: a few hundred numbers a step reach the
driver.  Of the labelled rows at most ``max_positives`` positives are used, those with the smallest
hashes of their ids; of a chosen id on several rows, the row with the least features.

Null and empty texts have the features of no text and are scored like others.  Very long texts are
read a piece at a time; their words are held once.  Labels other than 1, null ids and labels without
a document teach nothing; of several labels of a document the smallest counts.  With no positives all
scores are 0.5.  Repeated rows are scored alike, and each counts as unlabelled text.  An empty table
gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.llm.common import checkpointed, texts
from fleetlens.sinks.files import Folders

BUCKETS = 256
MEASURES = 10
WIDTH = BUCKETS + MEASURES
ROWS = 1000               # of a block of features
STEPS = 80
RATE = 0.05
PRIOR_STEPS = 40
RIDGE = 1e-3
#: Edges of the score thresholds that the prior is looked for at.
EDGES = np.linspace(-10, 10, 201)
PIECE = 1 << 20

#: Byte -> character class: 1 white space, 2 line end, 3 a-z and bytes of other letters, 4 A-Z, 5 digits, 8.. marks.
CLASS = np.full(256, 3, np.int64)
CLASS[:33] = 1
CLASS[10] = CLASS[13] = 2
CLASS[65:91] = 4
CLASS[48:58] = 5
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    CLASS[_c] = 8 + _i


def features(text: bytes | None) -> np.ndarray:
    """float32 [BUCKETS + MEASURES] of one text."""
    text = text or b""
    grams = np.zeros(BUCKETS)
    kinds = np.zeros(64)
    for lo in range(0, len(text), PIECE):
        c = CLASS[np.frombuffer(text[max(0, lo - 2):lo + PIECE], np.uint8)]
        kinds += np.bincount(c[min(lo, 2):], minlength=64)
        key = c[:-2] * 4096 + c[1:-1] * 64 + c[2:]
        grams += np.bincount((key * 2654435761 >> 12) % BUCKETS, minlength=BUCKETS)
    words = text.split()
    lines = text.split(b"\n")
    n, size = max(1, len(words)), max(1, len(text))
    length = np.fromiter(map(len, words), np.int64, len(words))
    measures = [np.log1p(len(text)), np.log1p(len(words)), length.sum() / n, (length <= 3).sum() / n, (length >= 12).sum() / n,
                kinds[4] / size, kinds[5] / size, kinds[8:].sum() / size,
                len(set(words)) / n, len(set(lines)) / len(lines)]
    return np.concatenate([np.sqrt(grams / size), measures]).astype(np.float32)


def _featured(rows: DataFrame) -> DataFrame:
    """(the columns of ``rows`` but text, x array<float>); text is its last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = np.stack([features(t.as_py()) for t in part.columns[-1]])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], flat], [*part.schema.names[:-1], "x"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, x array<float>")


def _blocks(rows: DataFrame) -> DataFrame:
    """(half, body): the features of at most ROWS texts of one half as the bytes of a float32 matrix, of rows (half, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = np.stack([features(t.as_py()) for t in part.column(1)])
                half = part.column(0).to_numpy()
                some = np.unique(half)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([x[half == h].tobytes() for h in some], pa.binary())], ["half", "body"])

    return rows.mapInArrow(run, "half int, body binary")


def _sum(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of(x)``, ``size`` numbers, over the matrices x of all blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for body in batch.column(0):
                total += of(np.frombuffer(body.as_buffer(), np.float32).reshape(-1, WIDTH))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

    sums = blocks.select("body").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    out = np.zeros(size)
    for row in sums.groupBy("i").agg(F.sum("s").alias("s")).collect():     # ``size`` rows
        out[row.i] = row.s
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("x").combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), WIDTH)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _one(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x), x.dtype)]


def negative_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over the rows of x (bias column last): the logistic loss as negatives, and its gradient."""
    z = x @ w.astype(x.dtype)
    return np.r_[np.logaddexp(0, z).sum(dtype=np.float64), x.T @ sigmoid(z).astype(x.dtype)].astype(np.float64)


def step_gradient(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk without its ridge; ``unlabelled``: means of ``negative_sums``."""
    mine = negative_sums(positive, w) / len(positive)
    negative_risk = unlabelled[0] - prior * mine[0]
    of_negative = unlabelled[1:] - prior * mine[1:]
    of_positive = prior * (mine[1:] - positive.mean(axis=0))
    return of_positive + of_negative if negative_risk >= 0 else -of_negative


def _descend(size: int, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """``steps`` of Adam from zero, with the ridge on all but the bias."""
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = gradient(w) + RIDGE * np.r_[w[:-1], 0]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w


def minimise(positive: np.ndarray, unlabelled: np.ndarray | Callable[[np.ndarray], np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk over all rows.  ``unlabelled``: the rows, or the means of
    ``negative_sums`` over them as a function of the weights."""
    xp = _one(positive)
    if isinstance(unlabelled, np.ndarray):
        xu = _one(unlabelled)
        means = lambda w: negative_sums(xu, w) / len(xu)
    else:
        means = unlabelled
    w = _descend(xp.shape[1], lambda w: step_gradient(w, xp, means(w), prior), STEPS, RATE)
    return w[:-1], float(w[-1])


def best_ratio(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The class prior from counts of scores per bin: of all thresholds, the ratio of the shares above where its upper bound is least."""
    nu, np_ = max(1, unlabelled.sum()), max(1, positive.sum())
    above_u, above_p = unlabelled[::-1].cumsum() / nu, positive[::-1].cumsum() / np_
    seen = above_p > 0
    if not seen.any():
        return 0.5
    slack = np.sqrt(np.log(40) / (2 * nu)) + np.sqrt(np.log(40) / (2 * np_))
    at = ((above_u[seen] + slack) / above_p[seen]).argmin()
    return float(np.clip(above_u[seen][at] / above_p[seen][at], 0.01, 0.99))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score)."""
        rows = texts(docs, id_col, text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = [float(sigmoid(self.scaled(features(t.as_py())) @ self.weights + self.bias)) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

        return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def _prior(blocks: DataFrame, positive: np.ndarray, half: np.ndarray, scaled: Callable[[np.ndarray], np.ndarray]) -> float:
    """The share of positives in the unlabelled text, from a model of positive against unlabelled (see the module)."""
    here, there = (half == 0, half == 1) if 0 < half.sum() < len(half) else (half >= 0, half >= 0)
    fit, held = blocks.where("half = 0"), blocks.where("half = 1")
    n_fit, n_held = (int(_sum(b, lambda x: np.array([len(x)]), 1)[0]) for b in (fit, held))
    if n_fit == 0 or n_held == 0:
        fit, held, n_fit = blocks, blocks, n_fit + n_held
    xp = _one(positive[here])

    def gradient(w: np.ndarray) -> np.ndarray:
        mine = negative_sums(xp, w)[1:] / len(xp) - xp.mean(axis=0)
        return (mine + _sum(fit, lambda x: negative_sums(_one(scaled(x)), w)[1:], WIDTH + 1) / n_fit) / 2

    w = _descend(WIDTH + 1, gradient, PRIOR_STEPS, 2 * RATE)
    count = lambda x: np.histogram(np.clip(_one(x) @ w, EDGES[0], EDGES[-1]), EDGES)[0]
    return best_ratio(_sum(held, lambda x: count(scaled(x)), len(EDGES) - 1), count(positive[there]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_positives: int = 10_000) -> Model:
    """A model from the texts of ``docs`` and the labels of ``labels`` (only rows that may be learnt from)."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1")
    half = (F.crc32(F.coalesce("text", F.lit(b""))) % 2).cast("int").alias("half")
    rows = texts(docs, id_col, text_col)
    chosen = marked.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives)
    chosen = checkpointed(chosen.select("doc_id"))                                                # bounded
    sample = _featured(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", half, "text"))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("x", "half")).alias("s")).select("s.*").toArrow()   # bounded rows
    none = np.zeros(WIDTH, np.float32)
    if not sample.num_rows:
        return Model(none, none + 1, none, 0.0, 0.5)
    folder = f"{config.checkpoint_dir(spark)}/quality-{uuid.uuid4().hex}"
    _blocks(rows.select(half, "text")).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    x = _matrix(sample)
    n = _sum(blocks, lambda x: np.array([len(x)]), 1)[0]
    mean = _sum(blocks, lambda x: x.sum(axis=0, dtype=np.float64), WIDTH) / n
    scale = np.sqrt(_sum(blocks, lambda x: ((x - mean) ** 2).sum(axis=0), WIDTH) / n)
    model = Model(mean.astype(np.float32), np.where(scale > 1e-6, scale, 1.0).astype(np.float32), none, 0.0, 0.5)
    z = model.scaled(x)
    model.prior = _prior(blocks, z, sample.column("half").to_numpy(), model.scaled)
    scaled = model.scaled
    model.weights, model.bias = minimise(z, lambda w: _sum(blocks, lambda x: negative_sums(_one(scaled(x)), w), WIDTH + 2) / n, model.prior)
    Folders(spark, folder).delete(folder)
    return model
