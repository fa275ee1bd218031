"""Language ID (8): script ranges, per-word scores, and Viterbi with a switching penalty.

Learning counts hashed character trigrams inside words, and letters by script, for each language
over all the rows given (Spark sums the counts; the model has a fixed size per language).  A word's
score for a language is the log probability of its trigrams.  Its script narrows the candidates:
languages that hardly use the script are out, unless no language uses it.  Viterbi over the words,
where changing the language costs ``switch``, labels spans; the document's language is the one with
the most words (ties: the smaller name), its score the share of words so labelled.

A text that is null, empty or without a letter gets ``und`` and score 0, as does every text if no
language was learnt.  Texts are read whole: long ones in pieces cut between words.  Repeated rows
are labelled alike.  Rows without text or language teach nothing.  An empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import lean

#: First and last code point of the blocks of a script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS) + 1
UNKNOWN = "und"
FEATURES = 1 << 15
PIECE_CHARS = 1 << 19
GROUP_CHARS = 1 << 22
OUT_OF_SCRIPT = 100.0


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Code point -> 0 (no letter), the number of its script, or OTHER."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    out = np.where(letters, OTHER, 0).astype(np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            out[first:last + 1][letters[first:last + 1]] = number
    return out


def word_pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(trigram feature of every letter, start of every word among the letters, script of every word),
    for pieces of the lower-cased text cut between words."""
    text, at, table = text.lower(), 0, script_table()
    while at < len(text):
        end = min(len(text), at + PIECE_CHARS)
        while end < len(text) and text[end - 1].isalpha():   # a word stays whole
            end += 1
        code = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        at = end
        script = table[code]
        letter = script > 0
        c = np.zeros(len(code) + 2, np.uint64)
        c[1:-1][letter] = code[letter]
        where = np.flatnonzero(letter)
        key = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9))[where]
        feature = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % FEATURES
        start = np.flatnonzero(np.diff(where, prepend=-2) > 1)
        if len(start):
            yield feature, start, script[where[start]]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray      # float32 [FEATURES, languages]: log probabilities
    candidates: np.ndarray   # bool [scripts + 2, languages]
    switch: float

    def word_scores(self, text: str) -> np.ndarray:
        """float32 [words, languages]."""
        out = []
        for feature, start, script in word_pieces(text):
            score = np.add.reduceat(self.weights[feature], start, axis=0)
            out.append(score - np.where(self.candidates[script], 0, OUT_OF_SCRIPT).astype(np.float32))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)), np.float32)

    def labels(self, texts: pa.Array) -> tuple[list[str], list[float], list[list[dict]]]:
        """Language, score and spans of every text; some megabytes of text at a time."""
        lang, score, spans, group, size = [], [], [], [], 0
        limit = GROUP_CHARS * 8 // max(8, len(self.languages))   # a word has a score per language
        for i, text in enumerate(texts):
            text = text.as_py()
            group.append(self.word_scores(text) if text and self.languages else np.empty((0, max(1, len(self.languages))), np.float32))
            size += len(text or "")
            if size < limit and i + 1 < len(texts):
                continue
            lengths = np.array([len(g) for g in group], np.int64)
            label, at = viterbi(np.concatenate(group), lengths, self.switch), 0
            group, size = [], 0
            for n in lengths.tolist():
                mine, at = label[at:at + n], at + n
                if n == 0:
                    lang.append(UNKNOWN), score.append(0.0), spans.append([])
                    continue
                share = np.bincount(mine, minlength=len(self.languages))
                best = int(share.argmax())
                run = np.flatnonzero(np.diff(mine.astype(np.int64), prepend=-1))
                lang.append(self.languages[best])
                score.append(share[best] / n)
                spans.append([{"start": int(s), "words": int(w), "lang": self.languages[mine[s]]}
                              for s, w in zip(run, np.diff(run, append=n))])
        return lang, score, spans


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", switch: float = 12.0,
          script_share: float = 0.01) -> Model:
    """A model of the languages named in ``lang_col``.  The driver gets FEATURES counts per language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = counts.setdefault(lang, np.zeros(FEATURES + OTHER + 1, np.int64))
                for feature, start, script in word_pieces(text.as_py()):
                    mine[:FEATURES] += np.bincount(feature, minlength=FEATURES)
                    mine[FEATURES:] += np.bincount(script, np.diff(start, append=len(feature)), OTHER + 1).astype(np.int64)
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], ["lang", "at", "n"])

    sums = rows.mapInArrow(lean(count), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums.column("lang").to_pylist()))
    n = np.zeros((FEATURES + OTHER + 1, len(languages)))
    which = np.array([languages.index(x) for x in sums.column("lang").to_pylist()], np.int64)
    n[sums.column("at").to_numpy(), which] = sums.column("n").to_numpy()
    grams, letters = n[:FEATURES], n[FEATURES:]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * FEATURES)).astype(np.float32)
    candidates = letters >= script_share * np.maximum(letters.sum(axis=0), 1)
    candidates[~candidates.any(axis=1)] = True
    return Model(languages, weights, candidates, switch)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word of several texts at once.

    ``scores`` holds the words of the texts one after another, ``lengths`` their numbers of words.
    All texts advance a word at a time, the longer ones first, so a step is a few array operations.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    length = lengths[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")   # texts longer than t words
    kind = np.min_scalar_type(max(0, scores.shape[1] - 1))   # holds every label
    kinds = np.arange(scores.shape[1], dtype=kind)
    back = np.empty(scores.shape, kind)
    label = np.empty(len(scores), kind)
    value = scores[begin[:active[0]]].astype(np.float32) if steps else None
    for t in range(1, steps):
        k = active[t]
        if k < len(value):
            label[begin[k:len(value)] + t - 1] = value[k:].argmax(axis=1)
            value = value[:k]
        at = begin[:k] + t
        arg = value.argmax(axis=1)
        value = value - value.max(axis=1, keepdims=True)
        stay = value >= -switch
        back[at] = np.where(stay, kinds, arg[:, None])
        value = np.where(stay, value, -switch) + scores[at]
    if steps:
        label[begin[:len(value)] + steps - 1] = value.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        at = begin[:active[t]] + t
        label[at - 1] = back[at, label[at]]
    return label


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are runs of words with one language, first word from 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, spans = model.labels(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, SPANS)],
                ["doc_id", "lang_pred", "score", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def keep_labelled(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and one language on at least the share ``least`` of its words."""
    number = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, _ = model.labels(batch.column(number))
            kept = [x != UNKNOWN and s >= least for x, s in zip(lang, score)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
