"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  Every stage works on all that its predecessor kept.

1. language ID: documents without a letter, or of which no language has half of the words, go.
   The model is learnt from the documents themselves, by their ``lang``.
2. SimHash near-dedup: of each group linked by fingerprints of 3-word shingles at 3 or fewer
   differing bits, the document with the smallest id stays.
3. substring dedup: words covered by a 13-word window that starts in an earlier document too are
   removed; ``n_chars`` follows the text.  A document that loses all its words goes.
4. benchmark decontamination: documents that contain at least 0.8 of the five-word shingles of an
   item of ``benchmark`` go.
5. byte-level BPE: (doc_id, lang, source, ids, n_tokens), whole texts encoded and checked by decoding.

Rows are told apart by id and text, so a repeated or null id costs no other row its text.  Rows alike in
id and text are one document, of which stage 2 keeps the least row.  Null ids come last: such a row goes
where any document with an id is like it, and loses the words that any of them has.  Of several texts
under one id the one with the smallest hash has the id's place in stage 3, the others come after all ids.
Null and empty texts go in stage 1.  Empty tables pass through as empty tables.  The written tables of
stages are removed once the next one has read them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import config
from fleetlens.llm import bpe, contamination, language, simhash, substrings
from fleetlens.llm.common import checkpointed, prepare, row_key, table, with_own_ids
from fleetlens.sinks.files import Folders

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = language.learn(docs)
    return language.keep_labelled(docs, model, least=0.5).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=3, radius=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = with_own_ids(docs.select(*COLUMNS), "own_id")
    return substrings.without_repeats(rows, window=13, id_col="own_id").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(row_key().alias("key"), "text")
    found = contamination.contained_items(rows, table(spark, sf_dir, "benchmark"), doc_id="key")
    gone = checkpointed(found.select(F.col("doc_id").alias("key")).distinct())
    return docs.select(*COLUMNS).join(gone, row_key() == F.col("key"), "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    tokens = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "text"))
    tokens = bpe.decode(tokens, VOCABULARY)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    checked = F.when(same, F.size("ids").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("tokens of a document decode to another text: "), F.col("doc_id").cast("string"))))
    return tokens.select("doc_id", "lang", "source", "ids", checked.alias("n_tokens"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: Viterbi, SimHash and BPE are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; intermediate tables go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{config.checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            Folders(spark, base).delete(f"{base}/{number - 1}")
    return docs
