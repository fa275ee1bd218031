"""One registered query per operator, and the DuckDB statement where SQL can express it.

Each query applies its operator to the whole table with production parameters and returns the
columns of its contract; the operators' own outputs are wider.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, contamination, conversation_sql, jaccard, kneser_ney, language, licences, neighbours, quality, sharding, simhash, structure, substrings, trie
from fleetlens.llm.common import checkpointed, prepare, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles of every document, linked at 3 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that start in an earlier document too."""
    found = substrings.dedup(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
firsts AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (g) WHERE doc_id > first_id),
kept AS (
  SELECT doc_id, list(x ORDER BY p) AS k FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(len(k), 0) AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the 50k byte-level vocabulary, and decoded again."""
    tokens = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, keep=("doc_id",))
    return bpe.decode(tokens, VOCABULARY).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those with crc32(doc_id) mod 5 other than 0."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(language.fold("doc_id", 5) != 0))
    return language.predict(docs, model).select(
        "doc_id", F.coalesce(language.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in each document: units (lines, paragraphs, text) and windows outside them that match, and the best Dice."""
    found = licences.notices(table(spark, sf_dir, "documents"), threshold=0.8)
    return found.groupBy("doc_id", "licence").agg(F.count("*").alias("n_units"), F.max("dice").alias("best_dice"))


ORACLES["op3_licence_scan"] = licences.oracle()


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item of which a document has at least 0.8 of the five-word shingles."""
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_decontaminate"] = contamination.ORACLE


@query
def op5_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near-equal bytes, equal texts together."""
    found = sharding.assign(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every embedding whose vec_id is divisible by 50, among all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document, learnt from those with crc32(doc_id) mod 10 other than 0."""
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(language.fold("doc_id", 10) != 0))
    scores = checkpointed(model.score(docs))
    model.delete()
    return scores.select("doc_id", F.coalesce(language.fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from labels of rows with crc32(doc_id) mod 4 other than 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(language.fold("doc_id", 4) != 2))
    return model.score(docs).select("doc_id", F.coalesce(language.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                                    F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each rebuilt with the first crc32(conv_id) mod 4 turns of its block of 20."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), lambda c: c - c % 20, lambda c: trie.crc32_text(c) % 4)


ORACLES["op11_conversation_trie"] = conversation_sql.TRIE


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set of 4-word shingles, linked at a Jaccard similarity of 0.85 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


ORACLES["op12_jaccard_join"] = jaccard.ORACLE


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = structure.damaged(convs)
    ids = convs.select("conv_id").distinct()
    found = structure.repaired(rows).withColumnRenamed("conv_id", "id")
    missing = structure.gaps(rows).withColumnRenamed("conv_id", "of")
    found = ids.join(found, ids.conv_id.eqNullSafe(F.col("id")), "left").join(missing, ids.conv_id.eqNullSafe(F.col("of")), "left")
    none = F.lit(0).cast("long")
    return found.select("conv_id", *(F.coalesce(c, none).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLES["op13_structure_repair"] = conversation_sql.REPAIR
