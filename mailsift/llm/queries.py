"""Registered queries of this package and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import dialogue, fingerprints, language, lexical, mixing, neardup, neighbours, ngrams, packing, privacy, repeats, secrets, toxicity
from mailsift.llm.common import read_table

# The byte-level vocabulary of the packing query, in both of its forms.
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_files() -> tuple[str, str, str]:
    """Paths of the vocabulary and its ranks, and the pattern that splits texts."""
    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(read_table(spark, sf_dir, "documents")))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), *tokenizer_files())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.digest(secrets.scan(docs))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(privacy.scan(read_table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.train_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(read_table(spark, sf_dir, "conversations"))


def op12_toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_merkle_fingerprints": op4_merkle_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_source_mix": op6_source_mix,
    "op7_ngram_trie": op7_ngram_trie,
    "op8_personal_data": op8_personal_data,
    "op9_language_id": op9_language_id,
    "op10_projection_forest": op10_projection_forest,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxic_clauses": op12_toxic_clauses,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {"op13_ranked_search": lexical.SEARCH_SQL}
