"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, filter_audit, jaccard, licenses, minhash, mixing, oracles, pii, prefix_trie, quality, secret_scan, token_counts, toxicity
from .shingles import SIZE

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The session's wattloom.pii.key; where there is none, a random one is drawn and kept for the session, so that nobody can guess it."""
    key = spark.conf.get("wattloom.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("wattloom.pii.key", key)
    return key


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_insult", "p_contempt", "p_toxic", "rejected")


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(_table(spark, sf_dir, "documents"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op6's other half: its signatures' bands joined, and what they bring together verified; the class of each document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, F.col("vec_id") % 20 == 0, k=20)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(_table(spark, sf_dir, "documents"))


def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality_co_training, op3_pii_surrogates, op4_license_scan, op5_toxicity_chain, op6_minhash_fingerprints, minhash_near_duplicates, op7_cross_polytope_neighbours, op8_bpe_round_trip, op9_ngram_jaccard_join, op10_pareto_mixing, op11_secret_scan, op12_filter_audit, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can tell whole at bearable cost; tests/llm holds the others against brute force."""
    return {
        "op4_license_scan": oracles.license_scan(),
        "op9_ngram_jaccard_join": oracles.ngram_jaccard_join(jaccard.PERCENT, SIZE),
        "op11_secret_scan": oracles.secret_scan(secret_scan.RULES, [r.kind for r in secret_scan.BASE]),
        "op12_filter_audit": oracles.filter_audit(),
        "op13_prefix_trie": oracles.prefix_trie(),
    }
