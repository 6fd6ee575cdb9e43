"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (decontaminate, language, lm, oracle, periodic, quality, rules, secrets, sentencepiece, shards, simhash, suffix,
                        toxicity, trie)
from quarry.llm.base import documents, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, posterior and verdict of every document."""
    return language.identify(language.from_documents(documents(spark, sf_dir)), key="doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    groups = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, likelihood ratio and verdict of every document."""
    return rules.judge(documents(spark, sf_dir), rules.trusted_ids(table(spark, sf_dir, "labels")))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact add-one score and the filter model's log10 probability of every document."""
    return lm.score_documents(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked (document, benchmark item) pairs with their tiles' coverage."""
    return decontaminate.contaminated_pairs(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document after removal of all strings of 200 bytes that start twice."""
    return suffix.remove_repeats(documents(spark, sf_dir), length=200)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-weighted line marginals of every document."""
    return quality.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive-unlabelled toxicity score of every document."""
    return toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, then all spans, of every document."""
    return secrets.find_secrets(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether they spell it again."""
    return sentencepiece.encode(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, strongest run and digests of every document."""
    return periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(documents(spark, sf_dir))))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by bytes."""
    return shards.assign(documents(spark, sf_dir), shards=8)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), shared_starts=True)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_score": op8_lm_score,
    "op9_decontamination": op9_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sharding": op12_sharding,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op11_periodic_runs": oracle.PERIODIC_RUNS,
    "op12_sharding": oracle.SHARDING,
    "op13_prefix_trie": oracle.PREFIX_TRIE,
}
