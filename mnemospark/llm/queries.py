"""Queries over the operators of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, fixity, hpy, prefix_hash, ranking, simhash, suffix_dedup, toxicity, url_filter, vector_codes, whitening

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> dict[bytes, int]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(RANKS))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks(), digest=True)


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = divergence.judge(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op2_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.score(table(spark, sf_dir, "documents"))


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), digest=True)


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.replicas(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edited(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {"op1_divergence": op1_divergence, "op2_hierarchical_pitman_yor": op2_hierarchical_pitman_yor, "op3_byte_bpe": op3_byte_bpe, "op4_bradley_terry": op4_bradley_terry, "op5_weak_supervision": op5_weak_supervision, "op6_simhash": op6_simhash, "op7_merkle_fixity": op7_merkle_fixity, "op8_url_filter": op8_url_filter, "op9_suffix_dedup": op9_suffix_dedup, "op10_decontaminate": op10_decontaminate, "op11_prefix_hash": op11_prefix_hash, "op12_whitening": op12_whitening, "op13_partial_distance": op13_partial_distance}


def oracle_sql() -> dict[str, str]:
    return {"op1_divergence": divergence.SQL, "op7_merkle_fixity": fixity.SQL, "op8_url_filter": url_filter.SQL, "op9_suffix_dedup": suffix_dedup.SQL, "op10_decontaminate": decontaminate.SQL, "op13_partial_distance": vector_codes.SQL}
