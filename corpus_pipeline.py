"""From raw documents to tokens: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  The first drops toxic documents, the second keeps one document of
each group of near duplicates, the third cuts strings of 50 bytes that an earlier document
has, the fourth drops documents that hold benchmark text, the last encodes and decodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from mnemospark.llm._exchange import written
from mnemospark.llm.queries import ranks, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores under 0.7; rows with null ids, null or empty texts and repeats are scored like any other."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows with its smallest id; rows with null ids stay, null and empty texts are one group."""
    return simhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without the strings of 50 bytes that a smaller id has; null texts become empty, null ids come last and do not cut each other."""
    kept = suffix_dedup.deduplicate(docs, clean=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words fewer than one in twenty, or none, are benchmark text; empty texts stay, equal rows share one fate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; null and empty texts have no tokens."""
    return bpe.encode_decode(docs, ranks(), digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]
#: A learnt classifier, fingerprints and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
