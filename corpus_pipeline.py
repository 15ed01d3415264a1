"""The training-data pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of `documents`. No SQL expresses a stage, so each is tested against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import cut, table
from quantpanel.llm.decontaminate import drop_contaminated
from quantpanel.llm.exact_dedup import keep_first_copies
from quantpanel.llm.sentencepiece import decode, encode, load
from quantpanel.llm.simhash import keep_one_of_each
from quantpanel.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return keep_first_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids of every document and the text that they decode to."""
    pieces = load()
    # Executors hold what the stages before them left, so blocks are half as large as usual.
    tokens = encode(docs, pieces, block_bytes=5_000_000).select("doc_id", "ids", F.col("ids").alias("kept_ids"))
    return decode(tokens, pieces).select("doc_id", "n_tokens", F.col("kept_ids").alias("ids"), "text")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The stages learn models, probe fingerprints and fold tokens; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
