"""A corpus cleaning pipeline: each stage's result is written as Parquet and read again as the next one's docs.

toxicity: documents scored 0.5 or more go. near_dedup: one document of each group of near copies stays. substring_dedup: words
of repeated 20-word passages go, all but the first occurrence. pii: spans are replaced by their kind. packing: the
pieces of the remaining documents, placed in sequences of 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm import near_copies, packing, pii, substring_dedup, toxicity
from quadra.llm.queries import tokenizer_path

#: Jaccard similarity of five-word shingles from which the near-duplicate stage links documents. The three-word fingerprints
#: within two bits are the contract of the query op1 alone.
SIMILARITY = 0.8


def _resized(docs: DataFrame) -> DataFrame:
    """With n_chars as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = toxicity.learning(runtime.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.first_of_group(docs, similarity=SIMILARITY)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(substring_dedup.rewrite(docs, size=20))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), capacity=2048, end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
