"""A document pipeline of corpus operators: toxicity, near-duplicates, benchmark passages, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import decontam, jaccard, piece, toxicity
from voxelframe.llm.common import stored, table
from voxelframe.llm.queries import tokenizer_bytes

#: Near-duplicates share this much of their shingles of so many words.
SHINGLE_WORDS = 5
SHARED_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from their labels, doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of smallest doc_id, a null one coming last.

    Rows are told apart by a number of their own, so one of repeated rows stays, rows with a null
    doc_id are members of their groups, and a row isn't dropped for another with its doc_id. Of
    rows with one doc_id that of the least hash of its text stays. Rows without a set all stay.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    # Written once, so that the numbers stand.
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard.near_groups(docs.select(F.col(row).alias("doc_id"), "text"), n=SHINGLE_WORDS, percent=SHARED_PERCENT)
    ranks = docs.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), F.col(row).alias("row")).alias("rank"))
    least = groups.select(F.col("doc_id").alias("row"), "component_id").join(ranks.hint("shuffle_hash"), "row").groupBy("component_id").agg(F.min("rank").alias("rank"))
    # What stays grows with the corpus, so it is never broadcast.
    kept = least.select(F.col("rank.row").alias(row))
    return docs.join(kept.hint("shuffle_hash"), row, "left_semi").drop(row)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text decoded from them."""
    return piece.encode(docs, tokenizer_bytes(), keep=("doc_id", "lang", "source")).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]
#: Stages 1, 3 and 4 can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
