"""A corpus pipeline of five training-data operators. Every stage is written as Parquet and read again by the next.

Every stage takes any columns beside doc_id, text and source, whatever their names, an empty table, nulls in any column and
texts of any length. What becomes of such rows is said at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgate.llm import decontam, ngram_join, pieces, quality_rules, secret_scan
from memgate.llm._shared import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule, of hosts that are not rejected. Null and empty texts go; a null source is no host; rows that repeat are judged one by one."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id, nulls last, of each group that n-gram links connect; of rows that share that id the one with the
    smallest hash over all columns. Texts without words all stay."""
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, and n_chars counted anew. A null text stays null."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids in place of the text; a column token_ids that was there before is replaced. Null texts have null ids."""
    return pieces.encode(docs).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("SentencePiece encoding", tokens)]

#: SQL can express neither the template windows nor the Viterbi; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return docs
