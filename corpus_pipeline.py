"""A corpus pipeline of five stages: language, exact duplicates, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavane.llm import common, exact, jaccard, language, packing, queries, substrings


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a letter whose language is one of those learned from the rows at hand; `und` rows go. Without labelled
    rows, those with a letter stay."""
    profiles = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    return language.keep_identified(docs, profiles)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.drop_duplicates(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words of passages that a smaller doc_id has too; n_chars follows the text."""
    out = substrings.remove_repeats(docs, 50)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences of 1024 tokens."""
    return packing.pack(packing.token_pieces(docs, queries.RANKS, queries.VOCABULARY))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]
#: Language profiles and byte-pair ids can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
