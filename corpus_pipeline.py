"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing to target weights, token files.

Each stage works on all rows that the stage before it kept; all but the last return the columns of documents, whatever their names. An empty
table gives an empty table at every stage, and texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, language, mixing, sketch, tokens
from lattica.llm.common import written
from lattica.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no determined language go: null and empty ones, those without a letter, and those of which no language has a probability of 0.4."""
    return language.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays: of fingerprints 3 or fewer bits apart, as the operator's own
    query links them, and of similarity 0.8 or more between sets of five words. Texts without words are one class of fingerprints; rows without
    an id stay, those of the same id stay or go together."""
    return sketch.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more from the benchmark go. Texts without words stay; an empty benchmark takes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights: a document is there once, twice or not at all. A null source is one; repeated rows share copies."""
    return mixing.mix(docs, shards=64)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as Simple-8b shards, and what they hold for each document. A null text is its end id alone."""
    return tokens.token_table(spark, docs, tokenizer_path())


STAGES = [("language id", language_id), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token files", token_files)]

#: A trained network, classes of fingerprints, hypergeometric draws and a tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's table is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
