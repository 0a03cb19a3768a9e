"""A corpus pipeline of five stages. Each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, mixing, simhash, substring_dedup, toxicity
from corpusmill.llm.queries import fold
from corpusmill.llm.shared import shared_dir

#: Toxicity from which a document goes, words of a passage that may not repeat, and similarity from which documents are copies.
TOXIC, PASSAGE, SIMILAR = 0.3, 13, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows outside the held-out fold, does not find toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(4) != 2)
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of documents alike in 0.8 or more of their five-word shingles."""
    return simhash.one_of_each(docs, 5, SIMILAR).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id has too; those of which no word is left go.

    A document with nothing to remove keeps its text as it is.
    """
    cut = substring_dedup.remove_repeats(docs.withColumn("_text", F.col("text")), PASSAGE)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_text"))
    kept = cut.filter((F.col("n_removed") == 0) | (F.col("kept_text") != "")).withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, whole or alike by 0.8 or more."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), SIMILAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document: doc_id, size, source, source_size, target, taken."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix),
]

#: No SQL: the first stage is a trained model. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
