"""The corpus pipeline: classify, join near duplicates, decontaminate, mix, write token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, mixing, quality, token_output
from millrace.llm.common import materialize, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as poor or toxic, go; of rows that repeat an id each by its own text."""
    return quality.classify(docs, read(spark, sf_dir, "labels"), carry=True).where("_kept").drop("_quality", "_toxic", "_kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that similarity links connect one stays, of those with the least id; those without shingles all stay."""
    return jaccard_join.jaccard_join(docs, carry=True).where("_first").drop("_first")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=True).where("not _contaminated").drop("_contaminated")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, at most three times; rows that repeat an id count apart.

    The key of rows is written with them: it is no function of the row and must not change between two readings.
    """
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    taken = materialize(mixing.mix(keyed, row_col="__row").where("copies > 0").select("__row", F.col("copies").cast("int").alias("__n")), "pipeline-copies")
    placed = keyed.join(taken.hint("merge"), "__row")
    return placed.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in directly addressable files; a row per document written, repeats too."""
    return token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_ids),
]

#: A fitted classifier and a tokenizer aren't SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
