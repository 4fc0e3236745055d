"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontaminate import without_leaks
from quarry.llm.jaccard import one_of_each
from quarry.llm.mixing import mixed
from quarry.llm.secrets import redact_secrets
from quarry.llm.toxicity import without_toxic
from quarry.plans.materialise import settled


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5, fold=0, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a Jaccard similarity of 0.8 or more; candidates come
    through the Gray-order index of SimHash fingerprints, and through shared shingles where fingerprints are further apart."""
    return one_of_each(docs, words=5, least=0.8, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=0.05)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay, and n_chars follows the text."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of sources."""
    return mixed(docs, slots=1000, power=0.5, block=8)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]

#: Several stages have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; each one's rows are written and read again before the next, and what it needed on
    the way is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
