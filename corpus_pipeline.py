"""Corpus pipeline: filter, deduplicate, decontaminate and mix ``documents``.

Every stage takes what its predecessor kept, written as Parquet and read
again, so a lost executor costs a stage's own tasks only.  All stages but the
last return the columns of ``documents``; the last repeats each document as
often as the mix takes it and adds ``copy``.

The classifiers learn from the labelled documents among their input, with the
fold rules of their own queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamstat.llm import quality, toxicity
from loamstat.llm.common import materialize, table
from loamstat.llm.decontamination import drop_contaminated
from loamstat.llm.jaccard_join import deduplicate
from loamstat.llm.mixing import repeat_mixed
from loamstat.llm.sampling import fold_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT)
    return toxicity.drop_toxic(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    theta = quality.train_quality(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", quality.FOLDS) != quality.HELD_OUT)
    return quality.drop_low_quality(docs, theta)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return deduplicate(docs, 5, 8, 10)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
]

#: SQL can't express the trained stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
