"""Corpus pipeline: toxicity, exact copies, near copies, benchmark passages, mixture.

All stages but the last return the columns of their input. Null text counts as empty text, which only the exact stage
drops (all but one of it). The three middle stages decide for each (id, text): rows that share an id with a dropped text
stay, repeated rows stay or go together. Null ids lose against ids. Empty tables give no rows. Columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slipway.llm import decontaminate, exact, jaccard, mixing, toxicity
from slipway.llm.common import Scratch
from slipway.llm.queries import MIXTURE, domain, load
from slipway.session import prepare


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more."""
    return jaccard.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens left, drawn to the mixture's weights: one row per chosen document and its epochs."""
    return mixing.mix(docs, domain(), MIXTURE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mixture", mixture_stage),
]

#: A trained model decides the first stage, which SQL cannot express; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    spark = prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
