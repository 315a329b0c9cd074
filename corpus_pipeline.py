"""From raw documents to a training mix: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girderframe.llm import decontamination, mixing, ngram_join, pii, toxicity
from girderframe.llm.common import table
from girderframe.session import run_tables

#: No SQL: the first stage trains a model.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score calls toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-grams with a Jaccard similarity of 0.8 or more, the smallest id stays."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates; ``n_chars`` follows the new text."""
    changed = pii.replace_entities(docs, count=None)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often it takes them."""
    return mixing.with_repeats(docs).filter("repeats > 0")


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("benchmark_decontamination", remove_leaks),
    ("pii_surrogates", replace_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other; what a stage stores for itself goes when it ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with run_tables(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return docs
