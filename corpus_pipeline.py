"""The corpus pipeline: documents are filtered, deduplicated, mixed and packed, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorfisc.llm import language, mixing, packing, simhash, toxicity
from motorfisc.llm.common import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; the model is fitted on the stage's own input."""
    return language.keep_identified(docs, language.train(language.training_rows(docs)))


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the labels are those of the table ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, toxicity.training_rows(labels)))


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, as documents: one row for each pass over a document."""
    return mixing.mixed_documents(docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which training sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", _identified), ("toxicity", _clean), ("near_dedup", _distinct), ("mixing", _mixed), ("packing", _packed)]

#: Language, toxicity and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage returns is settled before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else settle(docs), sf_dir)
    return docs
