"""The corpus pipeline: quality classifier, quality rules, n-gram Jaccard join, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import boosted_trees, jaccard_join, packing, quality_rules
from marketlens.llm.common import discard, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, predicts to be good. Null and empty
    texts are scored like others; rows without an id are judged, though no label can name them."""
    forest = boosted_trees.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return boosted_trees.classify(docs, forest).where("predicted = 1").select(*docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and short texts go."""
    return quality_rules.measure(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest id's. Rows are told apart by id and text, so an id that
    repeats over different texts stands for each of them; rows without words link with nothing and stay."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's pieces with their places in sequences of at most 4096 ids; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality-classifier", classify),
    ("quality-rules", apply_rules),
    ("jaccard-join", drop_near_copies),
    ("best-fit-packing", pack),
]
#: SQL cannot state the classifier, the join or the packing; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
