"""Corpus preparation in five stages, each one operator of ``rosterline.llm`` over all documents.

Every stage works on what the one before it kept; its result is written as Parquet in the shared
folder and reread. All stages but the last return the columns of ``documents``. The working tables of a
stage are dropped when the next stage begins: by then its result has been written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rosterline.llm import curriculum, exact_dedup, near_copies, packing, quality
from rosterline.llm.common import drop_stored, recording, store
from rosterline.llm.queries import documents, vocabulary

#: Documents that score below this calibrated chance of good quality go.
MIN_QUALITY = 0.3

_working: list[str] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stored(spark, _working)
        with recording(_working):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of these tables."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, threshold=MIN_QUALITY)


@_stage
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the one with the largest id."""
    return exact_dedup.drop_copies(docs)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five words, similarity 0.8): the smallest id."""
    return near_copies.drop_near_copies(docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per pass, in training order."""
    return curriculum.training_order(docs, length_col="n_chars")


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary(spark, "byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    rows, written = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with recording(kept := []):
            rows = store(stage(spark, rows, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_stored(spark, written)  # the stage before has been read
        written = kept
    drop_stored(spark, _working)
    return rows
