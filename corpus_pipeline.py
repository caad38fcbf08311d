"""Cleans and packs ``documents`` in stages; each stage is written and read again by the next.

Null texts fail the quality rules, so later stages never see them. Rows with a null or repeated key pass like
others: near-duplicates are told apart by row, and null keys come last in their order. Empty tables pass through. Extra columns stay
until packing, whose result has columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from embedspark.llm import classifier, near_dedup, packing, quality_rules, suffix_dedup
from embedspark.llm.common import discard, recording, table
from embedspark.session import written

_left: list[str] = []


def _stage(function):
    """A stage's own tables last until the next stage begins: its result has been written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left)
        with recording(_left):
            return function(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = function.__name__, function.__doc__
    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@_stage
def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, scores as good."""
    return classifier.keep_positive(docs, table(spark, sf_dir, "labels"))


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_first(docs)


@_stage
def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long repeated strings; what a cut leaves of a character goes too."""
    return suffix_dedup.without_repeats(docs, sizes={"n_chars": F.length})


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces: doc_id, piece, start, length, ids, sequence_id, offset."""
    pieces = packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(pieces, capacity=4096)


STAGES = [
    ("quality rules", quality_stage),
    ("quality classifier", classifier_stage),
    ("near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("best-fit packing", packing_stage),
]
#: Trained scores and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
