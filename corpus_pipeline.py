"""From raw documents to packed training sequences, in stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mcid.llm import jaccard, packing, quality, substrings
from mcid.llm.common import release, table
from mcid.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or the strict rules of their host, go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    SimHash and bands of min-hashes propose; 0.8 of their five-word shingles makes two texts near copies.
    """
    return jaccard.keep_first(docs, least=(4, 5), n=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has go; a document with no other words goes, too."""
    return substrings.remove_repeats(docs, window=13)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, stands in the training sequences."""
    return packing.pack(docs, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and packing have no SQL form; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = docs
        docs = cut_lineage(stage(spark, docs, sf_dir))
        release(spark, done, shuffles=True)
    return STAGES[-1][1](spark, docs, sf_dir)
