"""A corpus pipeline: language, exact copies, near copies, benchmark leaks, packing.

Each stage takes the documents that the one before kept, as a table written and read
again, so none copies its input to number the rows.  Filtering stages return the columns of ``documents``; the last returns the
pieces of the packed sequences.  Null texts go in the first stage.  Of rows with equal
texts one stays, a null ``doc_id`` before none; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmeter.llm.common import drop_kept, drop_unused_shuffles, keep
from postmeter.llm.decontamination import drop_contaminated
from postmeter.llm.exact_dedup import drop_copies
from postmeter.llm.language_id import drop_unknown_language
from postmeter.llm.ngram_join import drop_near_copies
from postmeter.llm.packing import packing_report

# Near copies: five words and a similarity of 0.8 or more.
NEAR_WORDS = 5
NEAR_PERCENT = 80

# Text encoded at a time beside what the stages before have left in memory.
PACKING_STEP = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language that the labels teach; without labels, those without a letter."""
    return drop_unknown_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest ``doc_id``."""
    drop_unused_shuffles(spark)
    return drop_copies(docs, stored=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies keep the one with the smallest ``doc_id``."""
    drop_unused_shuffles(spark)
    return drop_near_copies(docs, NEAR_WORDS, NEAR_PERCENT, stored=True)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item."""
    drop_unused_shuffles(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), stored=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    drop_unused_shuffles(spark)
    return packing_report(docs, PACKING_STEP)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

# SQL cannot express the profiles, the similarity join or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written and read back.

    A result is deleted once the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            drop_kept(before)
    return STAGES[-1][1](spark, docs, sf_dir)
