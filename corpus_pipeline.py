"""The corpus pipeline: toxicity, near duplicates, repeated substrings, secrets, packing.

Each stage takes all that the one before kept. All but the last return the columns of documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statloom.llm import jaccard, packing, secrets, substrings, toxicity
from statloom.llm.registry import reach_workers, table
from statloom.llm.storage import stored
from statloom.session import fresh_dir


def stage(build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage prepares the Python workers itself, as it can be called alone."""

    @functools.wraps(build)
    def prepared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return build(spark, docs, sf_dir)

    return prepared


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, four fifths in common."""
    return jaccard.one_of_each(docs, words=5, percent=80)


@stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document has go from the texts."""
    return substrings.deduplicate(docs)


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secrets.redact(docs, fresh_dir(spark, "ledger"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("repeated substrings", drop_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Classifier, suffix arrays and tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, build in STAGES[:-1]:
        docs = stored(build(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
