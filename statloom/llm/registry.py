"""Queries of the training-text operators: name, builder ``(spark, folder) -> DataFrame`` and checking SQL."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_ROOT = str(Path(__file__).resolve().parents[2])
#: Python workers serve one task after another. Without these, memory of freed arrays and batches stays with the worker: the
#: threshold from which arrays are mapped grows with the largest one freed, and Arrow's own pool keeps what it has.
_ALLOCATION = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def reach_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, and give freed memory back. A cluster gets the package with
    ``--py-files`` or installed."""
    environment = spark.sparkContext.environment
    for name, value in _ALLOCATION.items():
        environment.setdefault(name, value)
    known = environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, known]))


def query(name: str, sql: str | None = None):
    def register(build):
        @functools.wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            reach_workers(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as make it differ from every column of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
