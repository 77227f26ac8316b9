"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from statloom.session import fresh_dir

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, purpose: str, batch_rows: int | None = None) -> DataFrame:
    """The rows written below ``spark.checkpoint.dir`` and read back: cuts lineage, survives lost executors.
    The shuffle files of the finished stage are released. ``batch_rows`` bounds the rows that a Python worker of this
    stage holds at a time."""
    spark = df.sparkSession
    path = fresh_dir(spark, purpose)
    wanted = {_RELEASE: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
