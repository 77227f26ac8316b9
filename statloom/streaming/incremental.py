"""Incremental processing with Structured Streaming. The transformations are the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statloom.session import fresh_dir


def landed(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land in a folder (or match a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Append the results for everything that has landed so far, then stop. Restarting with the same
    checkpoint continues after the last committed batch."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def extract_incrementally(pages: DataFrame, extract, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Newly landed pages to observations with an append sink; returns what has been written."""
    spark = pages.sparkSession
    out, checkpoint = out or fresh_dir(spark, "observations"), checkpoint or fresh_dir(spark, "checkpoint")
    stream = extract(pages)
    run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def distinct_pages(pages: DataFrame, key: str = "url", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Each key passes once; the seen keys live in the checkpointed state."""
    spark = pages.sparkSession
    out, checkpoint = out or fresh_dir(spark, "distinct"), checkpoint or fresh_dir(spark, "checkpoint")
    once = pages.dropDuplicates([key])
    run_available(once, out, checkpoint)
    return spark.read.schema(once.schema).parquet(out)


def maintain_progress(results: DataFrame, key: str, ok, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Task progress kept up to date as results arrive.

    A batch merges the changed tasks into the newest snapshot and writes the next one; a retried batch replaces its own
    snapshot, so a restart never counts twice. Only the last two snapshots stay, whatever the number of batches."""
    spark = results.sparkSession
    out, checkpoint = out or fresh_dir(spark, "progress"), checkpoint or fresh_dir(spark, "checkpoint")
    counted = results.groupBy(key).agg(
        F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.max("ts").alias("updated_at")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        older = [n for n in snapshots(session, out) if n < batch_id]
        rows = batch
        if older:
            known = session.read.schema(batch.schema).parquet(f"{out}/snapshot={older[-1]}")
            changed = batch.select(F.col(key).alias("_changed"))
            rows = known.join(changed, F.col(key).eqNullSafe(F.col("_changed")), "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{out}/snapshot={batch_id}")
        for n in older[:-1]:
            _files(session, out).delete(_path(session, f"{out}/snapshot={n}"), True)

    query = (
        counted.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    newest = snapshots(spark, out)
    if not newest:
        return spark.createDataFrame([], counted.schema)
    return spark.read.schema(counted.schema).parquet(f"{out}/snapshot={newest[-1]}")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def snapshots(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the finished snapshots of a folder, oldest first."""
    files = _files(spark, out)
    if not files.exists(_path(spark, out)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(_path(spark, out))]
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith("snapshot=")]
    return sorted(n for n in numbers if files.exists(_path(spark, f"{out}/snapshot={n}/_SUCCESS")))
