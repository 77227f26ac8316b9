"""Task tables: reader, exports and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.text import iso_timestamp, tolerant_json

METRICS = "struct<total_urls:int,successful_urls:int,success_rate:double,execution_time:double>"


def read_tasks(spark: SparkSession, path: str, **jdbc) -> DataFrame:
    """Task rows from parquet, or from a database when connection options are given."""
    raw = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    return decode_tasks(raw)


def decode_tasks(tasks: DataFrame) -> DataFrame:
    """JSON metrics decoded; missing metrics give an empty struct."""
    return tasks.withColumn("metrics", F.from_json(F.coalesce("metrics", F.lit("{}")), METRICS))


def export_task(tasks: DataFrame, results: DataFrame, task_id: str) -> DataFrame:
    """One export document for a task: task info, its results in order, metrics, export metadata."""
    task = tasks.filter(F.col("task_id") == task_id)
    of_task = results.filter(F.col("task_id") == task_id)
    listed = of_task.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "url", "success", "extraction_count"))).alias("results")
    )
    info = F.struct("task_id", "status", iso_timestamp("created_at").alias("created_at"), iso_timestamp("completed_at").alias("completed_at"), "url")
    return task.join(listed, "task_id", "left").select(
        info.alias("task_info"), F.coalesce("results", F.array()).alias("results"), tolerant_json("metrics").alias("metrics"),
        F.struct(F.lit("json").alias("export_format"), F.lit("2.0").alias("exporter_version")).alias("export_metadata"),
    )


def backup_projection(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        F.col("row_id").alias("id"), "task_id", "progress_current", "progress_total", "status",
        iso_timestamp("created_at").alias("created_at"),
    )


def write_documents(records: DataFrame, path: str, by: str) -> None:
    """One JSON document per record, in a folder per key."""
    records.write.mode("errorifexists").partitionBy(by).json(path)
