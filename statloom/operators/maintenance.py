"""Maintenance of task records: defaults, repairs, cancellation, retention, rule overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.common import messages
from statloom.functions.text import progress_pair, progress_struct

# Fixed value: progress of a task that has none.
DEFAULT_PROGRESS = '{"current": 0, "total": 1, "percentage": 0.0, "display": "0/1"}'
# Columns a task table must have, with type and default.
REQUIRED_COLUMNS = (
    ("analysis_type", "string", "standard"),
    ("status", "string", "pending"),
    ("priority", "int", 0),
    ("results", "string", "[]"),
    ("progress", "string", DEFAULT_PROGRESS),
    ("metrics", "string", None),
    ("parameters", "string", None),
    ("callback_url", "string", None),
    ("max_retries", "int", 3),
    ("current_retries", "int", 0),
)
CANCEL_MESSAGE = "Tâche annulée par l'utilisateur"


def default_progress(tasks: DataFrame, column: str = "progress") -> DataFrame:
    c = F.col(column)
    return tasks.withColumn(column, F.when(c.isNull() | c.isin("null", "{}"), DEFAULT_PROGRESS).otherwise(c))


def backfill_urls(tasks: DataFrame) -> DataFrame:
    """The URL list, else the single URL, else an empty list."""
    single = F.when(F.col("url").isNotNull(), F.array("url")).otherwise(F.array().cast("array<string>"))
    return tasks.withColumn("urls", F.coalesce("urls", single))


def default_metrics(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("metrics", F.coalesce("metrics", F.lit("{}")))


def to_progress_struct(tasks: DataFrame, clamp: bool = True) -> DataFrame:
    """Replaces the two progress columns by one struct. Without clamps the numbers are taken as they
    are and rows without either stay null."""
    if clamp:
        merged = progress_struct(*progress_pair("progress_current", "progress_total"), 2)
    else:
        raw = [F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)) for c in ("progress_current", "progress_total")]
        merged = F.struct(raw[0].alias("current"), raw[1].alias("total"))
    some = F.col("progress_current").isNotNull() | F.col("progress_total").isNotNull()
    return tasks.withColumn("progress", F.when(some, merged)).drop("progress_current", "progress_total")


def detect_progress_issues(tasks: DataFrame) -> DataFrame:
    """Issue texts and the suggested pair for rows whose progress is not a plain integer."""

    def of(name: str):
        c = F.col(name)
        shown = F.coalesce(c, F.lit("None"))
        whole = F.coalesce(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))
        slash = F.when(F.contains(c, F.lit("/")), F.concat(F.lit(f"{name} contient '/' : '"), shown, F.lit("'")))
        number = F.when(~whole, F.concat(F.lit(f"{name} non convertible en int : '"), shown, F.lit("'")))
        return slash, number

    (slash_c, number_c), (slash_t, number_t) = of("progress_current"), of("progress_total")
    checked = tasks.withColumn("issues", messages(slash_c, slash_t, number_c, number_t))
    current, total = progress_pair("progress_current", "progress_total")
    bad = F.size("issues") > 0
    return checked.withColumns(
        {
            "is_problematic": bad,
            "fix_current": F.when(bad, current.cast("string")),
            "fix_total": F.when(bad, total.cast("string")),
        }
    )


def apply_fixes(tasks: DataFrame, fixes: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Repaired tasks and the log of old and new values. ``fixes`` has row_id, fix_current and
    fix_total. A dry run returns the tasks unchanged with the same log."""
    joined = tasks.join(fixes.select("row_id", "fix_current", "fix_total"), "row_id", "left")
    log = joined.filter("fix_current IS NOT NULL").select(
        "row_id", "task_id", F.col("progress_current").alias("old_current"), F.col("progress_total").alias("old_total"),
        F.col("fix_current").alias("new_current"), F.col("fix_total").alias("new_total"),
    )
    if dry_run:
        return tasks, log
    repaired = joined.withColumns(
        {
            "progress_current": F.coalesce("fix_current", "progress_current"),
            "progress_total": F.when(F.col("fix_current").isNotNull(), F.col("fix_total")).otherwise(F.col("progress_total")),
        }
    )
    return repaired.select(*tasks.columns), log


def add_missing_columns(tasks: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Target columns that are absent, with their default."""
    absent = {name: F.lit(default).cast(kind) for name, kind, default in required if name not in tasks.columns}
    return tasks.withColumns(absent) if absent else tasks


def fill_task_ids(tasks: DataFrame, deterministic: bool = True) -> DataFrame:
    """Ids for rows without one. The deterministic form derives them from the row id, so a retried
    task gives the same id."""
    fresh = F.sha2(F.col("row_id").cast("string"), 256) if deterministic else F.uuid()
    given = F.nullif(F.trim("task_id"), F.lit(""))
    return tasks.withColumn("task_id", F.coalesce(given, fresh))


def cancel_task(tasks: DataFrame, task_id: str, at) -> DataFrame:
    hit = F.col("task_id") == task_id
    return tasks.withColumns(
        {
            "status": F.when(hit, "cancelled").otherwise(F.col("status")),
            "error": F.when(hit, CANCEL_MESSAGE),
            "completed_at": F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("completed_at")),
        }
    )


def expired(rows: DataFrame, ts: str, now, days: int) -> DataFrame:
    """Rows older than the retention."""
    return rows.filter(F.col(ts) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY"))


def expired_files(spark, folder: str, pattern: str, now, days: int) -> DataFrame:
    """Count and bytes of files older than the retention; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("length", "modificationTime")
    old = files.filter(F.col("modificationTime") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{int(days)}' DAY"))
    return old.agg(F.count("*").alias("files_removed"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_freed"))


def override_rules(rules: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces the lists of known rule keys (rule_key, ordinal, item); unknown keys are ignored.
    Returns the new rules and the changed keys with their list length."""
    known = updates.join(rules.select("rule_key").distinct(), "rule_key", "left_semi")
    kept = rules.join(known.select("rule_key").distinct(), "rule_key", "left_anti")
    changed = known.groupBy("rule_key").agg(F.count("*").alias("n_items"))
    return kept.unionByName(known), changed
