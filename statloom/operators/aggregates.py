"""Aggregations. Every one is a hash aggregate with map-side combination: no group is ever collected
into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import labels
from statloom.functions import rules as R
from statloom.functions.advice import ALL_TOPIC_ADVICE
from statloom.functions.common import col, join_null_safe


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """Ratio that is zero for an empty whole."""
    return F.when(whole > 0, part / whole * scale).otherwise(0.0)


def count_where(cond) -> Column:
    return F.count_if(col(cond))


def mean_where(value, cond) -> Column:
    """Mean over the rows that qualify, zero when none does."""
    return F.coalesce(F.avg(F.when(col(cond), col(value))), F.lit(0.0))


def content_classification(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Richness by value count and relevance by target flags, per group."""
    text = F.lower(F.concat("indicator_name", "value_text", "unit"))
    relevant = F.max(labels.is_target("indicator_name"))
    national = F.max(F.contains(text, F.lit("tunisi")))
    return obs.groupBy(*keys).agg(
        labels.richness_by_count(F.count("*")).alias("data_richness"),
        F.when(relevant, "high").when(national, "medium").otherwise("unknown").alias("economic_relevance"),
    )


def page_summary(obs: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Counts, distinct categories, targets, high-quality values and mean confidence."""
    return obs.groupBy(*keys).agg(
        F.count("*").alias("total_values"),
        F.count_distinct("category").alias("categories_found"),
        F.count_if("is_target_indicator").alias("target_indicators"),
        F.count_if(F.col("confidence_score") > 0.8).alias("high_quality"),
        F.avg("confidence_score").alias("average_confidence"),
    )


def reject_summary(checked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Reject counts, success rate and a flag above 80 percent rejected."""

    def rejected(reason: str) -> Column:
        return F.count_if(F.col("reject_reason") == reason)

    counted = checked.groupBy(*keys).agg(
        F.count("*").alias("total_input"),
        F.count_if(F.col("reject_reason").isNull()).alias("valid_output"),
        rejected("rejected_outside_period").alias("outside_period"),
        rejected("rejected_no_year").alias("no_year"),
        rejected("rejected_patterns").alias("patterns"),
        rejected("rejected_validation_error").alias("validation_errors"),
    )
    rate = share(F.col("valid_output"), F.col("total_input"), 100.0)
    return counted.withColumns({"success_rate": rate, "high_rejection": 100 - rate > 80})


def confidence_histogram(obs: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    level = labels.confidence_class("confidence_score")
    return obs.groupBy(*keys).agg(
        *[F.count_if(level == name).alias(name) for name in ("high", "medium", "low")],
        F.array_sort(F.collect_set("category")).alias("categories_found"),
    )


def distribution(rows: DataFrame, keys: Sequence[str], item: str, name: str) -> DataFrame:
    """Map from item to row count per key. Items are counted first, so the collected part is as
    small as the set of different items."""
    counts = rows.groupBy(*keys, item).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(item).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def task_metrics(results: DataFrame) -> DataFrame:
    """Per task: totals, success rate, time, mean quality of successes, route counts. Rows without a task are a task
    of their own; rows without a route are not in the route counts."""
    ok = F.col("success")
    base = results.groupBy("task_id").agg(
        F.count("*").alias("processed_urls"),
        F.count_if(ok).alias("successful_urls"),
        F.count_if(~ok).alias("failed_urls"),
        F.round(mean_where("confidence_score", ok), 3).alias("average_quality_score"),
        F.round(F.sum("processing_time"), 2).alias("execution_time"),
    )
    rated = base.withColumn("success_rate", F.round(share(F.col("successful_urls"), F.col("processed_urls"), 100.0), 2))
    routes = distribution(results.filter("strategy_used IS NOT NULL"), ["task_id"], "strategy_used", "strategy_distribution")
    return join_null_safe(rated, routes, ["task_id"], "left")


def top_items(rows: DataFrame, keys: Sequence[str], item: str, k: int = 3) -> DataFrame:
    """Most frequent items per key, alphabetical on ties, with their rank."""
    from statloom.operators.windows import first_k

    counts = rows.groupBy(*keys, item).agg(F.count("*").alias("n"))
    return first_k(counts, keys, [F.col("n").desc(), F.col(item)], k)


def combine_analyses(analysed: DataFrame, keys: Sequence[str], threshold: float = 0.3, topics=None, messages=None) -> DataFrame:
    """Dominant topic, means, topic counts and most frequent advice of the analyses above the
    threshold. Topics and messages are rule lists, so all counts are conditional sums of one
    aggregation and the texts are read once. Ties go alphabetically."""
    topics = topics or [*R.TOPICS, "general", "empty_content"]
    messages = messages or ALL_TOPIC_ADVICE
    kept = F.col("confidence") > threshold
    counts = analysed.groupBy(*keys).agg(
        F.count_if(kept).alias("sources_analyzed"),
        F.avg(F.when(kept, F.col("confidence"))).alias("average_confidence"),
        F.avg(F.when(kept, F.col("quality"))).alias("average_quality"),
        _tally(topics, lambda x: kept & (F.col("topic") == x)).alias("topic_counts"),
        _tally(messages, lambda x: kept & F.array_contains("advice", x)).alias("advice_counts"),
    )
    items = {c: F.transform(F.slice(c, 1, 3), lambda x: x["item"]) for c in ("topic_counts", "advice_counts")}
    by_name = F.array_sort(F.transform("topic_counts", lambda x: F.struct(x["item"].alias("key"), (-x["order"]).alias("value"))))
    return counts.filter("sources_analyzed > 0").withColumns(
        {
            "dominant_topic": F.get(items["topic_counts"], F.lit(0)),
            "top_advice": items["advice_counts"],
            "distribution": F.map_from_entries(by_name),
        }
    )


def _tally(items: Sequence[str], test) -> Column:
    """Array of (order, item) for the items that occur, most frequent first; order is minus the
    count."""
    counted = F.array(*[F.struct((-F.count_if(test(i))).alias("order"), F.lit(i).alias("item")) for i in items])
    return F.array_sort(F.filter(counted, lambda x: x["order"] < 0))


def synthesis(results: DataFrame, analysed: DataFrame) -> DataFrame:
    """One row: success rate, mean quality, their mean and its level. The two one-row aggregates are
    put on top of each other and folded, which needs no join."""
    runs = results.agg(F.count("*").alias("n_results"), F.count_if("success").alias("n_ok"))
    texts = analysed.agg(F.count("*").alias("n_analyses"), F.avg("quality").alias("analysis_quality"))
    both = runs.unionByName(texts, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    rate = share(F.col("n_ok"), F.col("n_results"))
    quality = F.coalesce("analysis_quality", F.lit(0.0))
    return one.select(
        "n_results", "n_ok", "n_analyses", rate.alias("success_rate"), quality.alias("analysis_quality"),
        ((rate + quality) / 2).alias("overall_score"),
    ).withColumn("quality_level", labels.quality_level("overall_score"))


def run_quality(results: DataFrame) -> DataFrame:
    """Score out of ten per task over its two routes: success, values (15 give full marks), speed."""
    per_route = results.groupBy("task_id", "strategy_used").agg(
        F.max("success").alias("completed"), F.sum("extraction_count").alias("n_values"), F.sum("processing_time").alias("seconds")
    )
    score = (
        F.when(F.col("completed"), 1.0).otherwise(0.0)
        + F.least(F.col("n_values") / 15, F.lit(1.0)) * 1.5
        + F.when(F.col("seconds") < 10, 0.5).otherwise(0.0)
    )
    return per_route.groupBy("task_id").agg(F.round(F.sum(score), 1).alias("quality_score"))


def task_counts(tasks: DataFrame, today) -> DataFrame:
    """Total, active, created today and per status, as one row."""
    statuses = ("pending", "running", "completed", "failed", "cancelled")
    return tasks.agg(
        F.count("*").alias("total_tasks"),
        F.count_if(F.col("status").isin("pending", "running")).alias("active_tasks"),
        F.count_if(F.col("created_at") >= F.lit(today).cast("timestamp_ntz")).alias("recent_tasks"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
    )


def store_statistics(spark, folder: str, pattern: str, tasks: DataFrame) -> DataFrame:
    """Files and bytes of a folder next to the task counts, one row. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("length")
    disk = files.agg(F.count("*").alias("files_count"), F.sum("length").alias("total_size"))
    rows = tasks.agg(F.count("*").alias("total_tasks"), F.count_if(F.col("status") == "completed").alias("completed_tasks"))
    both = disk.unionByName(rows, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def endpoint_statistics(results: DataFrame, keys: Sequence[str], time_limit: float) -> DataFrame:
    """Success, timeout and fallback rates with usage per endpoint."""
    ok, slow = F.col("success"), F.col("processing_time") > time_limit
    n = F.count("*")
    return results.groupBy(*keys).agg(
        n.alias("total_requests"),
        (F.count_if(ok) / n).alias("success_rate"),
        (F.count_if(slow & ~ok) / n).alias("timeout_failure_rate"),
        (F.count_if(ok & (F.col("strategy_used") == "intelligent")) / n).alias("fallback_success_rate"),
    )


def performance_report(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rate, mean time, mean quality and level per key."""
    ok = F.col("success")
    base = results.groupBy(*keys).agg(
        F.count("*").alias("total_runs"),
        F.avg(ok.cast("int")).alias("success_rate"),
        F.avg("processing_time").alias("average_time"),
        mean_where("confidence_score", ok).alias("average_quality"),
    )
    return base.withColumn("performance_level", labels.two_factor_level("success_rate", "average_quality"))


def outcome_summary(rows: DataFrame, ok: Column, duration) -> DataFrame:
    """Passed, failed, rate in percent and total duration, one row."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        (F.count_if(ok) / F.count("*") * 100).alias("success_rate"),
        F.sum(duration).alias("total_duration"),
    )


def progress_audit(detected: DataFrame) -> DataFrame:
    return detected.agg(F.count("*").alias("total_tasks"), F.count_if("is_problematic").alias("problematic_tasks"))


def page_reports(pages: DataFrame, obs: DataFrame) -> DataFrame:
    """Per page: route, time limit, success, content flags and value count. Observations are counted
    before the join."""
    from statloom.functions import text, urls

    counts = obs.groupBy("page_id").agg(F.count("*").alias("extraction_count"))
    host = F.lower(urls.authority("url"))
    facts = pages.select(
        "page_id", host.alias("domain"), urls.route_by_domain("url").alias("selected_route"),
        urls.domain_policy(host).alias("time_limit"), F.length("html").alias("content_length"),
        (F.length(text.strip("html")) > 50).alias("long_enough"),
    )
    joined = facts.join(counts, "page_id", "left").withColumn("extraction_count", F.coalesce("extraction_count", F.lit(0)))
    return joined.withColumn("has_valid_content", F.col("long_enough") | (F.col("extraction_count") > 0))
