"""Joins and merges of observations, results and task records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import labels, text, units, urls
from statloom.functions import rules as R
from statloom.functions.common import any_word, col, each
from statloom.session import small_table


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of all extraction methods; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_methods(base: DataFrame, extra: DataFrame, prefix: str = "clean_", keys: Sequence[str] = ("page_id", "obs_key")) -> DataFrame:
    """Adds the rows of another method under prefixed keys; existing keys win."""
    renamed = extra.withColumn(keys[-1], F.concat(F.lit(prefix), keys[-1]))
    missing = renamed.join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(missing, allowMissingColumns=True)


def overwrite(writers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keyed overwrite: of several writers the last one wins. A combining aggregate keeps one row per
    key and task before the shuffle."""
    tagged = [df.withColumn("writer", F.lit(i)) for i, df in enumerate(writers)]
    rows = union_all(tagged)
    rest = [c for c in rows.columns if c not in (*keys, "writer")]
    last = F.max_by(F.struct(*rest), "writer").alias("row")
    return rows.groupBy(*keys).agg(last).select(*keys, "row.*")


def upsert_tasks(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Record upsert by task id: given fields replace, metadata maps are merged with the new value
    winning, unknown ids create records."""
    t, c = tasks.alias("t"), changes.alias("c")
    joined = t.join(c, F.col("t.task_id") == F.col("c.task_id"), "full_outer")
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(
        F.coalesce("t.metadata", empty), F.coalesce("c.metadata", empty), lambda k, old, new: F.coalesce(new, old)
    )
    return joined.select(
        F.coalesce("t.task_id", "c.task_id").alias("task_id"),
        F.coalesce("c.status", "t.status", F.lit("completed")).alias("status"),
        merged.alias("metadata"),
        F.when(F.col("t.task_id").isNull(), "create").when(F.col("c.task_id").isNull(), "keep").otherwise("update").alias("operation"),
    )


def targets_table(spark, targets=R.TARGETS) -> DataFrame:
    """Target catalogue as rows: category, target_name, ordinal. Its size is that of the rule list."""
    rows = [(c, n, i) for c, names in targets.items() for i, n in enumerate(names)]
    return small_table(spark, ["category", "target_name", "ordinal"], rows)


def matched_categories(name, targets=R.TARGETS) -> Column:
    """Categories with a catalogue name contained in the text. The catalogue is a handful of rules,
    so it is matched inside the projection and no join is needed."""
    low = F.lower(col(name))
    marks = [F.when(any_word(low, [n.lower() for n in names]), F.lit(c)) for c, names in targets.items()]
    return F.array_compact(F.array(*marks))


def target_hits(obs: DataFrame, name: str = "indicator_name", targets=R.TARGETS) -> DataFrame:
    """One row per observation and covered category."""
    return each(obs, obs.columns, matched_categories(name, targets), "category")


def coverage(obs: DataFrame, name: str = "indicator_name", targets=R.TARGETS) -> DataFrame:
    """Per covered category: observations found, catalogue size, coverage percentage."""
    sizes = F.create_map(*[x for c, names in targets.items() for x in (F.lit(c), F.lit(len(names)))])
    found = target_hits(obs.select(name), name, targets).groupBy("category").agg(F.count("*").alias("n_found"))
    return found.withColumn("n_targets", sizes[F.col("category")]).withColumn(
        "coverage_percentage", F.col("n_found") / F.col("n_targets") * 100
    )


def missing_categories(obs: DataFrame, name: str = "indicator_name", targets=R.TARGETS) -> DataFrame:
    catalogue = targets_table(obs.sparkSession, targets).select("category").distinct()
    return catalogue.join(target_hits(obs.select(name), name, targets), "category", "left_anti")


def recognised_units(obs: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows whose unit contains a recognised key, with the first key and its description."""
    named = obs.withColumns(
        {"recognised_unit": units.recognised(unit), "unit_description": units.recognised_description(unit)}
    )
    return named.filter("recognised_unit IS NOT NULL")


def first_available(primary: DataFrame, alternative: DataFrame, emergency: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Primary result, else the alternative route's, else the emergency one; ``provenance`` tells
    which. Keys without any result are absent; a null key is a key. One combining aggregate; of several rows of one
    route any may be taken."""
    routes = {"primary": primary, "alternative": alternative, "emergency": emergency}
    frames = [
        df.select(key, F.lit(rank).alias("rank"), F.struct(*values, F.lit(route).alias("provenance")).alias("row"))
        for rank, (route, df) in enumerate(routes.items())
    ]
    ranked = reduce(lambda a, b: a.union(b), frames)
    return ranked.groupBy(key).agg(F.min_by("row", "rank").alias("best")).select(key, "best.*")


def compare_runs(base: DataFrame, other: DataFrame, key: str, count: str) -> DataFrame:
    """Value counts of two runs side by side: difference, percentage and verdict."""
    a = base.groupBy(key).agg(F.sum(count).alias("base_values"))
    b = other.groupBy(key).agg(F.sum(count).alias("other_values"))
    both = a.join(b, key, "full_outer").na.fill(0, ["base_values", "other_values"])
    difference = F.col("other_values") - F.col("base_values")
    return both.withColumns(
        {
            "difference": difference,
            "percentage": F.when(difference > 0, difference / F.greatest("base_values", F.lit(1)) * 100).otherwise(0.0),
            "verdict": F.when(difference > 0, "improved").when(difference == 0, "identical").otherwise("worse"),
        }
    )


def run_recommendation(runs: DataFrame, base_time: str, other_time: str) -> DataFrame:
    """Which of two runs to prefer by values and time."""
    same = F.col("base_values") == F.col("other_values")
    choice = (
        F.when(same & (F.col(base_time) < F.col(other_time)), "base_same_results_faster")
        .when(F.col("other_values") > F.col("base_values"), "other_more_data")
        .otherwise("base")
    )
    return runs.withColumn("recommendation", choice)


def enrich_observations(obs: DataFrame, pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Observation with the analysis of its page and the task that collected it. Page and task sides
    are reduced to the needed columns first; the strategy of each join is left to the optimiser."""
    source = urls.source_analysis("url")
    page_side = pages.select(
        "page_id", "task_id", urls.normalise("url").alias("normalized_url"),
        source["is_government"].alias("is_government"), source["content_type"].alias("content_type"),
    )
    task_side = tasks.select("task_id", F.col("status").alias("task_status"), text.iso_timestamp("created_at").alias("task_created_at"))
    return obs.join(page_side, "page_id", "left").join(task_side, "task_id", "left")


def category_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct categories of two runs."""
    return a.select("category").union(b.select("category")).distinct()


def with_category(obs: DataFrame) -> DataFrame:
    return obs.withColumn("category", labels.category("indicator_name"))
