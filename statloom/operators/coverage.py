"""Coverage of the target catalogue by result dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import labels, units
from statloom.functions import rules as R
from statloom.functions.common import count_in, each
from statloom.operators.aggregates import share
from statloom.operators.merging import matched_categories
from statloom.sources.payloads import all_values


def listed_values(dumps: DataFrame) -> DataFrame:
    """All value collections plus one further entry per value with a recognised unit. Table cells are
    listed without a name of their own; only their recognised entry carries it."""
    values = all_values(dumps)
    recognised = values.filter(units.recognised("unit").isNotNull())
    again = recognised.withColumns({"collection": F.lit("recognized_units"), "unit": F.lit("")})
    named = F.when(F.col("collection") != "table_values", F.col("name")).otherwise("")
    return values.withColumn("name", named).unionByName(again)


def target_coverage(dumps: DataFrame, targets=R.TARGETS) -> DataFrame:
    """Per dump: values, covered categories and years, priority count, recognised units."""
    values = listed_values(dumps).withColumn("hits", matched_categories("name", targets))
    unit_known = units.recognised("unit").isNotNull()
    per_dump = values.groupBy("dump_id").agg(
        F.count("*").alias("total_values"),
        F.count_if(unit_known).alias("recognised_values"),
        F.count_if(F.col("is_priority") & (F.col("collection") == "target_indicators")).alias("priority_found"),
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("covered"),
    )
    years = dumps.select("dump_id", count_in("content", [str(y) for y in R.TARGET_YEARS]).alias("years_covered"))
    n = len(targets)
    return (
        years.join(per_dump, "dump_id", "left")
        .withColumn("categories_covered", F.coalesce(F.size("covered"), F.lit(0)))
        .withColumn("overall_coverage_percentage", F.col("categories_covered") / n * 100)
    )


def category_coverage(dumps: DataFrame, targets=R.TARGETS) -> DataFrame:
    """Per dump and covered category: values found and percentage of the catalogue entries."""
    sizes = F.create_map(*[x for c, names in targets.items() for x in (F.lit(c), F.lit(len(names)))])
    values = listed_values(dumps).select("dump_id", matched_categories("name", targets).alias("hits"))
    found = each(values, ("dump_id",), F.col("hits"), "category").groupBy("dump_id", "category").agg(F.count("*").alias("n_found"))
    return found.withColumn("coverage_percentage", F.col("n_found") / sizes[F.col("category")] * 100)


def data_quality(covered: DataFrame) -> DataFrame:
    """Half coverage, three tenths units, two tenths years, with a level."""
    scores = covered.withColumns(
        {
            "target_score": F.col("overall_coverage_percentage") / 100,
            "unit_score": F.least(share(F.col("recognised_values"), F.col("total_values")), F.lit(1.0)),
            "temporal_score": F.least(F.col("years_covered") / len(R.TARGET_YEARS), F.lit(1.0)),
        }
    )
    overall = F.col("target_score") * 0.5 + F.col("unit_score") * 0.3 + F.col("temporal_score") * 0.2
    return scores.withColumn("overall_score", overall).withColumn("quality_level", labels.coverage_level("overall_score"))


def target_validation(dumps: DataFrame, targets=R.TARGETS) -> DataFrame:
    """Per dump: targets found, categories with findings, unknown units, coverage score, status."""
    known = [d for _, d in R.RECOGNIZED_UNITS] + R.VALID_UNIT_EXTRAS
    found = all_values(dumps).filter(F.col("collection") == "target_indicators")
    n_targets = sum(len(names) for names in targets.values())
    invalid = F.when(~F.col("unit").isin(known), F.col("unit"))
    counted = found.groupBy("dump_id").agg(
        F.count("*").alias("targets_found"),
        F.count_distinct(F.when(F.col("category").isin(list(targets)), F.col("category"))).alias("categories_with_findings"),
        F.array_sort(F.collect_set(invalid)).alias("invalid_units"),
    )
    score = (F.col("targets_found") / n_targets + F.col("categories_with_findings") / len(targets)) / 2
    status = F.when(F.col("coverage_score") > 0.7, "excellent").when(F.col("coverage_score") > 0.4, "good").otherwise("needs_improvement")
    return counted.withColumn("coverage_score", score).withColumn("validation_status", status)
