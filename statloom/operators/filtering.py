"""Row filters with recorded reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import predicates, scores, text, units, urls, years
from statloom.functions import rules as R
from statloom.functions.common import between, chain, col, is_true, join_null_safe, staged


def period_filter(obs: DataFrame, is_gov: Column, year="year") -> DataFrame:
    """Tag every row with the outcome of the period filter; ``kept`` tells survivors."""
    tagged = obs.withColumns({"outcome": predicates.period_outcome(year, is_gov)})
    default = F.col("outcome") == "government_default_2024"
    final_year = F.when(default, R.DEFAULT_YEAR).otherwise(col(year))
    kept = ~F.startswith("outcome", F.lit("rejected"))
    context = F.when(default, F.col("outcome")).otherwise(F.concat(final_year.cast("string"), F.lit("-"), "outcome"))
    return tagged.withColumns(
        {
            "kept": kept,
            "year": final_year.cast("int"),
            "temporal_context": F.when(kept, context),
            "in_target_period": F.when(kept & ~default, F.col("outcome") == "in_target_period"),
        }
    )


def strict_validation(
    obs: DataFrame, raw_text="value_text", content=None, as_of_year: int = R.DEFAULT_YEAR
) -> DataFrame:
    """Strict validation as one projection: non-indicators, missing years, years outside the period
    and record constraints, in that order. ``reject_reason`` is null for valid rows. Unit and confidence are staged: as plain
    columns they are copied into filters on the reason, and the generated method gets too long to be compiled."""
    dated = staged(
        obs,
        {
            "pattern_reason": predicates.strict_reject("indicator_name", "value"),
            "final_year": years.strict_cascade("year", "indicator_name", raw_text, content, as_of_year),
            "clean_name": text.clean_name("indicator_name"),
        },
    )
    united = staged(dated, {"clean_unit": units.standardise("unit", "clean_name", "value")})
    scored = staged(united, {"strict_confidence": scores.observation_confidence("clean_name", "value", "clean_unit", "final_year", raw_text)})
    record = predicates.record_reject("final_year", "value", "strict_confidence")
    reason = chain(
        [
            (F.col("pattern_reason").isNotNull(), F.lit("rejected_patterns")),
            (F.col("final_year").isNull(), F.lit("rejected_no_year")),
            (~years.in_period("final_year"), F.lit("rejected_outside_period")),
            (record.isNotNull(), F.lit("rejected_validation_error")),
        ],
        F.lit(None).cast("string"),
    )
    return scored.withColumn("reject_reason", reason)


def final_cleanup(obs: DataFrame) -> DataFrame:
    """Last filter: name, value, year 2015 to 2027 (from the name when missing) and term rules."""
    named = F.regexp_extract("indicator_name", r"(?U)\b(20[0-2][0-9])\b", 1).try_cast("int")
    year = F.coalesce("year", named, F.lit(R.DEFAULT_YEAR))
    return obs.filter(
        between(year, 2015, 2027)
        & (F.abs("value") < 1e10)
        & (F.length("indicator_name") >= 3)
        & predicates.is_clean_indicator("indicator_name")
    )


def mark_government(obs: DataFrame, site="source_domain") -> DataFrame:
    """Flags set on rows of government sites; other rows keep false."""
    gov = is_true(urls.is_gov_site(site)) & F.col("value").isNotNull()
    return obs.withColumns({"government_validated": gov, "bypass_temporal_filter": gov, "government_permissive": gov})


def emergency_acceptance(obs: DataFrame) -> DataFrame:
    """Keep every row with a value and date it with the default year."""
    return obs.filter("value IS NOT NULL").withColumns(
        {
            "year": F.lit(R.DEFAULT_YEAR),
            "period_type": F.lit("emergency_default"),
            "temporal_context": F.lit("emergency-acceptance"),
            "in_target_period": F.lit(True),
            "acceptance_reason": F.lit("emergency_mode"),
        }
    )


def group_flag(rows: DataFrame, keys: Sequence[str], keep: str) -> DataFrame:
    """Adds ``any_kept``: whether some row of the group is kept. The flag is a hash aggregate joined
    back, so a group that holds a large share of all rows is pre-aggregated and its join partition
    can be split, which a window over the group would not allow."""
    flags = rows.groupBy(*keys).agg(F.max(keep).alias("any_kept"))
    return join_null_safe(rows, flags, keys)


def keep_or_recover(rows: DataFrame, keys: Sequence[str], keep: str) -> DataFrame:
    """Rows that pass; when none of a group passes, all rows of the group. ``recovered`` marks them."""
    flagged = group_flag(rows, keys, keep)
    return flagged.filter(F.col(keep) | ~F.col("any_kept")).withColumn("recovered", ~F.col("any_kept"))


def permissive_with_recovery(obs: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    kept = obs.withColumn("relevant", predicates.is_permissive_indicator("indicator_name"))
    return keep_or_recover(kept, keys, "relevant")


def validation_fallback(obs: DataFrame, keys: Sequence[str] = ("page_id",), **options) -> DataFrame:
    """Validated rows of a page, or its rows from before validation when none is valid."""
    checked = strict_validation(obs, **options).withColumn("is_valid", F.col("reject_reason").isNull())
    return keep_or_recover(checked, keys, "is_valid")


def with_valid_content(pages: DataFrame, obs: DataFrame, content: str = "html") -> DataFrame:
    """Pages with more than 50 characters or with any observation."""
    having = obs.select("page_id").distinct().withColumn("has_values", F.lit(True))
    joined = pages.join(having, "page_id", "left")
    return joined.filter((F.length(text.strip(content)) > 50) | F.col("has_values"))


def tasks_where(tasks: DataFrame, status: str | None = None, task_id: str | None = None, active: bool = False, since=None) -> DataFrame:
    """Task rows by status, id, active states or creation date."""
    out = tasks
    if status:
        out = out.filter(F.col("status") == status)
    if task_id:
        out = out.filter(F.col("task_id") == task_id)
    if active:
        out = out.filter(F.col("status").isin("pending", "running"))
    if since is not None:
        out = out.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return out
