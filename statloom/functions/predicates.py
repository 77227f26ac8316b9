"""Predicates on indicator names, values and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions import years
from statloom.functions.common import any_word, between, chain, col, is_true, starts_with_pattern, year_like


def is_clean_indicator(name) -> Column:
    """No excluded pattern, and a valid or related term."""
    n = col(name)
    low = F.trim(F.lower(n))
    known = any_word(low, R.CLEAN_VALID_TERMS) | any_word(low, R.CLEAN_RELATED_TERMS)
    return is_true((F.length(n) >= 3) & ~starts_with_pattern(low, R.CLEAN_EXCLUDE_PATTERNS) & known)


def strict_reject(name, value) -> Column:
    """Reason to drop an obvious non-indicator, null to keep it."""
    low = F.trim(F.lower(F.coalesce(col(name), F.lit(""))))
    too_long = (F.length(low) > 150) | (F.regexp_count(low, F.lit(" ")) > 15)
    no_context = ~any_word(low, R.STRICT_CONTEXT_TERMS)
    return chain(
        [
            (F.length(low) < 3, F.lit("short_name")),
            (starts_with_pattern(low, R.STRICT_REJECT_PATTERNS), F.lit("pattern")),
            (~any_word(low, R.STRICT_TERMS) & (too_long | no_context), F.lit("no_known_term")),
            (year_like(value), F.lit("year_like_value")),
        ],
        F.lit(None).cast("string"),
    )


def is_general_indicator(name) -> Column:
    n = F.lower(col(name))
    return is_true((F.length(n) >= 3) & ~n.rlike(R.GENERAL_EXCLUDE) & any_word(n, R.GENERAL_TERMS))


def is_office_indicator(name) -> Column:
    return is_true(any_word(F.lower(col(name)), R.OFFICE_TERMS))


def record_reject(year, value, confidence) -> Column:
    """Strict record constraint: reason of the first violated rule."""
    return chain(
        [
            (~is_true(years.in_period(year)), F.lit("year_outside_period")),
            (col(value).isNull(), F.lit("not_numeric")),
            (year_like(value), F.lit("year_like_value")),
            (F.abs(col(value)) > 1e12, F.lit("implausible_value")),
            (~is_true(between(confidence, 0.0, 1.0)), F.lit("confidence_out_of_range")),
        ],
        F.lit(None).cast("string"),
    )


def is_permissive_indicator(name) -> Column:
    """Wide acceptance: any known term, else a number together with at least two words."""
    n = col(name)
    low = F.trim(F.lower(n))
    described = low.rlike("[0-9]") & low.rlike(r"\S\s+\S") & (F.length(low) < 100)
    return is_true(
        (F.length(n) >= 2)
        & ~starts_with_pattern(low, R.PERMISSIVE_REJECT_PATTERNS)
        & (any_word(low, R.PERMISSIVE_TERMS) | described)
    )


def is_undated_indicator(name, value) -> Column:
    low = F.lower(col(name))
    return is_true(any_word(low, R.UNDATED_TERMS) & (F.length(low) >= 3)) & col(value).isNotNull()


def period_outcome(year, is_gov) -> Column:
    """How the period filter treats an observation."""
    y, gov = col(year), col(is_gov)
    return chain(
        [
            (y.isNull() & gov, F.lit("government_default_2024")),
            (y.isNull(), F.lit("rejected_no_year")),
            (years.in_period(year), F.lit("in_target_period")),
            (between(year, R.EXTENDED_START, R.EXTENDED_END), F.lit("extended_period_accepted")),
            (gov, F.lit("government_permissive_mode")),
        ],
        F.lit("rejected_outside"),
    )
