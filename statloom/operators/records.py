"""Observation records and task records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import labels, numbers, scores, units, years
from statloom.functions import rules as R
from statloom.functions.common import cut


def enrich(values: DataFrame, tag: str = "record", default_year: int = R.DEFAULT_YEAR) -> DataFrame:
    """Observation record from name, value, unit, raw text and an optional year. Implausible values
    are dropped, so no record is ever null."""
    kept = values.filter(numbers.plausible_for_name("value", "indicator_name"))
    year = F.coalesce("year", years.from_record("raw_text", "indicator_name"), F.lit(default_year))
    described = kept.withColumns(
        {
            "year": year.cast("int"),
            "category": labels.category("indicator_name"),
            "unit_description": units.describe("unit"),
            "is_target_indicator": labels.is_target("indicator_name"),
            "semantic_quality": scores.semantic_quality("indicator_name", "value", "unit"),
            "context_text": cut("raw_text", 150),
        }
    )
    return described.withColumns(
        {
            "indicator_name": F.trim("indicator_name"),
            "unit": F.trim("unit"),
            "raw_text": cut("raw_text", 200),
            "temporal_context": F.concat(F.col("year").cast("string"), F.lit(f"-{tag}")),
            "validated": F.lit(True),
        }
    )


def from_validated(values: DataFrame) -> DataFrame:
    """Observation record from a validated one: fixed quality, validated tag."""
    return values.withColumns(
        {
            "category": labels.category("indicator_name"),
            "unit_description": units.describe("unit"),
            "is_target_indicator": labels.is_target("indicator_name"),
            "semantic_quality": F.lit(0.8),
            "validated": F.lit(True),
            "year": F.coalesce("year", F.lit(R.DEFAULT_YEAR)),
            "temporal_context": F.concat(F.coalesce("year", F.lit(R.DEFAULT_YEAR)).cast("string"), F.lit("-validated")),
        }
    )
