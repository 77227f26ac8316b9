"""Years in texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import all_matches, each
from statloom.operators.windows import best_row


def years_with_values(texts: DataFrame, years: Sequence[int] = R.TARGET_YEARS) -> DataFrame:
    """Per text and target year it mentions: the values that follow the year on its line."""
    found = F.array(
        *[
            F.when(
                F.contains("text", F.lit(str(y))),
                F.struct(
                    F.lit(y).alias("year"),
                    all_matches("text", rf"{y}.*?([0-9]+[,.]?[0-9]*)\s*(?:%|MD|TND|millions?)", 1).alias("found"),
                ),
            )
            for y in years
        ]
    )
    hits = each(texts, ("doc_id",), F.array_compact(found), "y")
    return hits.select("doc_id", "y.year", F.size("y.found").alias("n_values"), F.col("y.found").alias("found"))


def majority_year(texts: DataFrame) -> DataFrame:
    """Most frequent period year of each text, the first seen on a tie, with its count."""
    years = all_matches("text", rf"\b({R.PERIOD_YEAR})\b", 1)
    mentions = each(texts, ("doc_id",), years, "year_text", "place")
    counts = mentions.groupBy("doc_id", F.col("year_text").cast("int").alias("year")).agg(
        F.count("*").alias("n"), F.min("place").alias("place")
    )
    return best_row(counts, ["doc_id"], "n", "place")
