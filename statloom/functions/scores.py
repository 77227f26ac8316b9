"""Scores of observations, texts and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import (
    all_matches, any_in, between, chain, clamp, col, count_in, first_of, hits_in, let, n_matches, n_words,
)
from statloom.functions.html import inner_text, tables

_NUMBER = r"\b\d+[.,]?\d*\b"


def _in_period(year) -> Column:
    return between(year, R.PERIOD_START, R.PERIOD_END)


def observation_confidence(name, value, unit, year, raw_text=None, terms=R.STRICT_TERMS) -> Column:
    """Base 0.5, more for a year in the period, a known term, a unit and a plausible value, less
    for a short raw text."""
    total = (
        F.lit(0.5)
        + F.when(_in_period(year), 0.3).otherwise(0.0)
        + F.when(any_in(F.lower(col(name)), terms), 0.2).otherwise(0.0)
        + F.when(col(unit) != "", 0.1).otherwise(0.0)
        + F.when(F.abs(col(value)) < 1e10, 0.1).otherwise(0.0)
    )
    if raw_text is not None:
        total = total - F.when(F.length(col(raw_text)) < 10, 0.1).otherwise(0.0)
    return clamp(total, 0.0, 1.0)


def semantic_quality(name, value, unit) -> Column:
    total = (
        F.lit(0.5)
        + F.when((F.length(col(name)) > 8) & col(name).rlike(r"\p{L}"), 0.2).otherwise(0.0)
        + F.when(col(unit) != "", 0.1).otherwise(0.0)
        + F.when(between(F.abs(col(value)), 0.01, 1000000.0), 0.2).otherwise(0.0)
    )
    return F.least(F.lit(1.0), total)


def national_context(text) -> dict[str, Column]:
    """Institution, place and term hits with strength label, number density and recent years."""
    low = F.lower(col(text))
    institutions = count_in(low, R.NATIONAL_INSTITUTIONS)
    places = count_in(low, R.NATIONAL_PLACES)
    terms = count_in(low, R.NATIONAL_TERMS)
    score = institutions + places + terms
    density = n_matches(text, _NUMBER) * F.lit(1000.0) / F.greatest(n_words(text), F.lit(1))
    return {
        "is_national": score > 0,
        "strength": chain(
            [(score >= 3, F.lit("high")), (score >= 2, F.lit("medium")), (score >= 1, F.lit("low"))], F.lit("none")
        ),
        "institution_hits": institutions,
        "place_hits": places,
        "term_hits": terms,
        "numeric_density": density,
        "recent_years": n_matches(text, r"\b202[0-9]\b"),
        "national_score": F.least(F.lit(1.0), score / 5),
        "richness": chain([(density > 50, F.lit("high")), (density > 20, F.lit("medium"))], F.lit("low")),
    }


def context_density(text) -> dict[str, Column]:
    def found(*lists) -> Column:
        return let(F.lower(col(text)), lambda low: sum((count_in(low, terms) for terms in lists[1:]), count_in(low, lists[0])))

    return {
        "institutional_density": found(R.DENSITY_INSTITUTIONS),
        "geographic_density": found(R.DENSITY_PLACES),
        "term_density": found(R.DENSITY_TERMS),
        "overall_score": found(R.DENSITY_INSTITUTIONS, R.DENSITY_PLACES, R.DENSITY_TERMS) / 3,
    }


def site_context(text, groups=R.SITE_CONTEXT) -> dict[str, Column]:
    """Matched terms of each group (at most three shown), a capped score and a flag."""
    low = F.lower(col(text))
    total = sum((count_in(low, terms) for terms in groups.values()), F.lit(0))
    out = {f"hits_{name}": hits_in(low, terms, 3) for name, terms in groups.items()}
    out["context_score"] = F.least(total / 10, F.lit(1.0))
    out["is_national_site"] = total > 2
    return out


def data_density(text) -> Column:
    """Numbers plus five per table word, over the word count, at most one."""
    tables = let(F.lower(col(text)), lambda low: F.regexp_count(low, F.lit("tableau")) + F.regexp_count(low, F.lit("table")))
    raw = (F.regexp_count(col(text), F.lit(r"[0-9]+")) + tables * 5) / F.greatest(n_words(text), F.lit(1))
    return F.when(F.length(col(text)) == 0, 0.0).otherwise(F.least(raw, F.lit(1.0)))


def temporal_references(text, n_years: int | None = None, n_months: int | None = None) -> dict[str, Column]:
    years = F.array_distinct(all_matches(text, r"\b(20[0-2][0-9])\b", 1))
    months = F.array_distinct(
        all_matches(F.lower(col(text)), r"\b(" + "|".join(R.MONTHS) + r")\b", 1)
    )
    return {
        "years": first_of(F.array_sort(years), n_years),
        "months": first_of(F.array_sort(months), n_months),
        "temporal_coverage": F.size(years),
        "recent_data": F.exists(years, lambda y: y >= "2020"),
    }


def credibility(text) -> Column:
    def points(low: Column) -> Column:
        return (
            any_in(low, R.CREDIBLE_INSTITUTIONS).cast("int") * 2
            + any_in(low, R.CREDIBLE_METHOD).cast("int")
            + any_in(low, R.CREDIBLE_REFERENCE).cast("int")
        )

    level = lambda n: chain([(n >= 3, F.lit("high")), (n >= 2, F.lit("medium"))], F.lit("low"))
    return let(let(F.lower(col(text)), points), level)


def topic_terms_found(text, topic, topics=R.TOPICS) -> Column:
    """How many indicator terms of the row's topic the text contains; null for other topics."""
    def found(low: Column) -> Column:
        counts = [(col(topic) == name, count_in(low, spec["indicators"])) for name, spec in topics.items()]
        return chain(counts, F.lit(None).cast("int"))

    return let(F.lower(col(text)), found)


def topic_hits(text, topic, topics=R.TOPICS) -> Column:
    def found(low: Column) -> Column:
        hits = [(col(topic) == name, hits_in(low, spec["indicators"])) for name, spec in topics.items()]
        return chain(hits, F.array().cast("array<string>"))

    return let(F.lower(col(text)), found)


def specialisation(text, topic, topics=R.TOPICS) -> Column:
    found = topic_terms_found(text, topic, topics)
    return F.when(found >= 3, "expert").when(found >= 2, "intermediate").otherwise("basic")


def has_methodology(text) -> Column:
    return any_in(F.lower(col(text)), R.METHODOLOGY_TERMS)


def text_statistics(text, n_numbers: int | None = None) -> dict[str, Column]:
    c = col(text)
    numbers = F.regexp_extract_all(c, F.lit(r"[0-9]+[.,]?[0-9]*"), F.lit(0))
    return {
        "length": F.length(c),
        "words": n_words(c),
        "numbers": F.size(numbers),
        "percentages": F.regexp_count(c, F.lit(r"[0-9]+[.,]?[0-9]*\s*%")),
        "first_numbers": first_of(numbers, n_numbers),
        "detail": F.when(F.length(c) > 2000, "riche").when(F.length(c) > 500, "moyen").otherwise("basique"),
    }


def analysis_confidence(overall_score, text, n_insights, model_success=False) -> Column:
    """Sum of factors: more than three insights, national context, any digit, model outcome."""
    return F.least(
        F.when(col(n_insights) > 3, 0.3).otherwise(0.0)
        + col(overall_score) * 0.2
        + F.when(col(text).rlike("[0-9]"), 0.2).otherwise(0.0)
        + (F.lit(0.3) if model_success else F.lit(0.1)),
        F.lit(1.0),
    )


def analysis_quality(text, density, credible, n_hits, model_success=False) -> Column:
    """Mean of the factors that apply."""
    length = F.length(col(text))
    factors = [
        F.when(length > 2000, 1.0).when(length > 500, 0.7).otherwise(0.3),
        col(density),
        F.when(col(credible) == "high", 1.0).when(col(credible) == "medium", 0.6).otherwise(0.2),
    ]
    total, count = sum(factors[1:], factors[0]), F.lit(3)
    total = total + F.when(col(n_hits) > 0, 0.8).otherwise(0.0)
    count = count + (col(n_hits) > 0).cast("int")
    if model_success:
        total, count = total + 0.9, count + 1
    return total / count


def page_richness(text, html, url) -> Column:
    """Richness of a page from tables, terms, numbers, URL words, lists and institutions."""
    h = col(html)

    def of_text(low: Column) -> Column:
        by_numbers = lambda n: chain([(n > 30, F.lit(0.25)), (n > 15, F.lit(0.15)), (n > 5, F.lit(0.1))], F.lit(0.0))
        return F.struct(
            F.least(count_in(low, R.RICHNESS_TERMS) * 0.04, F.lit(0.3)).alias("terms"),
            let(n_matches(low, _NUMBER), by_numbers).alias("numbers"),
            F.least(count_in(low, R.RICHNESS_SPECIAL) * 0.05, F.lit(0.2)).alias("special"),
            F.when(any_in(low, R.RICHNESS_INSTITUTIONS), 0.15).otherwise(0.0).alias("institutions"),
        )

    total = lambda t: (
        F.when(h.rlike(r"(?i)<table\b"), 0.3).otherwise(0.0)
        + F.when(F.exists(tables(html), lambda x: inner_text(x).rlike("[0-9]")), 0.2).otherwise(0.0)
        + t["terms"]
        + t["numbers"]
        + F.when(any_in(F.lower(col(url)), R.RICHNESS_URL), 0.2).otherwise(0.0)
        + F.when(F.regexp_count(h, F.lit(r"(?i)<(?:ul|ol|dl)\b")) > 3, 0.1).otherwise(0.0)
        + t["special"]
        + t["institutions"]
    )
    return F.least(let(let(F.lower(col(text)), of_text), total), F.lit(1.0))


def exploration_potential(score) -> Column:
    return F.when(col(score) > 0.7, "high").when(col(score) > 0.4, "medium").otherwise("low")


def recommended_depth(n_priority_links) -> Column:
    return F.when(col(n_priority_links) > 10, 3).when(col(n_priority_links) > 5, 2).otherwise(1)


def result_confidence(content_length, n_structures, seconds, has_metadata=True) -> Column:
    """Weighted content length, structure count and time, plus a bonus for metadata."""
    total = (
        F.when(col(content_length) > 0, F.least(col(content_length) / 1000, F.lit(1.0)) * 0.4).otherwise(0.0)
        + F.when(col(n_structures) > 0, F.least(col(n_structures) / 5, F.lit(1.0)) * 0.3).otherwise(0.0)
        + F.greatest(F.lit(0.0), 1 - col(seconds) / 60) * 0.2
    )
    return total + (F.lit(0.1) if has_metadata else F.lit(0.0))
