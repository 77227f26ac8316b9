"""Labels of observations, pages, texts and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import any_in, any_word, chain, col, count_in, first_label, let


def category(name, groups=R.CATEGORY_GROUPS) -> Column:
    return first_label(F.lower(col(name)), groups, "OTHER")


def category_clean(name, groups=R.CATEGORY_GROUPS_CLEAN) -> Column:
    return F.when(col(name) == "", "UNKNOWN").otherwise(first_label(F.lower(col(name)), groups, "ECONOMIC_GENERAL"))


def is_target(name, terms=R.TARGET_TERMS) -> Column:
    return any_word(F.lower(col(name)), terms)


def target_category(name, targets=R.TARGETS, keywords=R.TARGET_KEYWORDS) -> Column:
    """Catalogue entry contained, or one of its first two words; then keywords."""
    low = F.lower(col(name))
    by_entry = []
    for group, entries in targets.items():
        terms: list[str] = []
        for entry in entries:
            terms += [entry.lower(), *entry.lower().split()[:2]]
        by_entry.append((any_word(low, terms), F.lit(group)))
    by_word = [(any_word(low, terms), F.lit(group)) for terms, group in keywords]
    return chain([(low == "", F.lit("unknown")), *by_entry, *by_word], F.lit("other"))


def topic_scores(low: Column, src: Column, topics=R.TOPICS) -> dict[str, Column]:
    """Points of each topic for a text and a source in lower case."""
    return {
        name: count_in(low, spec["keywords"]) * 2 + count_in(src, spec["keywords"]) * 3 + count_in(low, spec["indicators"])
        for name, spec in topics.items()
    }


def topic(text, source, topics=R.TOPICS) -> Column:
    """Best-scoring topic; the first one wins a tie. Text and source are lower-cased once, not for every term."""

    def ranked(low: Column, src: Column) -> Column:
        return F.array(
            *[
                F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("topic"))
                for i, (name, score) in enumerate(topic_scores(low, src, topics).items())
            ]
        )

    scored = let(F.lower(col(text)), lambda low: let(F.lower(col(source)), lambda src: F.array_max(ranked(low, src))))
    best = let(scored, lambda b: F.when(b["score"] > 0, b["topic"]).otherwise("general"))
    return F.when(F.coalesce(col(text), F.lit("")) == "", "empty_content").otherwise(best)


def page_class(text, url) -> Column:
    def classed(low: Column) -> Column:
        link = F.lower(col(url))
        by_text = [(any_in(low, terms), F.lit(v)) for terms, v in R.PAGE_CLASSES_TEXT]
        by_url = [(any_in(link, terms), F.lit(v)) for terms, v in R.PAGE_CLASSES_URL]
        return chain(by_text + by_url, F.lit(R.PAGE_CLASS_DEFAULT))

    return let(F.lower(col(text)), classed)


def content_category(text, url) -> Column:
    low, link = F.lower(col(text)), F.lower(col(url))
    return chain(
        [
            (F.contains(link, F.lit("bct.gov.tn")) | any_in(low, R.CONTENT_ECONOMIC), F.lit("economic")),
            (F.contains(link, F.lit("ins.tn")) | any_in(low, R.CONTENT_STATISTICAL), F.lit("statistical")),
            (any_in(low, R.CONTENT_INDUSTRIAL), F.lit("industrial")),
        ],
        F.lit("general"),
    )


def richness_by_count(n) -> Column:
    return F.when(col(n) > 10, "high").when(col(n) > 3, "medium").otherwise("low")


def confidence_class(score) -> Column:
    return F.when(col(score) > 0.7, "high").when(col(score) > 0.4, "medium").otherwise("low")


def two_factor_level(rate, score, high=(0.9, 0.8), good=(0.7, 0.6)) -> Column:
    """Performance level that needs both a success rate and a mean score."""
    return (
        F.when((col(rate) > high[0]) & (col(score) > high[1]), "excellent")
        .when((col(rate) > good[0]) & (col(score) > good[1]), "good")
        .otherwise("needs_improvement")
    )


def rate_level(rate) -> Column:
    return F.when(col(rate) > 0.8, "excellent").when(col(rate) > 0.6, "good").otherwise("needs_improvement")


def quality_level(score) -> Column:
    return chain(
        [(col(score) > 0.8, F.lit("excellent")), (col(score) > 0.6, F.lit("good")), (col(score) > 0.4, F.lit("acceptable"))],
        F.lit("poor"),
    )


def model_level(rate) -> Column:
    return chain(
        [(col(rate) > 0.8, F.lit("excellent")), (col(rate) > 0.6, F.lit("good")), (col(rate) > 0.3, F.lit("poor"))],
        F.lit("failing"),
    )


def coverage_level(score) -> Column:
    return chain(
        [(col(score) > 0.7, F.lit("excellent")), (col(score) > 0.5, F.lit("good")), (col(score) > 0.3, F.lit("fair"))],
        F.lit("poor"),
    )


def priority_bucket(message) -> Column:
    return (
        F.when(any_word(message, R.URGENT_WORDS), "URGENT")
        .when(any_word(message, R.IMPORTANT_WORDS), "IMPORTANT")
        .otherwise("MOYEN TERME")
    )


def run_gate(n_values, n_errors) -> Column:
    """Where a page run goes after extraction."""
    return F.when(col(n_errors) > 2, "error").when(F.coalesce(col(n_values), F.lit(0)) == 0, "empty").otherwise("validate")


def run_outcome(n_values, n_errors) -> Column:
    gate = run_gate(n_values, n_errors)
    return (
        F.when(gate == "validate", "valid")
        .when(gate == "empty", "empty")
        .when(F.coalesce(col(n_values), F.lit(0)) > 0, "partial_recovery")
        .otherwise("failed")
    )
