"""Units of observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import any_word, chain, col, cut


def _combined(value_text, label) -> Column:
    return F.lower(F.concat(F.coalesce(col(value_text), F.lit("")), F.lit(" "), F.coalesce(col(label), F.lit(""))))


def from_text(value_text, label) -> Column:
    """First unit pattern found in value text and label."""
    text = _combined(value_text, label)
    return chain([(text.rlike(p), F.lit(u)) for p, u in R.UNIT_PATTERNS], F.lit(""))


def from_text_or_name(value_text, label) -> Column:
    """As :func:`from_text` with a finer table, then a default by the kind of indicator."""
    text, low = _combined(value_text, label), F.lower(F.coalesce(col(label), F.lit("")))
    by_pattern = [(text.rlike(p), F.lit(u)) for p, u in R.UNIT_PATTERNS_CLEAN]
    by_name = [(any_word(low, terms), F.lit(u)) for terms, u in R.UNIT_BY_NAME_CLEAN]
    return chain(by_pattern + by_name, F.lit(""))


def default_bank(name, hint, value) -> Column:
    low = F.lower(col(name))
    return chain(
        [
            (col(hint) != "", F.upper(col(hint))),
            (any_word(low, ["taux", "rate"]), F.lit("%")),
            (col(value) > 1000, F.lit("MD")),
        ],
        F.lit("TND"),
    )


def default_office(name, value) -> Column:
    low = F.lower(col(name))
    return chain(
        [
            (any_word(low, ["épargne", "formation", "capital"]), F.when(col(value) > 1000, "MD").otherwise("MDT")),
            (any_word(low, ["taux", "croissance"]), F.lit("%")),
            (F.contains(low, F.lit("population")), F.lit("habitants")),
        ],
        F.lit("MD"),
    )


def default_context(name, value) -> Column:
    low = F.lower(col(name))
    return chain(
        [
            (any_word(low, ["taux", "%", "croissance"]), F.lit("%")),
            (any_word(low, ["pib", "budget", "dette"]), F.when(col(value) > 100, "MD").otherwise("MDT")),
            (F.contains(low, F.lit("population")), F.lit("habitants")),
        ],
        F.lit(""),
    )


def standardise(unit, name, value) -> Column:
    """Known spellings map to one unit; an empty unit is inferred from name and value; any other
    unit is cut to ten characters."""
    u = F.trim(col(unit))
    low_name, low_unit = F.lower(col(name)), F.lower(u)
    inferred = chain(
        [
            (any_word(low_name, ["taux", "inflation", "chomage", "%"]), F.lit("%")),
            (any_word(low_name, ["pib", "dette", "budget"]), F.when(col(value) > 1000, "MD").otherwise("MDT")),
            (F.contains(low_name, F.lit("population")), F.lit("habitants")),
        ],
        F.lit(""),
    )
    known = [(F.contains(low_unit, F.lit(k)), F.lit(v)) for k, v in R.UNIT_STANDARD]
    return chain([(u == "", inferred), *known], cut(u, 10))


def describe(unit, table=None) -> Column:
    """Long name of a unit, matched on the upper-cased unit; unknown units stand for themselves."""
    table = table or R.UNIT_DESCRIPTION
    return chain([(F.upper(col(unit)) == k, F.lit(v)) for k, v in table.items()], col(unit))


def recognised(unit, table=R.RECOGNIZED_UNITS) -> Column:
    """First recognised key contained in the unit, null when there is none."""
    low = F.lower(col(unit))
    return chain([(F.contains(low, F.lit(k)), F.lit(k)) for k, _ in table], F.lit(None).cast("string"))


def recognised_description(unit, table=R.RECOGNIZED_UNITS) -> Column:
    low = F.lower(col(unit))
    return chain([(F.contains(low, F.lit(k)), F.lit(v)) for k, v in table], F.lit(None).cast("string"))


