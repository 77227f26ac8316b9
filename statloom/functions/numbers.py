"""Number parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import any_word, between, cast_digits, chain, col, keep_if, let, year_like

_FLOAT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def to_double(c) -> Column:
    """Strict float cast: plain decimal or scientific notation, else null."""
    return F.when(col(c).rlike(_FLOAT), F.trim(col(c)).try_cast("double"))


def _decimal_point(c: Column) -> Column:
    """The last of comma and point is the decimal separator, the other one groups thousands: drop
    points before a final comma, then commas before a point."""
    ungrouped = F.regexp_replace(c, r"(?s)\.(?=.*,[^.]*$)", "")
    return F.translate(F.regexp_replace(ungrouped, r"(?s),(?=.*\.)", ""), ",", ".")


def _number(kept: Column) -> Column:
    """Number of a text of which only digits, punctuation and white space are kept; most have no digit."""
    return _decimal_point(keep_if(kept, lambda k: k.rlike("[0-9]"))).try_cast("double")


def parse_european(c) -> Column:
    """``1.234,56`` and ``1,234.56`` and ``12,5 %``; null when no number remains. A non-breaking
    space counts as a space."""
    return _number(F.regexp_replace(col(c), r"[^0-9\t\n\x0B\f\r,.\-]", ""))


def parse_or_zero(c) -> Column:
    return F.coalesce(_number(F.regexp_replace(col(c), r"[^0-9.,\-]", "")), F.lit(0.0))


def parse_clean(c) -> Column:
    """Signed form that rejects huge values and years in disguise."""
    kept = F.regexp_replace(col(c), r"[^0-9\t\n\x0B\f\r,.\-+]", "")
    return keep_if(_number(kept), lambda v: (F.abs(v) <= 1e12) & ~year_like(v))


def _id_like(raw: Column) -> Column:
    """``12345/7`` and ``3/5`` are identifiers or progress, not numbers."""
    num = F.regexp_extract(raw, r"^([0-9]+)/[0-9]+$", 1).try_cast("double")
    den = F.regexp_extract(raw, r"^[0-9]+/([0-9]+)$", 1).try_cast("double")
    return raw.rlike("^[0-9]+/[0-9]+$") & ((num > 1000) | (den > 1000) | ((num < 10) & (den < 10) & (num < den)))


def _dotted(text: Column) -> Column:
    comma, point = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    decimal = (
        F.when(comma & ~point, F.translate(text, ",", "."))
        .when(comma & point & text.rlike(r",[^.]*$"), F.translate(text, ",.", "."))
        .otherwise(text)
    )
    return F.regexp_replace(decimal, r"([0-9])\s+([0-9])", "$1$2")


def _fraction(text: Column) -> Column:
    top = let(F.split_part(text, F.lit("/"), F.lit(1)), to_double)
    bottom = let(F.split_part(text, F.lit("/"), F.lit(2)), to_double)
    return let(
        F.struct(top.alias("top"), bottom.alias("bottom")),
        lambda f: F.when((f["bottom"] != 0) & (f["top"] <= 10000) & (f["bottom"] <= 10000), f["top"] / f["bottom"]),
    )


def parse_table_value(c) -> Column:
    """Cell parser with guards against identifiers, links, long text and progress fractions."""
    nothing = F.lit(None).cast("double")

    def parsed(text: Column) -> Column:
        plain = keep_if(cast_digits(F.regexp_replace(text, r"[^0-9.\-]", ""), "double"), lambda v: F.abs(v) <= 1e15)
        return F.when(text.rlike("^[^/]*/[^/]*$"), _fraction(text)).otherwise(plain)

    def guarded(raw: Column) -> Column:
        junk = (raw == "") | (F.length(raw) > 50) | any_word(F.lower(raw), ["http", "www", "@", "#", "javascript"])
        spaced = F.trim(F.replace(F.translate(raw, "\u00a0", " "), F.lit("  "), F.lit(" ")))
        percent = let(F.trim(F.replace(spaced, F.lit("%"), F.lit(""))), to_double)
        return chain(
            [(junk | _id_like(raw), nothing), (F.contains(raw, F.lit("%")), percent)],
            let(let(spaced, _dotted), parsed),
        )

    return let(F.regexp_replace(col(c), r"^\s+|\s+$", ""), guarded)


def first_number(c) -> Column:
    return F.translate(F.regexp_extract(col(c), R.NUMBER_TOKEN, 1), ",", ".").try_cast("double")


def all_numbers(c) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(r"(?U)\b\d+[.,]?\d*\b"), F.lit(0))
    return F.transform(found, lambda t: F.translate(t, ",", ".").try_cast("double"))


def is_quick_value(value) -> Column:
    """Not a recent year, absolute value at most 1e10."""
    return ~between(value, 1990.0, 2030.0) & between(value, -1e10, 1e10)


def plausible_for_name(value, name) -> Column:
    """Plausibility by kind of indicator."""
    low = F.lower(col(name))
    v = col(value)
    year_in_disguise = between(v, 1950.0, 2030.0) & any_word(low, R.YEAR_WORDS)
    return chain(
        [
            (year_in_disguise, F.lit(False)),
            (any_word(low, R.RATE_WORDS), between(v, -100.0, 1000.0)),
            (F.contains(low, F.lit("population")), between(v, 1000.0, 50000000.0)),
            (any_word(low, R.GDP_WORDS), (v >= 0) & (v < 1e15)),
        ],
        F.abs(v) < 1e12,
    )


def size_class(value) -> Column:
    return (
        F.when(col(value).isNull(), "text")
        .when(col(value) > 1000, "large_number")
        .when(col(value) < 1, "decimal")
        .otherwise("standard")
    )
