"""Years of observations: pattern cascades as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import all_matches, between, cast_digits, col, cut, let


def in_period(year) -> Column:
    return between(year, R.PERIOD_START, R.PERIOD_END)


def _years(text, pattern: str) -> Column:
    return F.transform(all_matches(text, pattern, 1), lambda y: y.try_cast("int"))


def _first(values: Column, low: int, high: int) -> Column:
    return F.get(F.filter(values, lambda y: between(y, low, high)), F.lit(0))


def _with_digits(text, value: Column) -> Column:
    """Only texts with four digits in a row can hold a year."""
    return F.when(col(text).rlike("[0-9]{4}"), value)


def most_frequent(values: Column) -> Column:
    """Most frequent entry; the first seen wins a tie."""

    def ranked(seen: Column) -> Column:
        return F.transform(
            F.array_distinct(seen),
            lambda y: F.struct(
                F.size(F.filter(seen, lambda z: z == y)).alias("n"),
                (-F.array_position(seen, y)).alias("place"),
                y.alias("year"),
            ),
        )

    return let(values, lambda seen: F.array_max(ranked(seen))["year"])


def from_name(name, patterns: Sequence[str] = R.YEAR_NAME_PATTERNS) -> Column:
    """Per pattern the first year in the period, else the latest valid year of that pattern."""
    low = F.lower(col(name))

    def best(found: Column) -> Column:
        latest = F.array_max(F.filter(found, lambda y: between(y, 1900, 2030)))
        return F.coalesce(_first(found, R.PERIOD_START, R.PERIOD_END), latest)

    return _with_digits(name, F.coalesce(*[let(_years(low, p), best) for p in patterns]))


def from_text(text, patterns: Sequence[str] = R.YEAR_TEXT_PATTERNS, limit: int | None = None) -> Column:
    """Contextual patterns first, else the most frequent year of the period. With a limit, longer texts give none."""
    low = F.lower(col(text))
    contextual = [_first(_years(low, p), R.PERIOD_START, R.PERIOD_END) for p in patterns]
    general = most_frequent(_years(text, rf"\b({R.PERIOD_YEAR})\b"))
    found = _with_digits(text, F.coalesce(*contextual, general))
    return found if limit is None else F.when(F.length(col(text)) <= limit, found)


def from_header(content, patterns: Sequence[str] = R.YEAR_HEADER_PATTERNS) -> Column:
    """Header rule of short documents: contents over 5000 characters have no usable header."""
    head = F.lower(cut(content, 2000))
    found = [_first(_years(head, p), R.PERIOD_START, R.PERIOD_END) for p in patterns]
    return F.when(F.length(col(content)) <= 5000, _with_digits(content, F.coalesce(*found)))


def from_context_vote(content, patterns: Sequence[str] = R.YEAR_CONTEXT_PATTERNS) -> Column:
    """Majority of the candidates of all patterns in the header of a short document."""
    head = F.lower(cut(content, 1500))
    candidates = F.flatten(F.array(*[_years(head, p) for p in patterns]))
    return F.when(
        F.length(col(content)) <= 5000,
        _with_digits(content, most_frequent(F.filter(candidates, in_period))),
    )


def _explicit(year) -> Column:
    return F.when(between(year, 1900, 2030), col(year))


def strict_cascade(year, name, raw_text, content=None, as_of_year: int = R.DEFAULT_YEAR) -> Column:
    """Explicit year, then name, raw text, header, then the current year when it is in the period."""
    options = [_explicit(year), from_name(name), from_text(raw_text)]
    if content is not None:
        options.append(from_header(content))
    if R.PERIOD_START <= as_of_year <= R.PERIOD_END:
        options.append(F.lit(as_of_year))
    return F.coalesce(*options)


def wide_cascade(year, name, raw_text, content=None, metadata: Sequence = (), as_of_year: int = R.DEFAULT_YEAR) -> Column:
    """Explicit year, any year of the name, JSON dates of the raw text, four-digit metadata fields,
    short content, current year."""
    options = [_explicit(year)]
    options += [_with_digits(name, _first(_years(name, p), 1900, 2030)) for p in R.YEAR_WIDE_NAME_PATTERNS]
    raw = col(raw_text)
    dated = F.contains(raw, F.lit("date")) | F.contains(raw, F.lit("year"))
    options += [F.when(dated, _first(_years(raw, p), R.PERIOD_START, R.PERIOD_END)) for p in R.YEAR_JSON_PATTERNS]
    for m in metadata:
        number = F.when(col(m).rlike("^[0-9]{4}$"), col(m).try_cast("int"))
        options.append(F.when(in_period(number), number))
    if content is not None:
        options.append(F.when(F.length(col(content)) < 3000, from_context_vote(content)))
    options.append(F.lit(as_of_year if R.PERIOD_START <= as_of_year <= R.PERIOD_END else R.DEFAULT_YEAR))
    return F.coalesce(*options)


def _period_year(text) -> Column:
    return cast_digits(F.regexp_extract(col(text), rf"(?U)\b({R.PERIOD_YEAR})\b", 1), "int")


def from_headers(headers, index, url, as_of_year: int = R.DEFAULT_YEAR) -> Column:
    """Year of a table column: its own header, any header, the URL, the current year."""
    own = _period_year(F.get(col(headers), col(index)))
    anywhere = F.get(
        F.filter(F.transform(col(headers), lambda h: _period_year(h)), lambda y: y.isNotNull()), F.lit(0)
    )
    return F.coalesce(own, anywhere, from_snippet(F.lit(""), url, as_of_year))


def from_snippet(text, url, as_of_year: int = R.DEFAULT_YEAR) -> Column:
    return F.coalesce(_period_year(text), _period_year(url), F.lit(as_of_year))


def from_record(raw_text, name) -> Column:
    """First year of the 2010s and 2020s in raw text and name, kept when it is in the period."""
    both = F.lower(F.concat(col(raw_text), F.lit(" "), col(name)))
    year = cast_digits(F.regexp_extract(both, r"(?U)\b(20[1-2][0-9])\b", 1), "int")
    return F.when(in_period(year), year)
