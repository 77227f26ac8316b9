"""Column building blocks used by every rule-driven operator."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null, so that rows without a key keep their totals and flags."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def first_of(items, limit: int | None) -> Column:
    """The first ``limit`` items of an array, all of them without a limit."""
    return col(items) if limit is None else F.slice(col(items), 1, limit)


def _fold(parts: list[Column], op) -> Column:
    """Combine pairwise, so the expression tree stays shallow."""
    while len(parts) > 1:
        parts = [op(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def any_in(c, terms: Sequence[str]) -> Column:
    """True when the text contains at least one term."""
    return _fold([F.contains(col(c), F.lit(t)) for t in terms], lambda a, b: a | b)


def any_word(c, terms: Sequence[str]) -> Column:
    """As :func:`any_in` for short texts such as names: one scan, and the text expression appears
    once however long the list is."""
    return col(c).rlike("|".join(re.escape(t) for t in terms))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times in the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value when it passes, else null; the value expression is evaluated once."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def cast_digits(value: Column, kind: str) -> Column:
    """As ``try_cast`` of a text that holds digits and punctuation at most. A failed cast makes an exception with its stack,
    which costs more than the search for a digit, and most texts hold no number at all."""
    return keep_if(value, lambda v: v.rlike("[0-9]")).try_cast(kind)


def each(df: DataFrame, keep: Sequence[str], array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element. The outer form followed by a null filter keeps Spark from
    evaluating the array a second time in an inferred size filter."""
    if position is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(name).isNotNull())


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated once per row. Spark copies the expression of a plain column
    into every filter that is pushed below it; a generated column stays where it is. Meant for
    expressions that scan whole texts."""
    record = F.struct(*[c.alias(n) for n, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode_outer(F.array(record)).alias("_s")).select(*rest, "_s.*")


def count_in(c, terms: Sequence[str]) -> Column:
    """Number of terms the text contains."""
    return _fold([F.contains(col(c), F.lit(t)).cast("int") for t in terms], lambda a, b: a + b)


def hits_in(c, terms: Sequence[str], limit: int | None = None, fold: bool = False) -> Column:
    """The contained terms, in rule order. ``fold`` compares with the lower-cased term."""
    text = col(c)
    marks = [F.when(F.contains(text, F.lit(t.lower() if fold else t)), F.lit(t)) for t in terms]
    found = F.array_compact(F.array(*marks))
    return F.slice(found, 1, limit) if limit else found


def first_label(c, groups: Iterable[tuple[Sequence[str], str]], default: str) -> Column:
    """Label of the first group with a contained term."""
    return chain([(any_word(c, terms), F.lit(label)) for terms, label in groups], F.lit(default))


def chain(branches: Sequence[tuple[Column, object]], default) -> Column:
    """Ordered conditions; the first true one wins."""
    (first, value), *rest = branches
    out = F.when(first, value)
    for cond, v in rest:
        out = out.when(cond, v)
    return out.otherwise(default)


def ends_with_any(c, endings: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(col(c), F.lit(e)) for e in endings])


def starts_with_pattern(c, patterns: Sequence[str]) -> Column:
    """True when one of the patterns matches at the beginning of the text."""
    return col(c).rlike(regex("^(?:" + "|".join(patterns) + ")"))


def regex(pattern: str, ignore_case: bool = True) -> str:
    """Pattern with flags for text in any language: only a line feed ends a line, and word
    classes and boundaries cover accented letters."""
    flags = "d" + ("iu" if ignore_case else "")
    if r"\b" in pattern or r"\w" in pattern:
        flags += "U"
    return f"(?{flags}){pattern}"


def all_matches(c, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(col(c), F.lit(regex(pattern, ignore_case)), F.lit(group))


def n_matches(c, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(col(c), F.lit(regex(pattern, ignore_case)))


def first_match(c, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """First match of a group, null when there is none."""
    hit = F.regexp_extract(col(c), regex(pattern, ignore_case), group)
    return F.when(hit != "", hit)


def n_words(c) -> Column:
    return F.regexp_count(col(c), F.lit(r"\S+"))


def cut(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def between(c, low, high) -> Column:
    return (col(c) >= F.lit(low)) & (col(c) <= F.lit(high))


def year_like(value) -> Column:
    """A value that is probably a year in disguise."""
    return between(value, 1900.0, 2030.0)


def is_true(cond: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(cond, F.lit(False))


def messages(*parts: Column, limit: int | None = None) -> Column:
    """Non-null messages in order."""
    kept = F.array_compact(F.array(*parts))
    return F.slice(kept, 1, limit) if limit else kept


def clamp(c: Column, low, high) -> Column:
    """Into the range; null stays null, which ``least`` and ``greatest`` alone would not keep."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))
