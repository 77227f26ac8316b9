"""Text cleaning, progress fields, parameters and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import clamp, col, cut, messages

_CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def clean_cell(c) -> Column:
    """Drop control characters, then squeeze spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), _CONTROL, ""), r"\s+", " "))


def clean_text(c) -> Column:
    """Squeeze spaces, then drop control characters."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"\s+", " "), _CONTROL, "")


def clean_name(c) -> Column:
    """Indicator name without tags and control characters, at most 100 characters."""
    name = clean_cell(F.regexp_replace(F.trim(col(c)), r"<[^>]+>", ""))
    short = F.when(F.length(name) > 100, F.concat(cut(name, 97), F.lit("..."))).otherwise(name)
    return F.when(F.trim(col(c)) == "", F.lit("Unknown Indicator")).otherwise(short)


def truncate_sentence(c, limit: int = 1000) -> Column:
    """Cut at the last full stop of the final fifth, else hard."""
    text = col(c)
    head = cut(text, limit)
    back = F.instr(F.reverse(head), ".")
    last = F.when(back > 0, limit - back).otherwise(-1)
    cut_at = F.when(last > limit * 0.8, F.substring(head, F.lit(1), (last + 1).cast("int"))).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut_at, F.lit("...")))


def parse_progress(c, default: int) -> Column:
    """``3``, ``3.0`` and ``3/5`` give 3; negative values give 0; anything else the default."""
    head = F.regexp_extract(col(c), r"^([^/]*)", 1)
    number = F.when(
        head.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"), F.trim(head).try_cast("double")
    )
    whole = F.when(number.isNotNull(), F.floor(F.greatest(F.lit(0.0), number)))
    return F.coalesce(whole, F.lit(default)).cast("bigint")


def progress_pair(current, total) -> tuple[Column, Column]:
    """Total is at least one and current at most total."""
    t = F.greatest(F.lit(1), parse_progress(total, 1))
    return F.least(parse_progress(current, 0), t), t


def progress_struct(current: Column, total: Column, digits: int = 1) -> Column:
    return F.struct(
        current.alias("current"),
        total.alias("total"),
        F.round(current / total * 100, digits).alias("percentage"),
        F.concat(current.cast("string"), F.lit("/"), total.cast("string")).alias("display"),
    )


def progress(current, total, digits: int = 1) -> Column:
    return progress_struct(*progress_pair(current, total), digits)


def seconds_between(start, end) -> Column:
    """Seconds with three decimals, zero when a side is missing."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return F.coalesce(F.round(micros / 1000000.0, 3), F.lit(0.0))


def iso_timestamp(c) -> Column:
    """ISO form; the fraction appears only when it is not zero."""
    whole = F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(col(c), "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def parse_json(c) -> Column:
    """Variant of one complete JSON document, null for anything else. The parser stops after the
    first value, so the text is parsed as the only element of an array to notice what follows."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), col(c), F.lit("]")))
    single = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(wrapped, "$[0]", "variant"))


def tolerant_json(c, default: str = "{}") -> Column:
    """Parsed and serialised JSON, the default for text that is not JSON."""
    return F.coalesce(F.to_json(parse_json(c)), F.lit(default))


def bounded_parameters(quality, timeout, priority) -> dict[str, Column]:
    """Request parameters inside their limits, with a warning per adjusted one."""
    q = F.coalesce(col(quality).cast("double"), F.lit(0.1))
    t = F.coalesce(col(timeout), F.lit(60))
    p = F.coalesce(col(priority), F.lit(1))
    # Warning texts.
    return {
        "quality_threshold": F.greatest(clamp(q, 0.0, 1.0), F.lit(0.05)),
        "timeout": clamp(t, 10, 300),
        "priority": clamp(p, 1, 10),
        "warnings": messages(
            F.when((q < 0) | (q > 1), "quality_threshold ajusté entre 0 et 1"),
            F.when((t < 10) | (t > 300), "timeout ajusté entre 10 et 300 secondes"),
            F.when((p < 1) | (p > 10), "priority ajustée entre 1 et 10"),
        ),
    }


def record_size(*columns: str) -> Column:
    """Characters of the record serialised as JSON, nulls included."""
    return F.length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def kept_content(c, minimum: int = R.MIN_CONTENT_CHARS, maximum: int | None = None) -> tuple[Column, Column]:
    """Gate and stored form of fetched content; whole without a maximum."""
    return F.length(strip(c)) > minimum, col(c) if maximum is None else cut(c, maximum)
