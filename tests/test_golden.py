"""Golden rows of text, number, URL and predicate functions."""

import pytest
from pyspark.sql import functions as F

from statloom.functions import labels, numbers, predicates, scores, text, units, urls, years


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def s(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    "raw,value",
    [("12,5 %", 12.5), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1 234,5", 1234.5), ("1 234,5", 1234.5),
     ("n/d", None), ("-", None), ("5-3", None), ("1.234.567", None), ("12\n34", None), ("1,2,3", None), ("-7.5", -7.5)],
)
def test_parse_european(spark, raw, value):
    assert one(spark, numbers.parse_european(s(raw))) == value


@pytest.mark.parametrize("raw,value", [("2023", None), ("2000000000000", None), ("+5", 5.0), ("+-5", None), ("12,5", 12.5)])
def test_parse_clean(spark, raw, value):
    assert one(spark, numbers.parse_clean(s(raw))) == value


@pytest.mark.parametrize(
    "raw,value",
    [("3/5", None), ("1200/7", None), ("9/3", 3.0), ("10/20", 0.5), ("4/0", None), ("12.5%", 12.5), ("12,5%", None),
     ("www.x.org 5", None), ("1.234,5", 1234.5), ("1 234", 1234.0), ("", None), ("x" * 51, None), ("12d", 12.0)],
)
def test_parse_table_value(spark, raw, value):
    assert one(spark, numbers.parse_table_value(s(raw))) == value


def test_parse_or_zero(spark):
    assert one(spark, numbers.parse_or_zero(s("n/d"))) == 0.0


@pytest.mark.parametrize("raw,name", [("<b>Budget</b>", "Budget"), ("  a\t b  ", "a b"), ("", "Unknown Indicator")])
def test_clean_name(spark, raw, name):
    # a tab is a control character and is dropped before spaces are squeezed
    assert one(spark, text.clean_name(s(raw))) == name
    assert one(spark, text.clean_name(text.clean_name(s(raw)))) == name


def test_clean_name_is_cut(spark):
    assert len(one(spark, text.clean_name(s("y" * 150)))) == 100


@pytest.mark.parametrize("name,year", [("GDP Tunisia 2016", 2016), ("GDP 2023 rev 2016", 2023), ("PIB", None), ("x 1850", None)])
def test_year_from_name(spark, name, year):
    assert one(spark, years.from_name(s(name))) == year


def test_most_frequent_year_takes_the_first_on_a_tie(spark):
    assert one(spark, years.from_text(s("a 2021 b 2019 c 2019 d 2021"))) == 2021


@pytest.mark.parametrize(
    "current,total,want",
    [("3/5", "5", (3, 5, 60.0, "3/5")), ("4", "0", (1, 1, 100.0, "1/1")), ("bad", None, (0, 1, 0.0, "0/1")), ("-1", "3", (0, 3, 0.0, "0/3"))],
)
def test_progress(spark, current, total, want):
    assert tuple(one(spark, text.progress(s(current), s(total)))) == want


@pytest.mark.parametrize(
    "url,kind",
    [("https://api.worldbank.org/v2?format=json", "api"), ("https://www.bct.gov.tn/x.pdf", "government_tunisian"), ("https://x.org/a.PDF", "document")],
)
def test_url_type(spark, url, kind):
    assert one(spark, urls.url_type(s(url))) == kind


def test_normalise_url_keeps_parameters_of_the_path(spark):
    once = urls.normalise(s("https://www.ins.tn/a;p?x=1#f"))
    assert one(spark, once) == "https://www.ins.tn/a;p"
    assert one(spark, urls.normalise(once)) == "https://www.ins.tn/a;p"


@pytest.mark.parametrize(
    "href,want",
    [("/a", "https://h.org/a"), ("b", "https://h.org/x/b"), ("?q=1", "https://h.org/x/y?q=1"), ("#t", "https://h.org/x/y?z=1#t"),
     ("//o.net/c", "https://o.net/c"), ("http://p.q/r", "http://p.q/r"), ("", "https://h.org/x/y?z=1")],
)
def test_resolve(spark, href, want):
    assert one(spark, urls.resolve(s(href), s("https://h.org/x/y?z=1#f"))) == want


@pytest.mark.parametrize(
    "name,value,rejected",
    [("Tableau", None, True), ("x", None, True), ("Source: note", None, True), ("<b>Budget</b>", None, True),
     ("Population totale", 11.8, False), ("Inflation", 2023.0, True)],
)
def test_strict_reject(spark, name, value, rejected):
    reason = one(spark, predicates.strict_reject(s(name), F.lit(value).cast("double")))
    assert (reason is not None) == rejected


def test_period_outcomes(spark):
    def outcome(year, gov):
        return one(spark, predicates.period_outcome(F.lit(year).cast("int"), F.lit(gov)))

    assert outcome(None, True) == "government_default_2024"
    assert outcome(2012, False) == "extended_period_accepted"
    assert outcome(1999, False) == "rejected_outside"
    assert outcome(1999, True) == "government_permissive_mode"
    assert outcome(None, False) == "rejected_no_year"


def test_scores(spark):
    full = scores.observation_confidence(s("Inflation"), F.lit(5.0), s("%"), F.lit(2023))
    assert one(spark, full) == 1.0
    assert one(spark, scores.semantic_quality(s("Taux directeur"), F.lit(7.0), s("%"))) == pytest.approx(1.0)


def test_category_and_units(spark):
    assert one(spark, labels.category(s("GDP (current US$) Tunisia 2024"))) == "FISCAL"
    assert one(spark, units.describe(s("habitants"))) == "habitants"
    assert one(spark, units.describe(s("md"))) == "Millions de Dinars"


@pytest.mark.parametrize("raw,want", [('{"a": 1}', '{"a":1}'), ('"k": 69}', "{}"), ("", "{}"), ("1,2", "{}"), ("[1, 2]", "[1,2]"), ('{"a":1} }', "{}")])
def test_tolerant_json(spark, raw, want):
    assert one(spark, text.tolerant_json(s(raw))) == want
