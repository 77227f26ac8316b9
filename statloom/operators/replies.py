"""Batch requests to and replies from a text model. The model call itself is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import all_matches, chain, clamp, col, cut, let
from statloom.functions.text import parse_json, strip

# Request texts per topic; %s stands for the content.
TOPIC_REQUESTS = {
    "monetary_financial": (
        "Analysez ces données monétaires tunisiennes:\n%s\n\nRépondez en JSON:\n"
        '{"indicateurs": ["taux directeur", "inflation"], "confiance": 0.8, "resume": "analyse monétaire"}'
    ),
    "statistical_demographic": (
        "Analysez ces données démographiques tunisiennes:\n%s\n\nRépondez en JSON:\n"
        '{"indicateurs": ["population", "emploi"], "confiance": 0.8, "resume": "analyse démographique"}'
    ),
    "trade_commerce": (
        "Analysez ces données de commerce tunisien:\n%s\n\nRépondez en JSON:\n"
        '{"indicateurs": ["exportations", "importations"], "confiance": 0.8, "resume": "analyse commerciale"}'
    ),
    "general": (
        "Analysez ces données économiques tunisiennes:\n%s\n\n"
        "Identifiez les indicateurs économiques valides et répondez en JSON:\n"
        '{"indicateurs": ["liste"], "confiance": 0.8, "resume": "brève analyse"}'
    ),
}
PLAIN_REQUEST = (
    "Analysez ce contenu économique tunisien et listez les indicateurs trouvés.\n\nContenu à analyser:\n%s\n\n"
    "Répondez avec cette structure simple:\n{\n"
    '  "indicateurs": ["PIB", "inflation", "emploi"],\n  "annees": [2024, 2023, 2022],\n'
    '  "qualite": "bon",\n  "confiance": 0.8\n}\n\nRéponse JSON:'
)
SUMMARY_HEAD = "Données économiques tunisiennes extraites:\n"


def _filled(template: str, content: Column) -> Column:
    head, tail = template.split("%s")
    return F.concat(F.lit(head), content, F.lit(tail))


def topic_request(text, topic, limit: int | None = None) -> Column:
    """Request by topic; the content may be cut to a limit."""
    content = col(text) if limit is None else cut(text, limit)
    special = [(col(topic) == k, _filled(v, content)) for k, v in TOPIC_REQUESTS.items() if k != "general"]
    return chain(special, _filled(TOPIC_REQUESTS["general"], content))


def plain_request(text, limit: int | None = None) -> Column:
    c = col(text)
    if limit is None:
        return _filled(PLAIN_REQUEST, c)
    content = F.when(F.length(c) > limit, F.concat(cut(c, limit), F.lit("\n[...contenu limité...]"))).otherwise(c)
    return _filled(PLAIN_REQUEST, content)


def page_summaries(obs: DataFrame, limit: int = 10) -> DataFrame:
    """First observations of a page as lines of text."""
    first = obs.withColumn("rn", F.row_number().over(W.partitionBy("page_id").orderBy("o1"))).filter(F.col("rn") <= limit)
    line = F.concat(
        "indicator_name", F.lit(": "), F.col("value").cast("string"), F.lit(" "), "unit", F.lit(" ("),
        F.coalesce(F.col("year").cast("string"), F.lit("N/A")), F.lit(")"),
    )
    listed = F.array_sort(F.collect_list(F.struct("rn", line.alias("line"))))
    lines = F.array_join(F.transform(listed, lambda x: x["line"]), "\n")
    return first.groupBy("page_id").agg(F.concat(F.lit(SUMMARY_HEAD), lines).alias("summary"))


def reply_json(response, nested_once: bool = False) -> Column:
    """JSON text of a reply: code fences removed, then the outermost braces if there are any."""
    bare = F.regexp_replace(F.regexp_replace(strip(response), r"^```json", ""), r"^```", "")
    body = F.regexp_replace(bare, r"```$", "")
    braces = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}" if nested_once else r"(?s)\{.*\}"
    return let(body, lambda b: F.coalesce(F.nullif(F.regexp_extract(b, braces, 0), F.lit("")), b))


def parse_replies(replies: DataFrame, response: str = "response") -> DataFrame:
    """Adds the parsed document, or the start of the raw reply with an error flag."""
    parsed = replies.withColumn("parsed", parse_json(reply_json(response)))
    return parsed.withColumns(
        {
            "parsing_error": F.col("parsed").isNull(),
            "raw_response": F.when(F.col("parsed").isNull(), cut(strip(response), 300)),
        }
    )


def _last_entry(entries: Column, words: list[str]) -> Column:
    """Value of the last member whose key contains one of the words."""
    hits = F.filter(entries, lambda e: F.lower(e["key"]).rlike("|".join(words)))
    return F.element_at(F.concat(F.array(F.lit(None).cast("struct<key:string,value:variant>")), hits), -1)["value"]


def normalise_replies(replies: DataFrame, response: str = "response") -> DataFrame:
    """Indicators (at most ten), years of the period, quality and clamped confidence, with defaults,
    for replies that hold a JSON object. Key spelling is free."""
    members = F.map_entries(F.from_json(reply_json(response, nested_once=True), "map<string,variant>"))
    staged = replies.select("*", members.alias("members")).filter("members IS NOT NULL")
    picked = staged.withColumns(
        {
            "i": _last_entry(F.col("members"), ["indicateur", "indicator", "metric"]),
            "y": _last_entry(F.filter("members", lambda e: ~F.lower(e["key"]).rlike("indicateur|indicator|metric")), ["annee", "year", "periode"]),
            "q": _last_entry(F.col("members"), ["qualite", "quality"]),
            "c": _last_entry(F.col("members"), ["confiance", "confidence", "conf"]),
        }
    )
    as_list = F.try_variant_get("i", "$", "array<string>")
    single = F.when(F.schema_of_variant("i") == "STRING", F.array(F.try_variant_get("i", "$", "string")))
    indicators = F.coalesce(F.slice(as_list, 1, 10), single, F.array().cast("array<string>"))
    years = F.filter(
        F.coalesce(F.try_variant_get("y", "$", "array<int>"), F.array().cast("array<int>")),
        lambda v: (v >= R.PERIOD_START) & (v <= R.PERIOD_END),
    )
    return picked.select(
        *replies.columns,
        F.when(F.size(indicators) > 0, indicators).otherwise(F.array(F.lit("analyse_disponible"))).alias("indicators"),
        F.when(F.size(years) > 0, years).otherwise(F.array(F.lit(R.DEFAULT_YEAR))).alias("years"),
        F.coalesce(F.try_variant_get("q", "$", "string"), F.lit("moyenne")).alias("quality"),
        F.coalesce(clamp(F.try_variant_get("c", "$", "double"), 0.0, 1.0), F.lit(0.5)).alias("confidence"),
    )


def keyword_fallback(texts: DataFrame, text: str = "text", keywords=R.FALLBACK_KEYWORDS) -> DataFrame:
    """Phrases around keywords. A phrase is a maximal run of word characters and spaces, so the text
    is split once instead of being searched once per keyword."""
    runs = F.transform(F.split(F.lower(text), r"(?U)[^\w\s]+"), strip)
    staged = texts.select("*", F.filter(runs, lambda r: F.length(r) > 3).alias("runs"))

    def around(keyword: str) -> Column:
        return F.filter("runs", lambda r: F.contains(r, F.lit(keyword)))

    found = staged.withColumn("found", F.array_distinct(F.concat(*[around(k) for k in keywords])))
    n = F.size("found")
    return found.select(
        *texts.columns,
        F.slice("found", 1, 10).alias("indicators"),
        F.array_sort(F.array_distinct(all_matches(text, rf"\b({R.PERIOD_YEAR})\b", 1))).alias("years"),
        F.when(n > 5, "excellente").when(n > 2, "bonne").otherwise("faible").alias("quality"),
        F.least(F.lit(0.9), n * 0.15).alias("confidence"),
    )
