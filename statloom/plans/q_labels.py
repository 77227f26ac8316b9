"""Categories and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import html, labels, numbers, urls
from statloom.functions import rules as R
from statloom.operators import aggregates
from statloom.plans.oracle import has, labels as case_labels, n_has, page_text, text as lit, with_views
from statloom.plans.registry import query

_OBS = with_views("obs")
_NOTES = with_views("notes")


@query("C01_category", "o1:L category:S",
       f"{_OBS} SELECT o1, {case_labels('lower(indicator_name)', R.CATEGORY_GROUPS, 'OTHER')} AS category FROM obs")
def _(t):
    return t.view("obs").select("o1", labels.category("indicator_name").alias("category"))


@query("C02_category_clean", "o1:L category:S", f"""
{_OBS} SELECT o1, CASE WHEN indicator_name = '' THEN 'UNKNOWN' ELSE {case_labels('lower(indicator_name)', R.CATEGORY_GROUPS_CLEAN, 'ECONOMIC_GENERAL')} END AS category FROM obs""")
def _(t):
    return t.view("obs").select("o1", labels.category_clean("indicator_name").alias("category"))


def target_rows() -> str:
    """Catalogue as SQL rows: category, name, ordinal."""
    rows, i = [], 0
    for group, entries in R.TARGETS.items():
        for entry in entries:
            rows.append(f"({lit(group)}, {lit(entry)}, {i})")
            i += 1
    return ", ".join(rows)


def target_category_sql(names: str) -> str:
    """CTEs ``firsts(n, category)`` for the distinct names selected by ``names``."""
    return f"""cat(category, entry, pos) AS (VALUES {target_rows()}),
probes AS (SELECT category, pos, lower(entry) AS term FROM cat
  UNION ALL SELECT category, pos, unnest(string_split_regex(trim(lower(entry)), '\\s+')[1:2]) FROM cat),
names AS ({names}),
firsts AS (SELECT n, coalesce(
    (SELECT category FROM probes WHERE contains(lower(n), term) ORDER BY pos LIMIT 1),
    {case_labels('lower(n)', R.TARGET_KEYWORDS, 'other')}) AS category FROM names)"""


@query("C03_target_category", "o1:L target_category:S", f"""
{_OBS}, {target_category_sql('SELECT DISTINCT indicator_name AS n FROM obs')}
SELECT o1, category AS target_category FROM obs JOIN firsts ON indicator_name = n""")
def _(t):
    return t.view("obs").select("o1", labels.target_category("indicator_name").alias("target_category"))


def topic_sql(text: str = "text", source: str = "source") -> str:
    """CASE on the best topic score."""
    scores = {
        name: f"({n_has(f'lower({text})', s['keywords'])} * 2 + {n_has(f'lower({source})', s['keywords'])} * 3 + {n_has(f'lower({text})', s['indicators'])})"
        for name, s in R.TOPICS.items()
    }
    best = f"greatest({', '.join(scores.values())})"
    arms = " ".join(f"WHEN {s} = {best} THEN {lit(n)}" for n, s in scores.items())
    return f"CASE WHEN {text} = '' THEN 'empty_content' WHEN {best} = 0 THEN 'general' {arms} END"


@query("C04_topic", "doc_id:L topic:S", f"{_NOTES} SELECT doc_id, {topic_sql()} AS topic FROM notes")
def _(t):
    return t.view("notes").select("doc_id", labels.topic("text", "source").alias("topic"))


def page_class_sql(text: str, url: str) -> str:
    arms = " ".join(f"WHEN {has(f'lower({text})', ts)} THEN {lit(v)}" for ts, v in R.PAGE_CLASSES_TEXT)
    arms += " " + " ".join(f"WHEN {has(f'lower({url})', ts)} THEN {lit(v)}" for ts, v in R.PAGE_CLASSES_URL)
    return f"CASE {arms} ELSE {lit(R.PAGE_CLASS_DEFAULT)} END"


@query("C05_page_class", "page_id:L page_class:S", f"""
{with_views('sites')}, p AS (SELECT page_id, url, {page_text('html')} AS body FROM sites) SELECT page_id, {page_class_sql('body', 'url')} AS page_class FROM p""")
def _(t):
    pages = t.view("sites").select("page_id", "url", html.page_text("html").alias("body"))
    return pages.select("page_id", labels.page_class("body", "url").alias("page_class"))


@query("C06_content_category", "doc_id:L content_category:S", f"""
{_NOTES} SELECT doc_id, CASE WHEN contains(source, 'bct.gov.tn') OR {has('lower(text)', R.CONTENT_ECONOMIC)} THEN 'economic'
  WHEN contains(source, 'ins.tn') OR {has('lower(text)', R.CONTENT_STATISTICAL)} THEN 'statistical'
  WHEN {has('lower(text)', R.CONTENT_INDUSTRIAL)} THEN 'industrial' ELSE 'general' END AS content_category FROM notes""")
def _(t):
    return t.view("notes").select("doc_id", labels.content_category("text", "source").alias("content_category"))


@query("C07_is_target", "o1:L is_target:B", f"{_OBS} SELECT o1, {has('lower(indicator_name)', R.TARGET_TERMS)} AS is_target FROM obs")
def _(t):
    return t.view("obs").select("o1", labels.is_target("indicator_name").alias("is_target"))


@query("C08_content_classification", "page_id:L source_domain:S data_richness:S economic_relevance:S primary_type:S", f"""
{_OBS} SELECT page_id, source_domain, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS data_richness,
  CASE WHEN max(CAST({has('lower(indicator_name)', R.TARGET_TERMS)} AS INT)) = 1 THEN 'high'
    WHEN max(CAST(contains(lower(concat(indicator_name, value_text, unit)), 'tunisi') AS INT)) = 1 THEN 'medium' ELSE 'unknown' END AS economic_relevance,
  CASE WHEN {has('source_domain', ['bct.gov.tn', 'ins.tn', '.gov.'])} THEN 'government_official' WHEN {has('source_domain', ['api.', '.json'])} THEN 'api_data' ELSE 'web_content' END AS primary_type
FROM obs GROUP BY page_id, source_domain""")
def _(t):
    classified = aggregates.content_classification(t.view("obs"), ["page_id", "source_domain"])
    primary = F.coalesce(urls.decisive_type("source_domain"), F.lit("web_content"))
    return classified.withColumn("primary_type", primary)


@query("C09_size_class", "l_orderkey:L l_linenumber:I price_class:S discount_class:S", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 1000 THEN 'large_number' WHEN l_extendedprice < 1 THEN 'decimal' ELSE 'standard' END AS price_class,
  CASE WHEN l_discount * 20 > 1000 THEN 'large_number' WHEN l_discount * 20 < 1 THEN 'decimal' ELSE 'standard' END AS discount_class FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.size_class("l_extendedprice").alias("price_class"),
                             numbers.size_class(F.col("l_discount") * 20).alias("discount_class"))


@query("C10_confidence_class", "o1:L confidence_class:S", f"""
{_OBS} SELECT o1, CASE WHEN confidence_score > 0.7 THEN 'high' WHEN confidence_score > 0.4 THEN 'medium' ELSE 'low' END AS confidence_class FROM obs""")
def _(t):
    return t.view("obs").select("o1", labels.confidence_class("confidence_score").alias("confidence_class"))


@query("C11_levels", "o1:L rate_level:S two_factor:S navigation:S quality:S model:S coverage:S", f"""
{_OBS}, v AS (SELECT o1, confidence_score AS r, (o1 % 101) / 100.0 AS s FROM obs)
SELECT o1, CASE WHEN r > 0.8 THEN 'excellent' WHEN r > 0.6 THEN 'good' ELSE 'needs_improvement' END AS rate_level,
  CASE WHEN r > 0.9 AND s > 0.8 THEN 'excellent' WHEN r > 0.7 AND s > 0.6 THEN 'good' ELSE 'needs_improvement' END AS two_factor,
  CASE WHEN r > 0.8 AND s > 0.6 THEN 'excellent' WHEN r > 0.6 AND s > 0.4 THEN 'good' ELSE 'needs_improvement' END AS navigation,
  CASE WHEN r > 0.8 THEN 'excellent' WHEN r > 0.6 THEN 'good' WHEN r > 0.4 THEN 'acceptable' ELSE 'poor' END AS quality,
  CASE WHEN r > 0.8 THEN 'excellent' WHEN r > 0.6 THEN 'good' WHEN r > 0.3 THEN 'poor' ELSE 'failing' END AS model,
  CASE WHEN r > 0.7 THEN 'excellent' WHEN r > 0.5 THEN 'good' WHEN r > 0.3 THEN 'fair' ELSE 'poor' END AS coverage FROM v""")
def _(t):
    v = t.view("obs").select("o1", F.col("confidence_score").alias("r"), ((F.col("o1") % 101) / 100).alias("s"))
    return v.select(
        "o1", labels.rate_level("r").alias("rate_level"), labels.two_factor_level("r", "s").alias("two_factor"),
        labels.two_factor_level("r", "s", (0.8, 0.6), (0.6, 0.4)).alias("navigation"), labels.quality_level("r").alias("quality"),
        labels.model_level("r").alias("model"), labels.coverage_level("r").alias("coverage"))


_MESSAGE = "concat(CASE o1 % 5 WHEN 0 THEN 'Créer un extracteur pour ' WHEN 1 THEN 'Écrire un parser pour ' WHEN 2 THEN 'Tester le LLM sur ' WHEN 3 THEN 'Revoir le format de ' ELSE 'Suivre ' END, indicator_name)"


@query("C12_priority_bucket", "o1:L bucket:S", f"""
{_OBS}, m AS (SELECT o1, {_MESSAGE} AS msg FROM obs)
SELECT o1, CASE WHEN {has('msg', R.URGENT_WORDS)} THEN 'URGENT' WHEN {has('msg', R.IMPORTANT_WORDS)} THEN 'IMPORTANT' ELSE 'MOYEN TERME' END AS bucket FROM m""")
def _(t):
    return t.view("obs").select("o1", labels.priority_bucket(F.expr(_MESSAGE)).alias("bucket"))


@query("C13_run_outcome", "task_id:S n_values:L n_errors:L gate:S outcome:S is_success:B", f"""
{with_views('results')}, g AS (SELECT task_id, sum(CASE WHEN success AND extraction_count > 20 THEN extraction_count ELSE 0 END) AS n_values, count(*) FILTER (NOT success) AS n_errors FROM results GROUP BY task_id),
o AS (SELECT *, CASE WHEN n_errors > 2 THEN 'error' WHEN n_values = 0 THEN 'empty' ELSE 'validate' END AS gate FROM g)
SELECT task_id, n_values, n_errors, gate, CASE gate WHEN 'validate' THEN 'valid' WHEN 'empty' THEN 'empty' ELSE CASE WHEN n_values > 0 THEN 'partial_recovery' ELSE 'failed' END END AS outcome,
  gate = 'validate' AS is_success FROM o""")
def _(t):
    counted = t.view("results").groupBy("task_id").agg(
        F.sum(F.when(F.col("success") & (F.col("extraction_count") > 20), F.col("extraction_count")).otherwise(0)).alias("n_values"),
        F.count_if(~F.col("success")).alias("n_errors"))
    outcome = labels.run_outcome("n_values", "n_errors")
    return counted.select("*", labels.run_gate("n_values", "n_errors").alias("gate"), outcome.alias("outcome"),
                          (outcome == "valid").alias("is_success"))
