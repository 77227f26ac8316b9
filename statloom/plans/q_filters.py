"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import numbers, predicates, urls
from statloom.functions import rules as R
from statloom.operators import filtering
from statloom.plans.oracle import has, starts, with_views
from statloom.plans.q_numbers import _name_year, _text_year
from statloom.plans.q_scores import SCORED_SITES_SQL, scored_sites
from statloom.plans.registry import query

_OBS = with_views("obs")
CLEAN_INDICATOR = (
    f"(length(indicator_name) >= 3 AND NOT {starts('trim(lower(indicator_name))', R.CLEAN_EXCLUDE_PATTERNS)} "
    f"AND {has('lower(indicator_name)', R.CLEAN_VALID_TERMS + R.CLEAN_RELATED_TERMS)})"
)
STRICT_REASON = f"""CASE WHEN length(trim(indicator_name)) < 3 THEN 'short_name' WHEN {starts('trim(lower(indicator_name))', R.STRICT_REJECT_PATTERNS)} THEN 'pattern'
  WHEN NOT {has('lower(indicator_name)', R.STRICT_TERMS)} AND (length(indicator_name) > 150 OR len(string_split(trim(indicator_name), ' ')) > 16 OR NOT {has('lower(indicator_name)', R.STRICT_CONTEXT_TERMS)}) THEN 'no_known_term'
  WHEN value BETWEEN 1900 AND 2030 THEN 'year_like_value' END"""


@query("F01_clean_indicator", "o1:L is_clean:B", f"{_OBS} SELECT o1, {CLEAN_INDICATOR} AS is_clean FROM obs")
def _(t):
    return t.view("obs").select("o1", predicates.is_clean_indicator("indicator_name").alias("is_clean"))


@query("F02_strict_reject", "o1:L reason:S", f"{_OBS} SELECT o1, {STRICT_REASON} AS reason FROM obs")
def _(t):
    return t.view("obs").select("o1", predicates.strict_reject("indicator_name", "value").alias("reason"))


@query("F03_general_indicator", "o1:L is_general:B is_office:B", f"""
{_OBS} SELECT o1, length(indicator_name) >= 3 AND NOT regexp_matches(lower(indicator_name), '{R.GENERAL_EXCLUDE}') AND {has('lower(indicator_name)', R.GENERAL_TERMS)} AS is_general,
  {has('lower(indicator_name)', R.OFFICE_TERMS)} AS is_office FROM obs""")
def _(t):
    return t.view("obs").select("o1", predicates.is_general_indicator("indicator_name").alias("is_general"),
                                predicates.is_office_indicator("indicator_name").alias("is_office"))


@query("F04_plausible", "o1:L plausible:B plausible_big:B", f"""
{_OBS}, v AS (SELECT o1, lower(indicator_name) AS n, value AS a, value * 1e6 - 1e9 AS b FROM obs)
SELECT o1, {', '.join(f"CASE WHEN {x} BETWEEN 1950 AND 2030 AND {has('n', R.YEAR_WORDS)} THEN false WHEN {has('n', R.RATE_WORDS)} THEN {x} BETWEEN -100 AND 1000 WHEN contains(n, 'population') THEN {x} BETWEEN 1000 AND 50000000 WHEN {has('n', R.GDP_WORDS)} THEN {x} >= 0 AND {x} < 1e15 ELSE abs({x}) < 1e12 END AS {y}" for x, y in (('a', 'plausible'), ('b', 'plausible_big')))} FROM v""")
def _(t):
    return t.view("obs").select("o1", numbers.plausible_for_name("value", "indicator_name").alias("plausible"),
                                numbers.plausible_for_name(F.col("value") * 1e6 - 1e9, "indicator_name").alias("plausible_big"))


@query("F05_record_constraint", "o1:L reason:S", f"""
{_OBS}, v AS (SELECT o1, year, CASE WHEN value_text <> 'n/d' THEN value * CASE WHEN o1 % 11 = 0 THEN 1e10 ELSE 1 END END AS x, confidence_score * CASE WHEN o1 % 13 = 0 THEN 3 ELSE 1 END AS c FROM obs)
SELECT o1, CASE WHEN year IS NULL OR year NOT BETWEEN 2018 AND 2025 THEN 'year_outside_period' WHEN x IS NULL THEN 'not_numeric' WHEN x BETWEEN 1900 AND 2030 THEN 'year_like_value'
  WHEN abs(x) > 1e12 THEN 'implausible_value' WHEN c NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END AS reason FROM v""")
def _(t):
    x = F.when(F.col("value_text") != "n/d", F.col("value") * F.when(F.col("o1") % 11 == 0, 1e10).otherwise(1.0))
    c = F.col("confidence_score") * F.when(F.col("o1") % 13 == 0, 3).otherwise(1)
    staged = t.view("obs").select("o1", "year", x.alias("x"), c.alias("c"))
    return staged.select("o1", predicates.record_reject("year", "x", "c").alias("reason"))


PERIOD_OUTCOME = f"""CASE WHEN year IS NULL THEN CASE WHEN {has('source_domain', R.DOMAIN_GOV)} THEN 'government_default_2024' ELSE 'rejected_no_year' END
  WHEN year BETWEEN 2018 AND 2025 THEN 'in_target_period' WHEN year BETWEEN 2010 AND 2030 THEN 'extended_period_accepted'
  WHEN {has('source_domain', R.DOMAIN_GOV)} THEN 'government_permissive_mode' ELSE 'rejected_outside' END"""


@query("F06_period_filter", "o1:L outcome:S kept:B year:I temporal_context:S in_target_period:B", f"""
{_OBS}, v AS (SELECT o1, year AS y, {PERIOD_OUTCOME} AS outcome FROM obs)
SELECT o1, outcome, outcome NOT LIKE 'rejected%' AS kept, CASE WHEN outcome = 'government_default_2024' THEN 2024 ELSE y END AS year,
  CASE WHEN outcome = 'government_default_2024' THEN outcome WHEN outcome NOT LIKE 'rejected%' THEN y || '-' || outcome END AS temporal_context,
  CASE WHEN outcome IN ('in_target_period', 'extended_period_accepted', 'government_permissive_mode') THEN outcome = 'in_target_period' END AS in_target_period FROM v""")
def _(t):
    return filtering.period_filter(t.view("obs"), urls.is_gov_site("source_domain"))


_CNAME = r"trim(regexp_replace(regexp_replace(indicator_name, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"
VALIDATED_SQL = f"""{_OBS}, d AS (SELECT *, {STRICT_REASON} AS pr, coalesce(CASE WHEN year BETWEEN 1900 AND 2030 THEN year END, {_name_year('indicator_name')}, {_text_year('value_text')}, 2024) AS fy, {_CNAME} AS cn FROM obs),
u AS (SELECT *, CASE WHEN unit = '' THEN CASE WHEN {has('lower(cn)', ['taux', 'inflation', 'chomage', '%'])} THEN '%' WHEN {has('lower(cn)', ['pib', 'dette', 'budget'])} THEN CASE WHEN value > 1000 THEN 'MD' ELSE 'MDT' END
  WHEN {has('lower(cn)', ['population'])} THEN 'habitants' ELSE '' END WHEN unit = 'pourcent' THEN '%' WHEN unit = 'millions de dinars' THEN 'MD' ELSE unit END AS cu FROM d),
s AS (SELECT *, least(1, greatest(0, 0.5 + CASE WHEN fy BETWEEN 2018 AND 2025 THEN 0.3 ELSE 0 END + CASE WHEN {has('lower(cn)', R.STRICT_TERMS)} THEN 0.2 ELSE 0 END + CASE WHEN cu <> '' THEN 0.1 ELSE 0 END + 0.1 - CASE WHEN length(value_text) < 10 THEN 0.1 ELSE 0 END)) AS sc FROM u),
checked AS (SELECT *, CASE WHEN pr IS NOT NULL THEN 'rejected_patterns' WHEN fy NOT BETWEEN 2018 AND 2025 THEN 'rejected_outside_period' END AS reject_reason FROM s)"""


@query("F07_strict_validation", "o1:L reject_reason:S final_year:I clean_name:S clean_unit:S strict_confidence:D", f"""
{VALIDATED_SQL} SELECT o1, reject_reason, fy AS final_year, cn AS clean_name, cu AS clean_unit, sc AS strict_confidence FROM checked""")
def _(t):
    return filtering.strict_validation(t.view("obs"))


@query("F08_quick_value", "event_id:L passes:B", """
SELECT event_id, NOT (value * 40 BETWEEN 1990 AND 2030) AND abs(value * 40) <= 1e10 AS passes FROM events""")
def _(t):
    return t.events.select("event_id", numbers.is_quick_value(F.col("value") * 40).alias("passes"))


@query("F09_final_cleanup", "o1:L indicator_name:S", f"""
{_OBS} SELECT o1, indicator_name FROM obs WHERE {CLEAN_INDICATOR} AND abs(value) < 1e10
  AND coalesce(year, TRY_CAST(nullif(regexp_extract(indicator_name, '\\b(20[0-2][0-9])\\b', 1), '') AS INTEGER), 2024) BETWEEN 2015 AND 2027""")
def _(t):
    return filtering.final_cleanup(t.view("obs"))


@query("F10_government_marks", "o1:L government_validated:B bypass_temporal_filter:B government_permissive:B", f"""
{_OBS} SELECT o1, {', '.join(f"{has('source_domain', R.DOMAIN_GOV)} AS {x}" for x in ('government_validated', 'bypass_temporal_filter', 'government_permissive'))} FROM obs""")
def _(t):
    return filtering.mark_government(t.view("obs"))


PERMISSIVE = f"""(length(indicator_name) >= 2 AND NOT {starts('trim(lower(indicator_name))', R.PERMISSIVE_REJECT_PATTERNS)} AND ({has('lower(indicator_name)', R.PERMISSIVE_TERMS)}
  OR (regexp_matches(indicator_name, '[0-9]') AND len(list_filter(string_split(indicator_name, ' '), lambda w: w <> '')) >= 2 AND length(trim(indicator_name)) < 100)))"""


@query("F11_permissive_recovery", "o1:L relevant:B recovered:B", f"""
{_OBS}, n AS (SELECT *, {PERMISSIVE} AND page_id % 10 <> 4 AS relevant FROM obs)
SELECT o1, relevant, NOT any_kept AS recovered FROM (SELECT o1, relevant, bool_or(relevant) OVER (PARTITION BY page_id) AS any_kept FROM n) WHERE relevant OR NOT any_kept""")
def _(t):
    relevant = predicates.is_permissive_indicator("indicator_name") & (F.col("page_id") % 10 != 4)
    return filtering.keep_or_recover(t.view("obs").withColumn("relevant", relevant), ["page_id"], "relevant")


@query("F11_permissive_by_page", "page_id:L kept:L", f"""
{_OBS}, n AS (SELECT *, {PERMISSIVE} AS relevant FROM obs), f AS (SELECT page_id, relevant, bool_or(relevant) OVER (PARTITION BY page_id) AS a FROM n)
SELECT page_id, count(*) AS kept FROM f WHERE relevant OR NOT a GROUP BY page_id""")
def _(t):
    return filtering.permissive_with_recovery(t.view("obs")).groupBy("page_id").agg(F.count("*").alias("kept"))


@query("F12_emergency", "o1:L year:I period_type:S temporal_context:S in_target_period:B acceptance_reason:S", f"""
{_OBS} SELECT o1, 2024 AS year, 'emergency_default' AS period_type, 'emergency-acceptance' AS temporal_context, true AS in_target_period, 'emergency_mode' AS acceptance_reason FROM obs WHERE value_text <> 'n/d'""")
def _(t):
    given = t.view("obs").withColumn("value", F.when(F.col("value_text") != "n/d", F.col("value")))
    return filtering.emergency_acceptance(given)


@query("F13_undated", "o1:L is_valid:B", f"""
{_OBS} SELECT o1, {has('lower(indicator_name)', R.UNDATED_TERMS)} AND value_text <> 'n/d' AND length(indicator_name) >= 3 AS is_valid FROM obs""")
def _(t):
    value = F.when(F.col("value_text") != "n/d", F.col("value"))
    return t.view("obs").select("o1", predicates.is_undated_indicator("indicator_name", value).alias("is_valid"))


@query("F14_valid_content", "page_id:L", f"""
{with_views('obs')}
SELECT doc_id AS page_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 50 OR doc_id IN (SELECT page_id FROM obs)""")
def _(t):
    contents = t.documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    return filtering.with_valid_content(contents, t.view("obs"))


@query("F15_score_threshold", "page_id:L score:D", f"{SCORED_SITES_SQL} SELECT page_id, score FROM scored WHERE score > 0.6")
def _(t):
    return scored_sites(t).filter("score > 0.6")


_ACTIVE = "SELECT row_id, 'active' AS how FROM tasks WHERE status IN ('pending', 'running')"


@query("F16_task_filter", "row_id:L how:S", f"""
{with_views('tasks')} {_ACTIVE} UNION ALL SELECT row_id, 'failed' FROM tasks WHERE status = 'failed'
UNION ALL SELECT row_id, 'one' FROM tasks WHERE task_id = 't10' UNION ALL SELECT row_id, 'since' FROM tasks WHERE created_at >= TIMESTAMP '1999-01-01'""")
def _(t):
    tasks = t.view("tasks")
    parts = {
        "active": filtering.tasks_where(tasks, active=True), "failed": filtering.tasks_where(tasks, status="failed"),
        "one": filtering.tasks_where(tasks, task_id="t10"), "since": filtering.tasks_where(tasks, since="1999-01-01 00:00:00"),
    }
    listed = [df.select("row_id", F.lit(how).alias("how")) for how, df in parts.items()]
    out = listed[0]
    for more in listed[1:]:
        out = out.unionByName(more)
    return out


@query("F18_validation_fallback", "o1:L is_valid:B recovered:B", f"""
{VALIDATED_SQL}, f AS (SELECT o1, o1 % 60 AS g, reject_reason IS NULL AS is_valid FROM checked),
w AS (SELECT *, bool_or(is_valid) OVER (PARTITION BY g) AS any_kept FROM f)
SELECT o1, is_valid, NOT any_kept AS recovered FROM w WHERE is_valid OR NOT any_kept""")
def _(t):
    grouped = t.view("obs").withColumn("page_id", F.col("o1") % 60)
    return filtering.validation_fallback(grouped)
