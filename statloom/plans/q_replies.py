"""Text-model requests and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import labels
from statloom.functions import rules as R
from statloom.operators import replies as M
from statloom.plans.oracle import text as lit, with_views, words
from statloom.plans.q_scores import _TOPICAL
from statloom.plans.registry import query

_REPLIES = with_views("replies")


def _fill(template: str, content: str) -> str:
    head, tail = template.split("%s")
    return f"{lit(head)} || {content} || {lit(tail)}"


@query("L01_requests", "doc_id:L topic_request:S plain_request:S", f"""
{_TOPICAL} SELECT doc_id, CASE topic {' '.join(f"WHEN {lit(k)} THEN {_fill(v, 'text')}" for k, v in M.TOPIC_REQUESTS.items() if k != 'general')} ELSE {_fill(M.TOPIC_REQUESTS['general'], 'text')} END AS topic_request,
  {_fill(M.PLAIN_REQUEST, 'text')} AS plain_request FROM tn""")
def _(t):
    notes = t.view("notes").withColumn("topic", labels.topic("text", "source"))
    return notes.select("doc_id", M.topic_request("text", "topic").alias("topic_request"), M.plain_request("text").alias("plain_request"))


@query("L02_page_summaries", "page_id:L summary:S", f"""
{with_views('obs')}, r AS (SELECT page_id, o1, indicator_name || ': ' || value || ' ' || unit || ' (' || coalesce(year::VARCHAR, 'N/A') || ')' AS line, row_number() OVER (PARTITION BY page_id ORDER BY o1) AS rn FROM obs)
SELECT page_id, {lit(M.SUMMARY_HEAD)} || string_agg(line, chr(10) ORDER BY rn) AS summary FROM r WHERE rn <= 10 GROUP BY page_id""")
def _(t):
    return M.page_summaries(t.view("obs"))


@query("L03_reply_json", "reply_id:L parsing_error:B keys:S raw_response:S", f"""
{_REPLIES}, b AS (SELECT reply_id, response, regexp_replace(regexp_replace(regexp_replace(response, '^```json', ''), '^```', ''), '```$', '') AS x FROM replies),
j AS (SELECT *, CASE WHEN regexp_matches(x, '(?s)\\{{.*\\}}') THEN regexp_extract(x, '(?s)\\{{.*\\}}') ELSE x END AS doc FROM b)
SELECT reply_id, doc = '' OR NOT json_valid(doc) AS parsing_error, CASE WHEN doc <> '' AND json_valid(doc) THEN array_to_string(list_sort(json_keys(doc)), ',') END AS keys,
  CASE WHEN doc = '' OR NOT json_valid(doc) THEN response[1:300] END AS raw_response FROM j""")
def _(t):
    parsed = M.parse_replies(t.view("replies"))
    keys = F.array_sort(F.map_keys(F.try_variant_get("parsed", "$", "map<string,variant>")))
    return parsed.withColumn("keys", F.array_join(keys, ","))


@query("L04_normalised_replies", "reply_id:L indicators:S years:S quality:S confidence:D", """
SELECT p_partkey AS reply_id, CASE p_partkey % 6 WHEN 0 THEN 'PIB|inflation|' || p_name WHEN 1 THEN p_brand WHEN 2 THEN 'a|b|c|d|e|f|g|h|i|j' ELSE 'analyse_disponible' END AS indicators,
  CASE p_partkey % 6 WHEN 0 THEN '2024' || CASE WHEN 2010 + p_partkey % 18 BETWEEN 2018 AND 2025 THEN '|' || (2010 + p_partkey % 18) ELSE '' END WHEN 1 THEN '2019' ELSE '2024' END AS years,
  CASE p_partkey % 6 WHEN 0 THEN 'bon' WHEN 4 THEN 'ok' || p_size ELSE 'moyenne' END AS quality,
  CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN (p_size % 10) / 10.0 WHEN 4 THEN 0.0 ELSE 0.5 END AS confidence FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)""")
def _(t):
    n = M.normalise_replies(t.view("replies"))
    return n.select("reply_id", F.array_join("indicators", "|").alias("indicators"),
                    F.array_join(F.transform("years", lambda y: y.cast("string")), "|").alias("years"), "quality", "confidence")


@query("L05_keyword_fallback", "doc_id:L first_indicator:S years:S quality:S confidence:D", f"""
{with_views('notes')}, r AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 3) AS runs FROM notes),
f AS (SELECT *, flatten(list_transform({words(R.FALLBACK_KEYWORDS)}, lambda k: list_filter(runs, lambda x: contains(x, k)))) AS found FROM r),
n AS (SELECT *, len(list_distinct(found)) AS n FROM f)
SELECT doc_id, found[1] AS first_indicator, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(20(?:1[8-9]|2[0-5]))\\b', 1))), '|') AS years,
  CASE WHEN n > 5 THEN 'excellente' WHEN n > 2 THEN 'bonne' ELSE 'faible' END AS quality, least(0.9, n * 0.15) AS confidence FROM n""")
def _(t):
    k = M.keyword_fallback(t.view("notes"))
    return k.select("doc_id", F.get("indicators", F.lit(0)).alias("first_indicator"), F.array_join("years", "|").alias("years"), "quality", "confidence")
