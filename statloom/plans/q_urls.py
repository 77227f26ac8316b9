"""URL projections and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions import scores, urls
from statloom.plans.oracle import has, labels, national_context, text, with_views
from statloom.plans.registry import query

_HOST = r"regexp_extract(trim(url), '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1)"
_DOMAIN = f"coalesce(nullif({_HOST}, ''), 'unknown_domain')"
_TYPE = (
    f"CASE WHEN {has('lower(url)', R.URL_API)} THEN 'api' "
    f"WHEN {has(f'lower({_DOMAIN})', R.DOMAIN_NATIONAL)} THEN 'government_tunisian' "
    r"WHEN regexp_matches(lower(url), '\.(pdf|xlsx|xls|doc|docx)$') THEN 'document' "
    f"WHEN {has(f'lower({_DOMAIN})', R.DOMAIN_COMMERCIAL)} THEN 'commercial' ELSE 'general_web' END"
)
_URLS = with_views("urls")


@query("U01_valid_url", "url_id:L is_valid:B is_present:B is_requestable:B", f"""
{_URLS} SELECT url_id, regexp_matches(trim(url), '^https?://') AND {_HOST} <> '' AS is_valid,
  trim(url) <> '' AS is_present,
  trim(url) LIKE 'http://%' OR trim(url) LIKE 'https://%' AS is_requestable
FROM urls""")
def _(t):
    u = t.view("urls")
    return u.select("url_id", urls.is_valid("url").alias("is_valid"), urls.is_present("url").alias("is_present"),
                    urls.is_requestable("url").alias("is_requestable"))


@query("U02_domain", "url_id:L domain:S domain_lower:S",
       f"{_URLS} SELECT url_id, {_DOMAIN} AS domain, lower({_DOMAIN}) AS domain_lower FROM urls")
def _(t):
    return t.view("urls").select("url_id", urls.domain("url").alias("domain"),
                                 urls.domain("url", lower=True).alias("domain_lower"))


@query("U03_normalise", "url_id:L normalised:S",
       f"{_URLS} SELECT url_id, split_part(split_part(trim(url), '#', 1), '?', 1) AS normalised FROM urls")
def _(t):
    return t.view("urls").select("url_id", urls.normalise("url").alias("normalised"))


@query("U04_url_type", "url_id:L url_type:S", f"{_URLS} SELECT url_id, {_TYPE} AS url_type FROM urls")
def _(t):
    return t.view("urls").select("url_id", urls.url_type("url").alias("url_type"))


@query("U05_site_type", "url_id:L site_type:S",
       f"{_URLS} SELECT url_id, {labels('lower(url)', [([k], v) for k, v in R.SITE_TYPES], 'complex_site')} AS site_type FROM urls")
def _(t):
    return t.view("urls").select("url_id", urls.site_type("url").alias("site_type"))


@query("U06_source_analysis", "url_id:L domain:S is_government:B is_trusted:B content_type:S language:S", f"""
{_URLS} SELECT url_id, {_DOMAIN} AS domain, {has(f'lower({_DOMAIN})', ['.gov.', '.gouv.'])} AS is_government,
  {has(f'lower({_DOMAIN})', R.DOMAIN_NATIONAL + R.DOMAIN_INTERNATIONAL)} AS is_trusted,
  CASE WHEN {_TYPE} = 'api' THEN 'api_data' ELSE 'web_page' END AS content_type,
  {labels(f'lower({_DOMAIN})', [(R.DOMAIN_NATIONAL, 'french_arabic'), (R.DOMAIN_INTERNATIONAL, 'english')], 'mixed')} AS language
FROM urls""")
def _(t):
    parts = urls.source_analysis("url")
    return t.view("urls").select("url_id", *[c.alias(n) for n, c in parts.items()])


@query("U07_primary_type", "row_id:L primary_type:S", f"""
{with_views('task_urls')}, kinds AS (
  SELECT row_id, ordinal, CASE WHEN {has('lower(url)', ['bct.gov.tn', 'ins.tn', '.gov.'])} THEN 'government_official'
    WHEN {has('lower(url)', ['api.', '.json'])} THEN 'api_data' ELSE 'web_content' END AS kind
  FROM task_urls WHERE url <> '')
SELECT row_id, coalesce(
    (SELECT kind FROM kinds k WHERE k.row_id = t.row_id AND kind <> 'web_content' ORDER BY ordinal LIMIT 1),
    (SELECT max(kind) FROM kinds k WHERE k.row_id = t.row_id), 'unknown') AS primary_type
FROM (SELECT DISTINCT row_id FROM task_urls) t""")
def _(t):
    kind = urls.decisive_type("url")
    return t.view("task_urls").groupBy("row_id").agg(
        F.coalesce(
            F.min_by(kind, F.when(kind.isNotNull() & (F.col("url") != ""), F.col("ordinal"))),
            F.max(F.when(urls.is_present("url"), "web_content")),
            F.lit("unknown"),
        ).alias("primary_type")
    )


_STRENGTH_SQL = national_context("html")


@query("U08_route", "page_id:L route_type:S route_confidence:D route_reason:S route_fallback:S route_domain:S route_graph:S route_agent:S", f"""
{with_views('sites')}, p AS (SELECT page_id, url, {_TYPE} AS kind, {_STRENGTH_SQL['is_national']} AS nat, {_STRENGTH_SQL['richness']} AS rich FROM sites),
r AS (SELECT *, CASE WHEN kind = 'api' THEN 1 WHEN kind = 'government_tunisian' THEN 2 WHEN kind = 'document' THEN 3
    WHEN nat THEN 4 WHEN rich = 'high' THEN 5 ELSE 6 END AS rule FROM p)
SELECT page_id, CASE WHEN rule IN (2, 3, 4) THEN 'intelligent' ELSE 'traditional' END AS route_type,
  [0.9, 0.95, 0.8, 0.8, 0.7, 0.6][rule] AS route_confidence,
  ['API détectée - méthode traditionnelle optimale', 'Site gouvernemental tunisien - méthode intelligente nécessaire',
   'Document détecté - extraction spécialisée requise', 'Contenu tunisien détecté - optimisation contextuelle',
   'Données structurées détectées - méthode traditionnelle efficace', 'Stratégie par défaut optimisée'][rule] AS route_reason,
  CASE WHEN rule IN (2, 3, 4) THEN 'traditional' ELSE 'intelligent' END AS route_fallback,
  CASE WHEN {has('lower(url)', R.ROUTE_COORD_API)} THEN 'traditional' WHEN {has(f'lower({_HOST})', R.DOMAIN_GOV)}
    OR {has('lower(url)', R.ROUTE_COORD_DYNAMIC)} THEN 'intelligent' ELSE 'traditional' END AS route_domain,
  CASE WHEN {has('lower(url)', R.ROUTE_GRAPH_API)} THEN 'traditional' ELSE 'intelligent' END AS route_graph,
  CASE WHEN {has('lower(url)', R.ROUTE_AGENT_API)} THEN 'traditional' ELSE 'intelligent' END AS route_agent
FROM r""")
def _(t):
    pages = t.view("sites").withColumns(scores.national_context("html"))
    parts = urls.route_by_type("url", F.col("is_national"), F.col("richness"))
    return pages.select(
        "page_id", parts["route"].alias("route_type"), *[parts[n].alias(n) for n in ("route_confidence", "route_reason", "route_fallback")],
        urls.route_by_domain("url").alias("route_domain"), urls.route_by_graph("url").alias("route_graph"),
        urls.route_by_agent("url").alias("route_agent"),
    )


@query("U09_needs_model", "page_id:L by_url:B by_page:B", f"""
{with_views('sites')} SELECT page_id, {has('lower(url)', R.MODEL_URL_ON)} AS by_url,
  {_STRENGTH_SQL['strength']} IN ('high', 'medium') OR len(regexp_extract_all(html, '<li>')) < 5 OR {has('lower(url)', R.MODEL_URL_COMPLEX)} AS by_page
FROM sites""")
def _(t):
    pages = t.view("sites").withColumns(scores.national_context("html"))
    n_values = F.regexp_count("html", F.lit("<li>"))
    return pages.select("page_id", urls.needs_model_by_url("url").alias("by_url"),
                        urls.needs_model_by_page("url", "strength", n_values).alias("by_page"))


@query("U10_domain_policy", "url_id:L time_limit:I policy_source:S", f"""
{_URLS}, policy(pos, pattern, secs) AS (VALUES {", ".join(f"({i}, {text(p)}, {v})" for i, (p, v) in enumerate(R.DOMAIN_POLICY))}),
ranked AS (SELECT u.url_id, secs, row_number() OVER (PARTITION BY u.url_id ORDER BY CASE WHEN lower({_HOST}) = pattern THEN 0 ELSE 1 END, pos) AS rn
  FROM urls u LEFT JOIN policy ON contains(lower({_HOST}), pattern))
SELECT url_id, coalesce(secs, {R.DOMAIN_POLICY_DEFAULT}) AS time_limit,
  CASE WHEN (SELECT count(*) FROM policy WHERE pattern = lower({_HOST})) > 0 THEN 'domain_specific' ELSE 'pattern_match' END AS policy_source
FROM ranked JOIN urls USING (url_id) WHERE rn = 1""")
def _(t):
    host = F.lower(urls.authority("url"))
    return t.view("urls").select("url_id", urls.domain_policy(host).alias("time_limit"),
                                 urls.domain_policy_source(host).alias("policy_source"))


@query("U11_gov_site", "url_id:L is_gov:B", f"{_URLS} SELECT url_id, {has('lower(url)', R.DOMAIN_GOV)} AS is_gov FROM urls")
def _(t):
    return t.view("urls").select("url_id", urls.is_gov_site("url").alias("is_gov"))


@query("U12_redact", "url_id:L redacted:S",
       rf"{_URLS} SELECT url_id, regexp_replace(url, '://([^:]+):([^@]+)@', '://\1:***@', 'g') AS redacted FROM urls")
def _(t):
    return t.view("urls").select("url_id", urls.redact("url").alias("redacted"))
