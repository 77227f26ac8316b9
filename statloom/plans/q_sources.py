"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions import urls
from statloom.plans.oracle import text as lit, with_views
from statloom.plans.registry import query
from statloom.session import fresh_dir
from statloom.sources import pages as P
from statloom.sources import payloads as J
from statloom.sources import tasks as T

_HOST = r"lower(regexp_extract(trim({0}), '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1))"


@query("S01_page_scan", "page_id:L n_chars:L html:S", f"""
SELECT page_id, length(html) AS n_chars, html FROM pages
WHERE length(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) > {R.MIN_CONTENT_CHARS}""")
def _(t):
    pages = P.read_pages(t.spark, t.path("pages"))
    return pages.select("page_id", F.length("html").alias("n_chars"), "html")


@query("S02_source_catalogue", "source_group:S ordinal:I url:S n_known:L", f"""
{with_views('urls')}, cat(source_group, ordinal, url) AS (VALUES {', '.join(f"({lit(g)}, {i}, {lit(u)})" for g, us in R.SOURCES.items() for i, u in enumerate(us))}),
seen AS (SELECT {_HOST.format('url')} AS host, count(*) AS n FROM urls GROUP BY 1)
SELECT source_group, ordinal, cat.url, coalesce(n, 0) AS n_known FROM cat LEFT JOIN seen ON host = {_HOST.format('cat.url')}""")
def _(t):
    catalogue = P.source_catalogue(t.spark).withColumn("host", F.lower(urls.authority("url")))
    seen = t.view("urls").groupBy(F.lower(urls.authority("url")).alias("host")).agg(F.count("*").alias("n"))
    return catalogue.join(seen, "host", "left").withColumn("n_known", F.coalesce("n", F.lit(0)))


@query("S03_api_items", "o1:L obs_key:S indicator_name:S value:D unit:S year:I confidence_score:D", """
SELECT o_orderkey AS o1, 'wb_' || (2012 + o_orderkey % 15) || '_0' AS obs_key, 'GDP Tunisia ' || (2012 + o_orderkey % 15) AS indicator_name, floor(o_totalprice) AS value, 'USD' AS unit,
  2012 + o_orderkey % 15 AS year, 0.95 AS confidence_score FROM orders""")
def _(t):
    return J.api_items(t.view("api_json"))


@query("S04_flat_numbers", "event_id:L obs_key:S indicator_name:S value:D raw_text:S", """
SELECT event_id, 'json_k' AS obs_key, 'k' AS indicator_name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value, 'k: ' || CAST(CAST(json_extract(props, '$.k') AS DOUBLE) AS VARCHAR) AS raw_text FROM events""")
def _(t):
    return J.flat_numbers(t.events.select("event_id", F.col("props").alias("content")))


_PATHED = r"""replace(regexp_replace(replace(regexp_replace(fullkey, '^\$\.', ''), '"', ''), '\[([0-9]+)\]', '_\1', 'g'), '.', '_')"""


@query("S05_nested_numbers", "dump_id:L obs_key:S indicator_name:S value:D", f"""
{with_views('dumps')} SELECT dump_id, {_PATHED} AS obs_key, j.key AS indicator_name,
  CASE WHEN j.type = 'BOOLEAN' THEN CASE WHEN CAST(j.atom AS VARCHAR) = 'true' THEN 1 ELSE 0 END ELSE CAST(j.atom AS DOUBLE) END AS value
FROM dumps, json_tree(content) j WHERE j.type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') AND lower(j.key) NOT IN ('id', 'code', 'status') AND NOT regexp_matches(fullkey, '\\]$')""")
def _(t):
    return J.nested_numbers(t.view("dumps"))


@query("S06_dump_observations", "dump_id:L task_id:S url:S obs_key:S method:S o1:I o2:I o3:I indicator_name:S value:D unit:S year:I confidence_score:D", """
SELECT p_partkey AS dump_id, 't' || p_partkey AS task_id, 'https://www.ins.tn/' || p_partkey AS url, 'table_0_1_' || p_size AS obs_key, 'table' AS method, 0 AS o1, 1 AS o2, p_size AS o3,
  p_name AS indicator_name, p_retailprice AS value, '' AS unit, 2021 AS year, 0.8 AS confidence_score FROM part
UNION ALL SELECT p_partkey, 't' || p_partkey, 'https://www.ins.tn/' || p_partkey, 'wb_2020_0', 'wb', 2020, 0, NULL, 'GDP Tunisia 2020', p_size, 'USD', 2020, 0.95 FROM part""")
def _(t):
    return J.dump_observations(t.view("dumps"))


@query("S07_value_maps", "dump_id:L path:S n_values:I", """
SELECT p_partkey AS dump_id, 'results[0].content.structured_data.extracted_values' AS path, 2 AS n_values FROM part UNION ALL SELECT p_partkey, 'meta.extracted_values', 1 FROM part""")
def _(t):
    return J.value_maps(t.view("dumps"))


@query("S08_task_reader", "row_id:L execution_time:D has_rate:B", f"""
{with_views('tasks')} SELECT row_id, CAST(json_extract(metrics, '$.execution_time') AS DOUBLE) AS execution_time, false AS has_rate FROM tasks""")
def _(t):
    decoded = T.decode_tasks(t.view("tasks"))
    return decoded.select("row_id", F.col("metrics.execution_time").alias("execution_time"),
                          F.col("metrics.success_rate").isNotNull().alias("has_rate"))


@query("S09_result_writer", "source_domain:S o1:L indicator_name:S value:D unit:S", f"{with_views('obs')} SELECT source_domain, o1, indicator_name, value, unit FROM obs")
def _(t):
    out = fresh_dir(t.spark, "documents")
    obs = t.view("obs").select("source_domain", "o1", "indicator_name", "value", "unit")
    T.write_documents(obs, out, "source_domain")
    return t.spark.read.schema(obs.schema).json(out)


@query("S10_task_export", "task_id:S status:S created_at:S n_results:I metrics:S first_url:S", f"""
{with_views('tasks', 'results')} SELECT task_id, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, (SELECT count(*) FROM results r WHERE r.task_id = 't10') AS n_results,
  coalesce(metrics, '{{}}') AS metrics, (SELECT url FROM results r WHERE r.task_id = 't10' ORDER BY ordinal, url LIMIT 1) AS first_url FROM tasks WHERE task_id = 't10'""")
def _(t):
    e = T.export_task(t.view("tasks"), t.view("results"), "t10")
    return e.select("task_info.task_id", "task_info.status", "task_info.created_at", F.size("results").alias("n_results"), "metrics",
                    F.get(F.transform("results", lambda r: r["url"]), F.lit(0)).alias("first_url"))


@query("S11_backup", "id:L task_id:S progress_current:S progress_total:S status:S created_at:S", f"""
{with_views('tasks')} SELECT row_id AS id, task_id, progress_current, progress_total, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM tasks""")
def _(t):
    return T.backup_projection(t.view("tasks"))


@query("S12_page_text", "doc_id:L n_chars:L content:S", """
WITH f AS (SELECT conv_id // 4 AS doc_id, conv_id * 100 + turn AS part_no, text, row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id * 100 + turn) AS rn FROM conversations WHERE text <> ''),
j AS (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY rn)[1:20000] AS content FROM f WHERE rn <= 10 GROUP BY doc_id)
SELECT doc_id, length(content) AS n_chars, content FROM j""")
def _(t):
    c = t.conversations
    parts = c.select(F.expr("conv_id div 4").alias("doc_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("part_no"), F.col("text").alias("body"))
    return P.assemble_pages(parts).withColumn("n_chars", F.length("content"))


@query("S12_sheet_text", "doc_id:L n_chars:L content:S", """
WITH r AS (SELECT conv_id // 4 AS doc_id, conv_id, turn, role || ' | ' || text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, dense_rank() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id) AS s FROM conversations),
j AS (SELECT doc_id, string_agg(body || chr(10), '' ORDER BY s, rn)[1:15000] AS content FROM r WHERE rn <= 100 AND s <= 3 GROUP BY doc_id)
SELECT doc_id, length(content) AS n_chars, content FROM j""")
def _(t):
    cells = t.conversations.select(F.expr("conv_id div 4").alias("doc_id"), F.col("conv_id").alias("sheet_no"), F.col("turn").alias("row_no"), F.array("role", "text").alias("cells"))
    return P.assemble_sheets(cells).withColumn("n_chars", F.length("content"))


_KIND = "CASE j.type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE j.type END"


@query("S13_structure_profile", "origin:S key:S kind:S n:L total_length:L", f"""
{with_views('dumps')}, m AS (SELECT 'dumps' AS origin, j.key, {_KIND} AS kind, length(CAST(j.value AS VARCHAR)) AS size FROM dumps, json_each(content) j
  UNION ALL SELECT 'events', j.key, {_KIND}, length(CAST(j.value AS VARCHAR)) FROM events, json_each(props) j)
SELECT origin, key, kind, count(*) AS n, sum(CASE WHEN kind IN ('OBJECT', 'ARRAY') THEN 0 ELSE size END) AS total_length FROM m GROUP BY origin, key, kind""")
def _(t):
    events = J.structure_profile(t.events.select(F.col("props").alias("content"))).withColumn("origin", F.lit("events"))
    profile = J.structure_profile(t.view("dumps")).withColumn("origin", F.lit("dumps")).unionByName(events)
    # Containers serialise with a different spacing and key order in the checking engine.
    return profile.withColumn("total_length", F.when(F.col("kind").isin("OBJECT", "ARRAY"), 0).otherwise(F.col("total_length")))


_MARKERS = ["extracted_values", "task_id", "results", "standard", "advanced", "status"]


@query("S13_markers", "marker:S n:L", f"""
{with_views('dumps')} {' UNION ALL '.join(f"SELECT '{m}' AS marker, count(*) FILTER (contains(content, '{m}')) AS n FROM dumps" for m in _MARKERS)}""")
def _(t):
    return J.marker_presence(t.view("dumps"), _MARKERS)


@query("X20_all_values", "dump_id:L collection:S name:S value:D unit:S category:S confidence:D is_priority:B recognised:S described:S", """
WITH v AS (SELECT p_partkey AS dump_id, 'target_indicators' AS collection, 'Inflation ' || p_brand AS name, p_size + 0.5 AS value, 'pourcentage' AS unit, 'prix_et_inflation' AS category, 0.9 AS confidence, p_partkey % 2 = 0 AS is_priority, NULL AS recognised, NULL AS described FROM part
UNION ALL SELECT p_partkey, 'target_indicators', 'PIB par habitant', p_size * 3, 'md tnd', CASE WHEN p_partkey % 3 = 0 THEN 'autre' ELSE 'comptes_nationaux' END, 0.4, false, 'md', 'millions de dinars' FROM part
UNION ALL SELECT p_partkey, 'key_figures', 'Balance commerciale', p_size * 7, 'USD', 'unknown', 0, false, 'usd', 'dollars américains' FROM part
UNION ALL SELECT p_partkey, 'table_values', 'Epargne nationale', p_size, 'milliers', 'unknown', 0, false, 'milliers', 'milliers' FROM part
UNION ALL SELECT p_partkey, 'table_values', 'Epargne nationale', 2, 'unknown', 'unknown', 0, false, NULL, NULL FROM part) SELECT * FROM v""")
def _(t):
    from statloom.functions import units
    v = J.all_values(t.view("dumps"))
    return v.withColumns({"recognised": units.recognised("unit"), "described": units.recognised_description("unit")})


@query("X21_collection_counts", "dump_id:L target_indicators:I key_figures:I table_values:I extracted_values:I",
       "SELECT p_partkey AS dump_id, 2 AS target_indicators, 1 AS key_figures, 2 AS table_values, 2 AS extracted_values FROM part")
def _(t):
    return J.collection_counts(t.view("dumps"))
