"""Joins, set operations and the crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.operators import crawl as C
from statloom.operators import extraction as X
from statloom.operators import merging as M
from statloom.plans.oracle import has, labels as case_labels, text as lit, with_views
from statloom.plans.q_extraction import _LINK_ROWS
from statloom.plans.registry import query

_OBS = with_views("obs")
_RESULTS = with_views("results")
_CATEGORY = case_labels("lower(indicator_name)", R.CATEGORY_GROUPS, "OTHER")
CATALOGUE = "cat(category, target_name) AS (VALUES " + ", ".join(f"({lit(c)}, {lit(n)})" for c, ns in R.TARGETS.items() for n in ns) + ")"


def _keyed(t):
    return t.view("obs").select("page_id", F.concat(F.lit("k"), (F.col("o1") % 40).cast("string")).alias("obs_key"), "method", "indicator_name", "value", "o1")


@query("J01_merge_methods", "page_id:L obs_key:S o1:L", f"""
{_OBS}, k AS (SELECT page_id, CASE WHEN o1 % 3 = 0 THEN 'clean_' ELSE '' END || 'k' || (o1 % 40) AS obs_key, method, o1 FROM obs), b AS (SELECT * FROM k WHERE method = 'html_table' OR o1 % 3 = 0),
e AS (SELECT page_id, 'clean_k' || (o1 % 40) AS obs_key, o1 FROM obs WHERE method = 'clean_table')
SELECT page_id, obs_key, o1 FROM b UNION ALL SELECT page_id, obs_key, o1 FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page_id = e.page_id AND b.obs_key = e.obs_key)""")
def _(t):
    k = _keyed(t)
    prefix = F.when(F.col("o1") % 3 == 0, "clean_").otherwise("")
    base = k.withColumn("obs_key", F.concat(prefix, "obs_key")).filter((F.col("method") == "html_table") | (F.col("o1") % 3 == 0))
    return M.merge_methods(base, k.filter(F.col("method") == "clean_table"))


@query("J02_overwrite", "page_id:L indicator_name:S method:S value:D", f"""
{_OBS}, a AS (SELECT page_id, indicator_name, method, max(value) AS value, CASE method WHEN 'html_table' THEN 0 WHEN 'clean_table' THEN 1 ELSE 2 END AS w FROM obs WHERE method <> 'json_generic' GROUP BY ALL)
SELECT page_id, indicator_name, method, value FROM a QUALIFY row_number() OVER (PARTITION BY page_id, indicator_name ORDER BY w DESC) = 1""")
def _(t):
    def writer(method):
        rows = t.view("obs").filter(F.col("method") == method)
        return rows.groupBy("page_id", "indicator_name", "method").agg(F.max("value").alias("value"))
    return M.overwrite([writer(m) for m in ("html_table", "clean_table", "pattern_modern")], ["page_id", "indicator_name"])


@query("J03_upsert_tasks", "task_id:S status:S operation:S metadata:S", f"""
{with_views('tasks', 'results')}, old AS (SELECT task_id, status FROM tasks WHERE task_id <> ''), new AS (SELECT task_id, bool_and(success) AS ok FROM results GROUP BY task_id)
SELECT coalesce(o.task_id, n.task_id) AS task_id, CASE WHEN n.task_id IS NULL THEN o.status WHEN n.ok THEN 'completed' ELSE coalesce(o.status, 'completed') END AS status,
  CASE WHEN o.task_id IS NULL THEN 'create' WHEN n.task_id IS NULL THEN 'keep' ELSE 'update' END AS operation,
  CASE WHEN o.task_id IS NULL THEN 'run=2' WHEN n.task_id IS NULL THEN 'origin=table,run=1' ELSE 'origin=table,run=2' END AS metadata FROM old o FULL JOIN new n ON o.task_id = n.task_id""")
def _(t):
    def meta(**kv):
        return F.create_map(*[F.lit(x) for pair in kv.items() for x in pair])
    tasks = t.view("tasks").filter("task_id <> ''").select("task_id", "status", meta(origin="table", run="1").alias("metadata"))
    changes = t.view("results").groupBy("task_id").agg(F.bool_and("success").alias("ok"))
    changes = changes.select("task_id", F.when(F.col("ok"), "completed").alias("status"), meta(run="2").alias("metadata"))
    merged = M.upsert_tasks(tasks, changes)
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return merged.withColumn("metadata", F.array_join(pairs, ","))


@query("J04_coverage", "category:S n_found:L n_targets:I coverage_percentage:D", f"""
{_OBS}, {CATALOGUE}, sizes AS (SELECT category, count(*) AS n_targets FROM cat GROUP BY category),
hits AS (SELECT category, count(DISTINCT o1) AS n_found FROM obs JOIN cat ON contains(lower(indicator_name), lower(target_name)) GROUP BY category)
SELECT category, n_found, n_targets, n_found / n_targets * 100 AS coverage_percentage FROM hits JOIN sizes USING (category)""")
def _(t):
    return M.coverage(t.view("obs"))


@query("J05_missing_categories", "category:S", f"""
{_OBS}, {CATALOGUE} SELECT DISTINCT category FROM cat c WHERE NOT EXISTS (SELECT 1 FROM obs JOIN cat d ON contains(lower(indicator_name), lower(d.target_name)) WHERE d.category = c.category)""")
def _(t):
    return M.missing_categories(t.view("obs"))


@query("J06_recognised_units", "o1:L recognised_unit:S unit_description:S", f"""
{_OBS}, u(pos, k, d) AS (VALUES {', '.join(f"({i}, {lit(k)}, {lit(d)})" for i, (k, d) in enumerate(R.RECOGNIZED_UNITS))})
SELECT o1, k AS recognised_unit, d AS unit_description FROM obs JOIN u ON contains(lower(unit), k) QUALIFY row_number() OVER (PARTITION BY o1 ORDER BY pos) = 1""")
def _(t):
    return M.recognised_units(t.view("obs"))


@query("J07_first_available", "task_id:S provenance:S n_values:L", f"""
{_RESULTS}, r AS (SELECT task_id, sum(extraction_count) FILTER (success AND strategy_used = 'traditional') AS p, sum(extraction_count) FILTER (success AND strategy_used = 'intelligent') AS a, sum(extraction_count) FILTER (NOT success) AS e FROM results GROUP BY task_id)
SELECT task_id, CASE WHEN p IS NOT NULL THEN 'primary' WHEN a IS NOT NULL THEN 'alternative' ELSE 'emergency' END AS provenance, coalesce(p, a, e) AS n_values FROM r""")
def _(t):
    r = t.view("results")
    def route(cond):
        return r.filter(cond).groupBy("task_id").agg(F.sum("extraction_count").alias("n_values"))
    ok = F.col("success")
    return M.first_available(route(ok & (F.col("strategy_used") == "traditional")), route(ok & (F.col("strategy_used") == "intelligent")), route(~ok), "task_id", ["n_values"])


@query("J08_compare_runs", "task_id:S base_values:L other_values:L difference:L percentage:D verdict:S", f"""
{_RESULTS}, g AS (SELECT task_id, coalesce(sum(extraction_count) FILTER (strategy_used = 'traditional'), 0) AS a, coalesce(sum(extraction_count) FILTER (strategy_used = 'intelligent'), 0) AS b FROM results GROUP BY task_id)
SELECT task_id, a AS base_values, b AS other_values, b - a AS difference, CASE WHEN b > a THEN (b - a) / greatest(a, 1) * 100 ELSE 0 END AS percentage, CASE WHEN b > a THEN 'improved' WHEN a = b THEN 'identical' ELSE 'worse' END AS verdict FROM g""")
def _(t):
    r = t.view("results")
    return M.compare_runs(r.filter("strategy_used = 'traditional'"), r.filter("strategy_used = 'intelligent'"), "task_id", "extraction_count")


@query("J09_crawl", "site:S url:S depth:I", f"""
WITH RECURSIVE {_LINK_ROWS},
good AS (SELECT DISTINCT root || '/n/' || k AS src, root, link FROM links WHERE href IN ('/n/', 'http', 'rel')),
ranked AS (SELECT src, link FROM good QUALIFY row_number() OVER (PARTITION BY src ORDER BY CASE WHEN {has('link', R.LINK_PRIORITY)} THEN 0 ELSE 1 END, link) <= 5),
starts AS (SELECT 'https://s' || (p_partkey % 40) || '.example.org' AS site, 'https://s' || (p_partkey % 40) || '.example.org/n/' || p_partkey AS url FROM part WHERE p_partkey < 40),
l1 AS (SELECT DISTINCT s.site, r.link AS url FROM starts s JOIN ranked r ON r.src = s.url WHERE r.link NOT IN (SELECT url FROM starts)),
l2 AS (SELECT DISTINCT s.site, r.link AS url FROM l1 s JOIN ranked r ON r.src = s.url WHERE r.link NOT IN (SELECT url FROM starts UNION ALL SELECT url FROM l1))
SELECT site, url, 0 AS depth FROM starts UNION ALL SELECT site, url, 1 FROM l1 UNION ALL SELECT site, url, 2 FROM l2""")
def _(t):
    pages = t.view("link_pages")
    links = X.crawl_links(pages).select(F.col("url").alias("src_url"), "dst_url")
    site = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    firsts = pages.select(site.alias("site"), "url", "page_id").groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    return C.crawl(links, firsts)


@query("J10_enriched_observations", "o1:L normalized_url:S is_government:B content_type:S task_id:S task_status:S task_created_at:S", f"""
{with_views('obs', 'tasks')}, pg AS (SELECT page_id, url, 't' || (page_id * 7 + 1) AS task_id FROM pages),
tk AS (SELECT task_id, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM tasks WHERE task_id <> '')
SELECT o1, split_part(split_part(trim(url), '#', 1), '?', 1) AS normalized_url, CASE WHEN url IS NOT NULL THEN {has("lower(split_part(url, '/', 3))", ['.gov.', '.gouv.'])} END AS is_government,
  CASE WHEN url IS NOT NULL THEN CASE WHEN {has('lower(url)', R.URL_API)} THEN 'api_data' ELSE 'web_page' END END AS content_type, pg.task_id, status AS task_status, created AS task_created_at
FROM obs LEFT JOIN pg USING (page_id) LEFT JOIN tk ON tk.task_id = pg.task_id""")
def _(t):
    pages = t.pages.withColumn("task_id", F.concat(F.lit("t"), (F.col("page_id") * 7 + 1).cast("string")))
    return M.enrich_observations(t.view("obs"), pages, t.view("tasks").filter("task_id <> ''"))


@query("D01_union_methods", "page_id:L obs_key:S method:S value:D", """
SELECT p_partkey AS page_id, 'table_0_1_0' AS obs_key, 'html_table' AS method, p_size + 0.5 AS value FROM part
UNION ALL SELECT p_partkey, 'list_0_0', 'clean_list', CAST((p_size % 9) || '.' || (p_size % 10) AS DOUBLE) FROM part UNION ALL SELECT p_partkey, 'list_0_1', 'clean_list', p_size FROM part
UNION ALL SELECT p_partkey, 'table_0_0', 'table_extraction', 2016 + p_size % 12 FROM part UNION ALL SELECT p_partkey, 'table_0_1', 'table_extraction', p_size + 0.5 FROM part UNION ALL SELECT p_partkey, 'table_0_2', 'table_extraction', 1 FROM part""")
def _(t):
    pages = t.view("html")
    return M.union_all([X.adjacent_pairs(pages), X.list_items(pages), X.first_two_cells(pages)])


@query("D02_category_difference", "category:S", f"""
{_OBS}, {CATALOGUE} SELECT DISTINCT category FROM cat EXCEPT SELECT category FROM obs JOIN cat ON contains(lower(indicator_name), lower(target_name))""")
def _(t):
    found = M.target_hits(t.view("obs").select("indicator_name")).select("category")
    return M.targets_table(t.spark).select("category").subtract(found)


@query("D03_distinct", "kind:S item:S", f"""
{_OBS} SELECT DISTINCT 'unit' AS kind, unit AS item FROM obs UNION ALL SELECT DISTINCT 'year', year::VARCHAR FROM obs
UNION ALL SELECT DISTINCT 'link', 'https://s' || (p_partkey % 40) || '.example.org/statistique/' || p_size FROM part""")
def _(t):
    obs = t.view("obs")
    links = X.page_links(t.view("link_pages")).filter(F.contains("link", F.lit("/statistique/")))
    parts = [
        obs.select(F.lit("unit").alias("kind"), F.col("unit").alias("item")),
        obs.select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("item")),
        links.select(F.lit("link").alias("kind"), F.col("link").alias("item")),
    ]
    return M.union_all(parts).distinct()


@query("D04_category_union", "category:S", f"""
{_OBS} SELECT {_CATEGORY} AS category FROM obs WHERE method = 'html_table' UNION SELECT {_CATEGORY} FROM obs WHERE method = 'clean_table'""")
def _(t):
    obs = M.with_category(t.view("obs"))
    return M.category_union(obs.filter("method = 'html_table'"), obs.filter("method = 'clean_table'"))


@query("D05_category_intersection", "category:S", f"""
{_OBS}, {CATALOGUE} SELECT DISTINCT category FROM cat INTERSECT SELECT category FROM obs JOIN cat ON contains(lower(indicator_name), lower(target_name))""")
def _(t):
    found = M.target_hits(t.view("obs").select("indicator_name")).select("category")
    return M.targets_table(t.spark).select("category").intersect(found)
