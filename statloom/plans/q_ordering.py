"""Sort, limit and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import html
from statloom.functions import rules as R
from statloom.operators import ordering as O
from statloom.plans.oracle import has, rx, with_views
from statloom.plans.q_scores import SCORED_SITES_SQL, scored_sites
from statloom.plans.registry import query

_TASKS = with_views("tasks")


@query("O01_newest_tasks", "row_id:L task_id:S status:S", f"""
{_TASKS} SELECT row_id, task_id, status FROM tasks WHERE status = 'running' ORDER BY created_at DESC, row_id LIMIT 50 OFFSET 20""")
def _(t):
    return O.newest_tasks(t.view("tasks"), 50, 20, "running")


@query("O02_richest_pages", "page_id:L score:D", f"{SCORED_SITES_SQL} SELECT page_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, page_id LIMIT 20")
def _(t):
    return O.richest_pages(scored_sites(t).select("page_id", F.round("score", 6).alias("score")))


@query("O03_top_counts", "event_type:S n:L", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def _(t):
    return O.most_frequent(t.events, "event_type", 3)


@query("O04_priority_links", "page_id:L position:I link:S", f"""
WITH l AS (SELECT page_id, unnest(h) AS link, unnest(range(len(h))) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<a [^>]*?href="([^"]*)"', 1) AS h
  FROM pages UNION ALL SELECT 1000000000 + p_partkey, ['/x/' || p_partkey, '/statistique/' || p_size, '/a', '/rapport/' || p_brand] FROM part))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN {has('lower(link)', R.LINK_PRIORITY)} THEN 0 ELSE 1 END, i) - 1 AS position, link FROM l""")
def _(t):
    rendered = t.part.select((F.lit(1000000000) + F.col("p_partkey")).alias("page_id"), F.array(
        F.concat(F.lit("/x/"), F.col("p_partkey").cast("string")), F.concat(F.lit("/statistique/"), F.col("p_size").cast("string")),
        F.lit("/a"), F.concat(F.lit("/rapport/"), "p_brand")).alias("links"))
    listed = t.wide("pages").select("page_id", html.links("html").alias("links")).unionByName(rendered)
    return O.prioritised_links(listed, F.col("links"))


@query("O05_limited_urls", "row_id:L n_kept:L is_limited:B first_url:S last_url:S", f"""
{_TASKS} SELECT row_id, least(n_urls, 10) AS n_kept, n_urls > 10 AS is_limited, CASE WHEN n_urls > 0 THEN url || '#1' END AS first_url, CASE WHEN n_urls > 0 THEN url || '#' || least(n_urls, 10) END AS last_url FROM tasks""")
def _(t):
    numbered = F.transform(F.sequence(F.lit(1), F.greatest("n_urls", F.lit(1))), lambda i: F.concat("url", F.lit("#"), i.cast("string")))
    listed = F.when(F.col("n_urls") > 0, numbered).otherwise(F.array().cast("array<string>"))
    kept = t.view("tasks").select("row_id", listed.alias("urls")).withColumns(O.limited_urls("urls"))
    return kept.select("row_id", F.size("kept_urls").alias("n_kept"), "is_limited", F.get("kept_urls", F.lit(0)).alias("first_url"),
                       F.get("kept_urls", F.size("kept_urls") - 1).alias("last_url"))


@query("O06_distinct_limit", "doc_id:L numbers:S", f"""
{with_views('notes')} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {rx(R.INVENTORY_NUMBER)})))[1:20], '|') AS numbers FROM notes""")
def _(t):
    from statloom.functions.common import all_matches
    return t.view("notes").select("doc_id", F.array_join(O.distinct_then_limit(all_matches("text", R.INVENTORY_NUMBER)), "|").alias("numbers"))
