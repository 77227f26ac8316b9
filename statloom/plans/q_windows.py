"""Windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import urls
from statloom.operators import filtering
from statloom.operators import windows as W
from statloom.plans.oracle import with_views
from statloom.plans.q_filters import PERMISSIVE
from statloom.plans.q_scores import SCORED_SITES_SQL, scored_sites
from statloom.plans.registry import query

_OBS = with_views("obs")
_RESULTS = with_views("results")


@query("W01_cap_per_group", "page_id:L method:S o1:L rank:I", f"""
{_OBS} SELECT page_id, method, o1, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id, method ORDER BY o1) AS rn FROM obs) WHERE rn <= 5""")
def _(t):
    return W.first_k(t.view("obs"), ["page_id", "method"], ["o1"], 5)


@query("W02_positional_keys", "page_id:L obs_key:S link:S", """
SELECT page_id, 'link_' || i AS obs_key, href AS link FROM (SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS i FROM (SELECT page_id,
  regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<a [^>]*?href="([^"]*)"', 1) AS h FROM pages))""")
def _(t):
    from statloom.functions import html
    from statloom.functions.common import each
    rows = each(t.wide("pages"), ("page_id",), html.links("html"), "link", "i")
    return rows.select("page_id", F.concat_ws("_", F.lit("link"), F.col("i").cast("string")).alias("obs_key"), "link")


@query("W03_running_means", "event_id:L user_id:L running_mean:E running_ok_mean:E", """
SELECT event_id, user_id, avg(value) OVER w AS running_mean, coalesce(avg(CASE WHEN event_type <> 'error' THEN value END) OVER w, 0) AS running_ok_mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    ok = F.col("event_type") != "error"
    return W.running_means(t.events, ["user_id"], "ts", "event_id", "value", ok)


@query("W03_recurrent_mean", "event_id:L user_id:L recurrent_mean:E", """
WITH RECURSIVE e AS (SELECT event_id, user_id, value, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, CASE WHEN ok THEN value ELSE 0.0 END AS m FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.ok THEN (r.m * (e.n - 1) + e.value) / e.n ELSE r.m END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, user_id, m AS recurrent_mean FROM r""")
def _(t):
    return W.recurrent_mean(t.events, ["user_id"], "ts", "event_id", "value", F.col("event_type") != "error")


@query("W04_best_route", "task_id:S strategy_used:S n_values:L", f"""
{_RESULTS}, g AS (SELECT task_id, strategy_used, sum(extraction_count) AS n_values, min(ordinal) AS first FROM results GROUP BY ALL)
SELECT task_id, strategy_used, n_values FROM g QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n_values DESC, first, strategy_used DESC) = 1""")
def _(t):
    tie = F.when(F.col("strategy_used") == "traditional", 0).otherwise(1)
    g = t.view("results").groupBy("task_id", "strategy_used").agg(F.sum("extraction_count").alias("n_values"), F.min("ordinal").alias("first"))
    return W.best_row(g.withColumn("tie", F.col("first") * 2 + tie), ["task_id"], "n_values", "tie")


@query("W05_samples", "strategy_used:S rank:I task_id:S url:S", f"""
{_RESULTS} SELECT strategy_used, rn AS rank, task_id, url FROM (SELECT *, row_number() OVER (PARTITION BY strategy_used ORDER BY url, task_id, ordinal) AS rn FROM results) WHERE rn <= 5""")
def _(t):
    return W.first_k(t.view("results"), ["strategy_used"], ["url", "task_id", "ordinal"], 5)


@query("W06_progress_tracking", "event_id:L user_id:L checkpoint:L current:L percentage:D elapsed_time:D estimated_remaining:D", """
WITH c AS (SELECT event_id, user_id, row_number() OVER w AS checkpoint, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, least(checkpoint, 40) AS current FROM c)
SELECT event_id, user_id, checkpoint, current, round(current / 40 * 100, 1) AS percentage, round(elapsed, 2) AS elapsed_time,
  CASE WHEN checkpoint >= 2 AND elapsed > 0 THEN round((40 - current) / (current / elapsed), 1) END AS estimated_remaining FROM p""")
def _(t):
    return W.progress_tracking(t.events, ["user_id"], "ts", "event_id", 40)


@query("W07_latest_success", "event_id:L user_id:L last_success_at:S best_route:S", """
SELECT event_id, user_id, strftime(last_value(CASE WHEN event_type <> 'error' THEN ts END IGNORE NULLS) OVER w, '%Y-%m-%d %H:%M:%S.%f') AS last_success_at,
  last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER w AS best_route FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    out = W.latest_success(t.events, ["user_id"], "ts", "event_id", "event_type", F.col("event_type") != "error")
    return out.withColumn("last_success_at", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("W08_recovery_flag", "o1:L any_kept:B", f"""
{_OBS} SELECT o1, bool_or({PERMISSIVE} AND page_id % 10 <> 4) OVER (PARTITION BY page_id) AS any_kept FROM obs""")
def _(t):
    from statloom.functions import predicates
    keep = predicates.is_permissive_indicator("indicator_name") & (F.col("page_id") % 10 != 4)
    return filtering.group_flag(t.view("obs").withColumn("relevant", keep), ["page_id"], "relevant")


@query("W09_site_picks", "site:S rank:I url:S score:D", f"""
{SCORED_SITES_SQL}, s AS (SELECT split_part(url, '/', 3) AS site, url, round(score, 6) AS score, page_id, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY round(score, 6) DESC, url, page_id) AS rank FROM scored)
SELECT site, rank, url, score FROM s WHERE rank <= 3 ORDER BY site, rank LIMIT 5""")
def _(t):
    pages = scored_sites(t).select(urls.authority("url").alias("site"), "url", F.round("score", 6).alias("score"), "page_id")
    return W.site_picks(pages, 3, 5)
