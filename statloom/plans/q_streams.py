"""Streaming, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import extraction as X
from statloom.plans.registry import QUERIES, query
from statloom.sources.tables import Tables
from statloom.streaming import incremental as S


@query("T01_incremental_extraction", "page_id:L link:S", """
SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<a [^>]*?href="([^"]*)"', 1)) AS href FROM pages)""")
def _(t):
    stream = S.landed(t.spark, t.path("page[s]"), t.pages.schema)
    return S.extract_incrementally(stream, lambda pages: X.page_links(pages).select("page_id", "link"))


@query("T01_observations", "page_id:L obs_key:S indicator_name:S value:D unit:S year:I", QUERIES["X04_list_items"].sql)
def _(t):
    live = Tables(t.spark, t.folder, spread=t.spread)
    live.set("part", S.landed(t.spark, t.path("par[t]"), t.part.schema))
    return S.extract_incrementally(live.view("html"), X.list_items)


@query("T02_task_progress", "user_id:L processed:L succeeded:L updated_at:S", """
SELECT user_id, count(*) AS processed, count(*) FILTER (event_type <> 'error') AS succeeded, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM events GROUP BY user_id""")
def _(t):
    stream = S.landed(t.spark, t.path("event[s]"), t.events.schema)
    now = S.maintain_progress(stream, "user_id", F.col("event_type") != "error")
    return now.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("T03_distinct_pages", "url:S", "SELECT DISTINCT url FROM pages")
def _(t):
    stream = S.landed(t.spark, t.path("page[s]"), t.pages.schema)
    return S.distinct_pages(stream.select("url"))
