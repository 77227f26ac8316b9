"""Depth-limited traversal of a link graph.

Breadth-first: each level joins the frontier with the links, keeps the first links per page in
priority order, and drops pages already visited. One job per level; the visited set is cut from its
lineage with a reliable checkpoint, so the plan stays short and lost executors cost no recomputation
of earlier levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions import urls
from statloom.session import cut_lineage


#: Expected links of a task. It sets how many tasks rank and join them, never how many links there may be.
TASK_LINKS = 200_000


def dealt_links(links: DataFrame) -> DataFrame:
    """The links by source page, in as many tasks as their number asks for. Addresses are so alike that a shuffle of them is
    small; by its bytes alone the same few tasks would get more links the more there are, and must sort them."""
    kept = cut_lineage(links.select("src_url", "dst_url"))
    least = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(max(least, -(-kept.count() // TASK_LINKS)), "src_url")


def ranked_links(links: DataFrame, per_page: int = 5) -> DataFrame:
    """First links of each page, priority links first, then by address. The cap prunes inside every
    task before the shuffle."""
    order = [F.col("is_priority").desc(), F.col("dst_url")]
    tagged = links.select("src_url", "dst_url", urls.is_priority_link("dst_url").alias("is_priority"))
    ranked = tagged.withColumn("rank", F.row_number().over(W.partitionBy("src_url").orderBy(*order)))
    return ranked.filter(F.col("rank") <= per_page)


def crawl(links: DataFrame, starts: DataFrame, max_depth: int = 3, max_pages: int | None = None, per_page: int = 5) -> DataFrame:
    """Visited pages per site: site, url, depth. ``links`` has src_url and dst_url, ``starts`` has site
    and url. With ``max_pages`` each site visits at most so many, within a level by address."""
    follow = cut_lineage(ranked_links(dealt_links(links), per_page).select("src_url", "dst_url"))
    # A checkpoint keeps the size that was estimated for the plan it cut, and rendered links are estimated far too small: without
    # the hint all of them are broadcast. A merge sorts them in parts and can spill.
    follow = follow.hint("merge")
    visited = cut_lineage(starts.select("site", "url").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth):
        reached = (
            frontier.join(follow, F.col("url") == F.col("src_url"))
            .select("site", F.col("dst_url").alias("url"))
            .distinct()
            .join(visited.select("site", "url").hint("merge"), ["site", "url"], "left_anti")
        )
        room = reached
        if max_pages is not None:
            counts = visited.groupBy("site").agg(F.count("*").alias("n_visited"))
            by_site = W.partitionBy("site").orderBy("url")
            capped = reached.withColumn("place", F.row_number().over(by_site)).filter(F.col("place") <= max_pages)
            room = capped.join(counts, "site").filter(F.col("place") + F.col("n_visited") <= max_pages)
        frontier = cut_lineage(room.select("site", "url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        visited = cut_lineage(visited.union(frontier))
    return visited
