"""Sorted and limited results. Every limit is the feature itself and ends in a bounded top-k plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import urls
from statloom.functions.common import each


def newest_tasks(tasks: DataFrame, limit: int = 100, offset: int = 0, status: str | None = None) -> DataFrame:
    chosen = tasks.filter(F.col("status") == status) if status else tasks
    return chosen.orderBy(F.col("created_at").desc(), "row_id").offset(offset).limit(limit)


def richest_pages(pages: DataFrame, limit: int = 20) -> DataFrame:
    return pages.orderBy(F.col("score").desc(), "page_id").limit(limit)


def most_frequent(rows: DataFrame, item: str, limit: int = 3) -> DataFrame:
    return rows.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), item).limit(limit)


def prioritised(links: Column) -> Column:
    """Links of an array with priority links first, otherwise in their order."""
    return F.concat(
        F.filter(links, lambda u: urls.is_priority_link(u)), F.filter(links, lambda u: ~urls.is_priority_link(u))
    )


def prioritised_links(pages: DataFrame, links: Column) -> DataFrame:
    return each(pages, ("page_id",), prioritised(links), "link", "position")


def limited_urls(urls_column, limit: int = 10) -> dict[str, Column]:
    """First URLs of a task and whether the list was cut."""
    c = F.col(urls_column) if isinstance(urls_column, str) else urls_column
    return {"kept_urls": F.slice(c, 1, limit), "is_limited": F.size(c) > limit}


def distinct_then_limit(values: Column, limit: int = 20) -> Column:
    return F.slice(F.array_sort(F.array_distinct(values)), 1, limit)
