"""Page snapshots, the source catalogue and assembled document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions import text
from statloom.session import small_table


def read_pages(spark: SparkSession, path: str, content: str = "html") -> DataFrame:
    """Page snapshots with usable content, whole."""
    return gate_pages(spark.read.parquet(path), content)


def gate_pages(pages: DataFrame, content: str = "html") -> DataFrame:
    usable, stored = text.kept_content(content)
    return pages.filter(usable).withColumn(content, stored)


def source_catalogue(spark: SparkSession, sources: dict[str, list[str]] = R.SOURCES) -> DataFrame:
    """Catalogue as rows: source_group, ordinal, url."""
    rows = [(group, i, url) for group, urls in sources.items() for i, url in enumerate(urls)]
    return small_table(spark, ["source_group", "ordinal", "url"], rows)


def assemble_pages(fragments: DataFrame, max_parts: int = 10, max_chars: int = 20000) -> DataFrame:
    """Document text from page fragments (doc_id, part_no, body): the first parts in order, each
    ended by a line feed, cut to the size limit."""
    first = fragments.filter("body <> ''").withColumn(
        "rn", F.row_number().over(W.partitionBy("doc_id").orderBy("part_no"))
    )
    return _join(first.filter(F.col("rn") <= max_parts), ["rn"], max_chars)


def assemble_sheets(
    cells: DataFrame, max_sheets: int = 3, max_rows: int = 100, max_chars: int = 15000
) -> DataFrame:
    """Document text from sheet rows (doc_id, sheet_no, row_no, cells array): the first rows of the
    first sheets, cells joined by `` | ``. Both caps prune before the shuffle."""
    by_row = W.partitionBy("doc_id", "sheet_no").orderBy("row_no")
    rows = cells.withColumn("rn", F.row_number().over(by_row)).filter(F.col("rn") <= max_rows)
    sheets = rows.withColumn("sheet", F.dense_rank().over(W.partitionBy("doc_id").orderBy("sheet_no")))
    bodies = sheets.filter(F.col("sheet") <= max_sheets).withColumn("body", F.array_join(F.array_compact("cells"), " | "))
    return _join(bodies.filter(F.trim("body") != ""), ["sheet", "rn"], max_chars)


def _join(rows: DataFrame, order: list[str], max_chars: int) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, "body")))
    lines = F.transform(parts, lambda p: F.concat(p["body"], F.lit("\n")))
    return rows.groupBy("doc_id").agg(F.substring(F.array_join(lines, ""), 1, max_chars).alias("content"))
