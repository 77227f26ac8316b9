"""Vectors in cells, queries sent to cells, best scores merged. Shared by the two searches.

A vector takes part if it has an id, is not null and has no null or non-finite component. A shorter vector than
others counts as filled up with zeros. Vectors travel as little-endian doubles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Expected rows of one block of a cell, and queries that meet it at a time.
CELL_ROWS = 4096
QUERY_ROWS = 2048


def valid(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vec`` (array of doubles) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vec"))


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of binary doubles as a matrix of the given width."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, dtype=np.float64)
        out[i, : len(row)] = row
    return out


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most n vectors, drawn by a hash of their id, as a matrix. The driver gets n vectors, not n of each task."""
    keyed = rows.select(F.xxhash64("vec_id").alias("hash"), "vec_id", "vec")
    last = keyed.select("hash", "vec_id").orderBy("hash", "vec_id").limit(n).agg(F.max(F.struct("hash", "vec_id")).alias("last")).select("last.*").first()
    upto = (F.col("hash") < last[0]) | ((F.col("hash") == last[0]) & (F.col("vec_id") <= last[1]))
    # Rows of one id may be many, so the limit stays, and is reached before the rows are collected.
    found = keyed.filter(upto).orderBy("hash", "vec_id", "vec").limit(n).repartition(1).toPandas()
    drawn = [v for _, _, v in sorted((h, i, list(v)) for h, i, v in zip(found["hash"], found["vec_id"], found["vec"]))]
    width = max((len(v) for v in drawn), default=0)
    out = np.zeros((len(drawn), width))
    for i, v in enumerate(drawn):
        out[i, : len(v)] = v
    return out


def in_blocks(index: DataFrame, queries: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(queries, vectors)`` for each cell. Large cells and large sets of queries are split, so that a task never
    holds more than about ``CELL_ROWS`` vectors and ``QUERY_ROWS`` queries. ``index``: (cell, vec_id, row, ...), a stored
    table where ``row`` tells rows of one id apart; ``queries``: (cell, query_id, vec, ...)."""
    # Cells are few. Without the hint the other side may be broadcast: files of repeated vectors are a hundredth of their rows.
    sizes = F.broadcast(index.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")))
    number = queries.select("query_id", F.xxhash64("vec")).distinct().count()
    blocks = max(1, -(-number // QUERY_ROWS))
    vectors = index.join(sizes, "cell").withColumn("part", F.pmod(F.hash("row"), "parts")).drop("parts", "row")
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asked = asked.withColumn("block", F.pmod(F.hash("query_id", "vec"), F.lit(blocks)))
    keys = ["cell", "part", "block"]

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return kernel(q, v) if len(q) and len(v) else pd.DataFrame(columns=["query_id", "vec_id", "score"])

    return asked.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(run, schema)


def best(scores: np.ndarray, query_ids: np.ndarray, vec_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    """Of each row of scores the k highest columns, ties to the smaller id; none of the query's own id, none under
    ``least``."""
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, scores = vec_ids[order], scores[:, order].astype(np.float64)
    scores[query_ids[:, None] == vec_ids[None, :]] = -np.inf
    if least is not None:
        scores[scores < least[:, None]] = -np.inf
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    value = np.take_along_axis(scores, top, axis=1)
    hit = np.isfinite(value)
    row = np.nonzero(hit)[0]
    return pd.DataFrame({"query_id": query_ids[row], "vec_id": vec_ids[top[hit]], "score": value[hit]})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of each query. Rows of one id are candidates each."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
