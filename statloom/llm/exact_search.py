"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers, ``floor(1024 * x)``. One more coordinate makes all of them equally long, which turns the
largest inner product into the smallest distance. A vector's key is its nearest pivot and the ring of its
distance to it. A query first looks at the rings around its own place; the k-th score found there gives a
radius. By the triangle inequality only rings between ``d - radius`` and ``d + radius`` of a pivot (d is the query's
distance to it) can hold a better one: the query expands to these, and inside a ring it scores only vectors whose
distance lies in that range.

Pivots come from a bounded sample; every row is indexed. Vectors that don't take part are named in ``vectors``. Ties
go to the smaller id. A query with fewer candidates than k gets all. Rows of one id are candidates each, but not of
each other; as queries each of them asks and their answers are ranked together, so equal rows repeat each answer. Components are expected below 2**20. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import vectors as V
from statloom.llm.registry import query, table
from statloom.llm.storage import stored

SCALE = 1024
K = 10
EVERY = 100
PIVOT_SAMPLE = 2000
PIVOTS = 16
RINGS = 24


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice from the sample."""
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def search(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    rows = V.valid(embeddings)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.pow(F.floor(v * SCALE).cast("double"), F.lit(2.0)))
    longest, width = rows.agg(F.max(squares), F.max(F.size("vec"))).first()
    schema = "query_id long, vec_id long, score double"
    if longest is None:
        return V.ranked(embeddings.sparkSession.createDataFrame([], schema), k).withColumn("score", F.col("score").cast("long"))
    drawn = _whole(V.sample(rows, PIVOT_SAMPLE))
    drawn = np.pad(drawn, ((0, 0), (0, width - drawn.shape[1])))

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))])

    pivots = _pivots(lifted(drawn), PIVOTS)
    ring = max(float(np.sqrt(4 * longest)) / RINGS, 1e-9)

    def distances(x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
        return np.sqrt(np.maximum(square, 0))

    def place(frames):
        for pdf in frames:
            x = np.zeros((len(pdf), width))
            for i, v in enumerate(pdf["vec"]):
                x[i, : len(v)] = v
            x = _whole(x)
            d = distances(lifted(x))
            near = d.argmin(axis=1)
            at = d[np.arange(len(d)), near]
            cell = near * (RINGS + 1) + np.minimum((at / ring).astype(int), RINGS)
            yield pd.DataFrame({"cell": cell, "vec_id": pdf["vec_id"], "at": at, "vec": [r.tobytes() for r in x]})

    index = stored(rows.mapInPandas(place, "cell int, vec_id long, at double, vec binary").withColumn("row", F.monotonically_increasing_id()), "pivots")
    # No more than k of equal rows can matter.
    asked = index.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "vec").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    asked = asked.select("query_id", "vec", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "vec")

    def route(first: bool):
        """Cells to visit: those around the query's place, or all that the radius leaves."""

        def run(frames):
            for pdf in frames:
                x = V.matrix(pdf["vec"], width)
                # A query is lifted by 0: its distance to a lifted vector falls as the inner product grows.
                q = np.column_stack([x, np.zeros(len(x))])
                d = distances(q)
                square = (x**2).sum(axis=1)
                bound = pdf["bound"].to_numpy(dtype=float)
                radius = np.sqrt(np.maximum(square + longest - 2 * bound, 0)) * (1 + 1e-9) + 1e-6
                out = []
                for i, (name, raw) in enumerate(zip(pdf["query_id"].tolist(), pdf["vec"].tolist())):
                    home = int(d[i].argmin())
                    for p in [home] if first else range(len(pivots)):
                        low, high = (d[i, p] - ring, d[i, p] + ring) if first else (d[i, p] - radius[i], d[i, p] + radius[i])
                        a, b = (int(np.clip(np.floor(t / ring), 0, RINGS)) for t in (max(low, 0), max(high, 0)))
                        if high >= 0:
                            out.extend((p * (RINGS + 1) + r, name, raw, low, high, bound[i]) for r in range(a, b + 1))
                yield pd.DataFrame(out, columns=["cell", "query_id", "vec", "low", "high", "bound"])

        return run

    def kernel(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("at", kind="stable")
        at = v["at"].to_numpy()
        a, b = np.searchsorted(at, q["low"].min() - 1e-6), np.searchsorted(at, q["high"].max() + 1e-6, side="right")
        v, at = v.iloc[a:b], at[a:b]
        if not len(v):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        scores = V.matrix(q["vec"], width) @ V.matrix(v["vec"], width).T
        outside = (at[None, :] < q["low"].to_numpy()[:, None] - 1e-6) | (at[None, :] > q["high"].to_numpy()[:, None] + 1e-6)
        scores[outside] = -np.inf
        return V.best(scores, q["query_id"].to_numpy(), v["vec_id"].to_numpy(), k, q["bound"].to_numpy(dtype=float))

    routed = "cell int, query_id long, vec binary, low double, high double, bound double"
    none = asked.withColumn("bound", F.lit(float("-inf")))
    near = V.ranked(V.in_blocks(index, none.mapInPandas(route(True), routed), kernel, schema), k)
    bound = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    bounded = asked.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    queries = stored(bounded.mapInPandas(route(False), routed), "routes")
    found = V.ranked(V.in_blocks(index, queries, kernel, schema), k)
    return found.withColumn("score", F.col("score").cast("long"))


@query("op5_pivot_search", f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v AS q, v WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}""")
def pivot_search(spark, folder):
    """Ten best of every hundredth vector against all."""
    return search(table(spark, folder, "embeddings"))
