"""Approximate nearest neighbours (largest inner products) by learned partitions.

On a bounded sample a graph of the vectors with the largest inner products is built and cut into parts of equal size:
vectors move to the part that most of their neighbours have, as long as it has room. A softmax classifier of direction
and length learns the parts and gives every vector its part. A second one, of the direction alone, learns how the true
neighbours of a query spread over the parts; a query visits its most probable ones, whose vectors are scored exactly. The
number of parts is the smallest that finds ``AIM`` of the true neighbours of sample queries that neither was fitted on.

Sample sizes are parameters; all rows are indexed and whole tables are searched. Vectors that don't take part are
those named in ``vectors`` and zero vectors. Ties go to the smaller id; with fewer candidates than k all found are
given. Rows of one id are candidates each, but not of each other; as a query an id asks once, with its least vector. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import vectors as V
from statloom.llm.registry import query, table
from statloom.llm.storage import stored

K = 20
EVERY = 20
SAMPLE = 4000
PARTS = 16
NEIGHBOURS = 16
AIM = 0.96


def balanced_parts(x: np.ndarray, parts: int = PARTS, neighbours: int = NEIGHBOURS, rounds: int = 15) -> np.ndarray:
    """Equal parts of the neighbour graph of the sample."""
    n = len(x)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    k = min(neighbours, n - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((n, 0), dtype=int)
    own_end, other_end = np.repeat(np.arange(n), k), near.ravel()
    room = -(-n // parts)
    # A start along the main direction of what is left: halves of halves.
    label = np.zeros(n, dtype=int)
    width = 1
    while width < parts:
        fresh = label * 2
        for p in range(width):
            own = np.flatnonzero(label == p)
            if len(own):
                centred = x[own] - x[own].mean(axis=0)
                axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
                fresh[own[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]]] += 1
        label, width = fresh, width * 2
    label %= parts
    for _ in range(rounds):
        ends = np.concatenate([own_end * parts + label[other_end], other_end * parts + label[own_end]])
        votes = np.bincount(ends, minlength=n * parts).reshape(n, parts)
        gain = votes.max(axis=1) - votes[np.arange(n), label]
        taken = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            to = int(votes[i].argmax())
            if gain[i] <= 0:
                break
            if to != label[i] and taken[to] < room * 1.05:
                taken[label[i]] -= 1
                taken[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def fit_router(x: np.ndarray, truth: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on the shares of the parts, by gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], truth.shape[1])), np.zeros(truth.shape[1])
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    scale = 4.0 * np.sqrt(x.shape[1])
    for _ in range(steps):
        p = probabilities(x, w, b)
        slope = (p - truth) / len(x)
        speed_w = 0.9 * speed_w + x.T @ slope + 1e-6 * w
        speed_b = 0.9 * speed_b + slope.sum(axis=0)
        w -= scale * speed_w
        b -= speed_b
    return w, b


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = x @ w + b
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(x: np.ndarray, asked: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k candidates with the largest inner products, none of the query itself."""
    scores = x[asked] @ x[candidates].T
    scores[asked[:, None] == candidates[None, :]] = -np.inf
    k = min(k, len(candidates) - 1)
    return candidates[np.argpartition(-scores, k - 1, axis=1)[:, :k]]


def visits(near: np.ndarray, home: np.ndarray, p: np.ndarray, aim: float = AIM) -> int:
    """How many of the most probable parts hold the share ``aim`` of the true neighbours."""
    place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.take_along_axis(place, home[near], axis=1)
    for m in range(1, p.shape[1]):
        if (needed < m).mean() >= aim:
            return m
    return p.shape[1]


class Router:
    """Parts of vectors and of queries, learned from a sample."""

    def __init__(self, x: np.ndarray, k: int):
        self.parts = max(1, min(PARTS, len(x) // 8))
        self.several = 1
        if self.parts == 1:
            return
        left_out = np.arange(len(x)) % max(2, min(10, len(x) // 100)) == 0
        fitted, asked = np.flatnonzero(~left_out), np.flatnonzero(left_out)
        length = self._length(x)
        self.middle, self.spread = float(length.mean()), max(float(length.std()), 1e-3)
        label = balanced_parts(x[fitted], self.parts)
        self.of_vectors = fit_router(self._features(x[fitted]), np.eye(self.parts)[label])
        home = self.homes(x)
        near = nearest(x, fitted, fitted, k)
        spread = np.stack([(home[near] == p).mean(axis=1) for p in range(self.parts)], axis=1)
        self.of_queries = fit_router(directions(x[fitted]), spread)
        self.several = visits(nearest(x, asked, np.arange(len(x)), k), home, probabilities(directions(x[asked]), *self.of_queries))

    @staticmethod
    def _length(x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(np.linalg.norm(x, axis=1), 1e-300))

    def _features(self, x: np.ndarray) -> np.ndarray:
        length = np.clip((self._length(x) - self.middle) / self.spread, -4, 4)
        return np.column_stack([directions(x), length / np.sqrt(x.shape[1])])

    def homes(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros(len(x), dtype=int)
        return probabilities(self._features(x), *self.of_vectors).argmax(axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The parts of each query, most probable first."""
        if self.parts == 1:
            return np.zeros((len(x), 1), dtype=int)
        return np.argsort(-probabilities(directions(x), *self.of_queries), axis=1, kind="stable")[:, : self.several]


def search(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    rows = V.valid(embeddings).filter(F.exists("vec", lambda v: v != 0))
    width = rows.agg(F.max(F.size("vec"))).first()[0]
    schema = "query_id long, vec_id long, score double"
    if width is None:
        return V.ranked(embeddings.sparkSession.createDataFrame([], schema), k)
    x = V.sample(rows, SAMPLE)
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    router = Router(x, k)

    def route(cells, each: int, name: str):
        def run(frames):
            for pdf in frames:
                v = np.zeros((len(pdf), width))
                for i, row in enumerate(pdf["vec"]):
                    v[i, : len(row)] = row
                raw = [r.tobytes() for r in v]
                yield pd.DataFrame({
                    "cell": cells(v).ravel(), name: np.repeat(pdf["vec_id"].to_numpy(), each), "vec": [r for r in raw for _ in range(each)],
                })

        return run

    index = stored(rows.mapInPandas(route(router.homes, 1, "vec_id"), "cell int, vec_id long, vec binary").withColumn("row", F.monotonically_increasing_id()), "parts")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    queries = stored(asked.mapInPandas(route(router.visited, router.several, "query_id"), "cell int, query_id long, vec binary"), "routes")

    def kernel(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        scores = V.matrix(q["vec"], width) @ V.matrix(v["vec"], width).T
        return V.best(scores, q["query_id"].to_numpy(), v["vec_id"].to_numpy(), k)

    return V.ranked(V.in_blocks(index, queries, kernel, schema), k)


@query("op6_learned_partitions")
def learned_partitions(spark, folder):
    """Twenty nearest of every twentieth vector."""
    return search(table(spark, folder, "embeddings"))
