import math

import numpy as np
import pytest

from statloom.llm import exact_search, neighbours, vectors as V
from statloom.llm.storage import stored
from tests.conftest import FOLDER
from tests.llm.helpers import clashing, listed

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=700, hot=200):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:hot] = x[0]  # one very common vector
    out = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(None, out[5][1], 1), (2000, None, 1), (2100, [float("nan")] * 16, 1), (2200, [float("inf")] * 16, 1), (2300, [None] * 16, 1), (2400, [0.0] * 16, 1), (2500, [0.5, -0.5], None)]
    return out + odd


def valid(table):
    return [(i, np.pad(np.array(v, dtype=float), (0, 16 - len(v)))) for i, v, _ in table if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute(vectors, k, every):
    out = []
    for q, v in vectors:
        if q % every == 0:
            scored = sorted((-float(v @ w), i) for i, w in vectors if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def test_exact_search_matches_brute_force(spark):
    table = rows()
    vectors = [(i, np.floor(1024 * v)) for i, v in valid(table)]
    got = listed(exact_search.search(clashing(spark.createDataFrame(table, SCHEMA))), "query_id", "rank", "vec_id", "score")
    assert got == sorted(((q, r, i, int(s)) for q, r, i, s in brute(vectors, 10, 100)), key=repr)


def test_few_and_no_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (100, [1.0, 1.0], 1)], SCHEMA)
    assert listed(exact_search.search(few), "query_id", "rank", "vec_id", "score") == [(0, 1, 100, 1048576), (0, 2, 1, 0), (100, 1, 0, 1048576), (100, 2, 1, 1048576)]
    assert neighbours.search(few).count() == 4
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_search.search(empty).count() == 0 and neighbours.search(empty).count() == 0


@pytest.mark.parametrize("given", [True, False])
def test_neighbours_recall_and_scores(spark, given):
    frame = spark.createDataFrame(rows(), SCHEMA) if given else spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    table = [tuple(r) for r in frame.collect()]
    vectors = [(i, np.array(v, dtype=float) if len(v) != 2 else np.pad(np.array(v, dtype=float), (0, 14))) for i, v, _ in table if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    found = neighbours.search(clashing(frame)).collect()
    true = {}
    for q, r, i, s in brute(vectors, 20, 20):
        true.setdefault(q, {})[i] = s
    by = dict(vectors)
    assert all(abs(float(by[r.query_id] @ by[r.vec_id]) - r.score) < 1e-12 and r.query_id != r.vec_id for r in found)
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.score)
    assert set(got) == set(true) and all(g == sorted(g, reverse=True) for g in got.values())
    hits = sum(sum(s >= min(true[q].values()) - 1e-12 for s in g) for q, g in got.items())
    assert hits / sum(map(len, true.values())) >= 0.9


def test_repeated_ids_are_candidates_each(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    # Thirty rows of one id near a query, half of them equal; a query id with two equal rows and one that differs.
    table += [(777, [float(c) for c in x[100] * 2 + (0 if i < 15 else 0.01 * i)], 1) for i in range(30)]
    table += [(200, table[200][1], 1), (200, table[7][1], 1)]
    frame = spark.createDataFrame(table, SCHEMA)
    whole = [(i, np.floor(1024 * np.array(v))) for i, v, _ in table]
    want = []
    for q in (0, 100, 200):
        scored = sorted((-int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q)[:10]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert listed(exact_search.search(frame), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    found = [r for r in neighbours.search(frame, every=100).collect() if r.query_id == 100]
    assert len(found) == 20 and all(r.vec_id == 777 for r in found)


def test_neighbours_recall_with_unequal_norms(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 16))
    x *= r.lognormal(0, 1, size=(3000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {}
    for row in neighbours.search(frame).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (150 * 20) >= 0.9, hits / (150 * 20)


def test_router_is_tuned_on_queries_left_out():
    r = np.random.default_rng(12)
    x = r.normal(size=(3000, 16))
    x *= r.lognormal(0, 1, size=(3000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    router, fresh = neighbours.Router(x[:2000], 20), x[2000:]
    near = np.argsort(-(fresh @ x[:2000].T), axis=1)[:, :20]
    visited, home = router.visited(fresh), router.homes(x[:2000])
    assert (home[near][:, :, None] == visited[:, None, :]).any(axis=2).mean() >= 0.93


def test_blocks_broadcast_the_sizes_only(spark):
    """Repeated vectors make a small file of large rows, which must not go through the driver."""
    r = np.random.default_rng(1)
    index = stored(spark.createDataFrame([(i % 3, i, r.bytes(512), i) for i in range(3000)], "cell int, vec_id long, vec binary, row long"), "index")
    one = r.bytes(512)
    queries = stored(spark.createDataFrame([(i % 3, i, one) for i in range(3000)], "cell int, query_id long, vec binary").coalesce(1), "asked")
    plan = V.in_blocks(index, queries, lambda q, v: None, "query_id long, vec_id long, score double")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "BuildLeft" not in plan


def test_sample_is_drawn_by_hash_and_id(spark):
    """Also where rows of one id are more than the sample."""
    table = spark.createDataFrame([(i % 40 if i % 2 else 7, [float(i), 1.0]) for i in range(400)], "vec_id long, vec array<double>").repartition(16)
    order = sorted((h, i, list(v)) for h, i, v in table.selectExpr("xxhash64(vec_id)", "vec_id", "vec").collect())
    for n in (1, 5, 90, 400, 1000):
        assert V.sample(table, n).tolist() == [v for _, _, v in order[:n]]
