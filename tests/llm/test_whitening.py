"""Whitening against numpy on one machine, in exact sums where the contract is exact."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import whitening
from statloom.llm.queries import QUERIES
from tests.conftest import FOLDER
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(n=500, d=40, seed=5):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) @ np.diag(np.linspace(0.05, 1.0, d)) + r.normal(size=d)).astype(np.float32)
    x[: n // 3] = x[0]  # one vector holds a third of the rows
    return [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]


ODD = [
    (None, [0.5] * 40, 1), (7, [0.25] * 40, 1), (7, [0.25] * 40, 1), (900, None, 1), (901, [float("nan")] * 40, 1), (902, [float("-inf")] * 40, None),
    (903, [None] * 40, 1), (904, [0.5, -0.5], 1), (905, [], 1),
]


def whole(rows):
    kept = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    return [i for i, _ in kept], [[math.floor(64 * c) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in kept]


def run(monkeypatch, df):
    monkeypatch.setattr(whitening, "table", lambda *a: df)
    return QUERIES["op13_block_whitening"](df.sparkSession, "")


def compare(got, rows, count=32):
    ids, x = whole(rows)
    n, d = len(x), len(x[0])
    s = [sum(c) for c in zip(*x)]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(count, d)
    want = c @ (vectors[:, :count] / np.sqrt(values[:count]))
    exact = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert len(got) == n * count and {r["n"] for r in got} == {n}
    first = {}
    for r in got:
        first.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    for i, row, dev in zip(ids, want, exact):
        mine = first[i, dev]
        assert sorted(mine) == list(range(1, count + 1))
        for k in range(count):
            assert any(abs(abs(r["whitened"]) - abs(row[k])) < 1e-6 for r in mine[k + 1])
            assert abs(mine[k + 1][0]["explained"] - values[k] / values.sum()) <= 1e-9
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    # One sign a component for all rows: products of components don't depend on it.
    by = np.array([[first[i, dev][k + 1][0]["whitened"] for k in range(count)] for i, dev in zip(ids, exact)])
    assert np.allclose(np.abs(by.T @ by / n), np.eye(count), atol=1e-6)


def test_rows_of_all_kinds_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 32)  # many blocks, several splits
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 3)
    df = clashing(spark.createDataFrame(table() + ODD, SCHEMA)).withColumns({c: F.lit(1) for c in ("row", "x", "at", "w")})
    compare(run(monkeypatch, df.repartition(7)).collect(), table() + ODD)


def test_given_table_matches_numpy(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    compare(QUERIES["op13_block_whitening"](spark, FOLDER).collect(), rows)


def test_fewer_dimensions_than_components(spark, monkeypatch):
    rows = table(100, 5, 9)
    compare(run(monkeypatch, spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_components_without_variance_are_null(spark, monkeypatch):
    rows = [(i, [float(i % 4), 2.0, -1.0], 1) for i in range(20)]
    got = run(monkeypatch, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 60 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert {r["explained"] for r in got} == {1.0, 0.0} and {r["identity_error"] for r in got}.pop() < 1e-9
    one = run(monkeypatch, spark.createDataFrame([(1, [0.5, 0.25], 1)], SCHEMA)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 1, 0, None, 0.0), (1, 2, 1, 0, None, 0.0)]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)]])
def test_no_vectors_no_rows(spark, monkeypatch, rows):
    df = run(monkeypatch, spark.createDataFrame(rows, SCHEMA))
    assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_exact_in_the_operator(spark):
    x = spark.createDataFrame([([5 * 10**9, 3],)], "x array<long>")
    got = x.select(whitening.deviation(10**9, [10**9, 0]).alias("d")).first()[0]
    assert int(got) == (10**9 * 5 * 10**9 - 10**9) ** 2 + (3 * 10**9) ** 2
