"""Every registered query against its checking SQL, and its plan against rules that keep it scalable."""

import pytest

from statloom.plans import load_all
from statloom.plans.registry import QUERIES
from tests.conftest import FOLDER

load_all()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_sql(name, spark, duck):
    q = QUERIES[name]
    names = [c for c, _ in q.columns]
    df = q.frame(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, f"{name} plans {bad}"
    got = normal([tuple(r) for r in df.collect()], names)
    assert got == normal(duck.execute(q.checking_sql()).fetchall(), names)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name].frame(spark, FOLDER).count() > 0


def test_names_are_unique_and_complete():
    wanted = dict(S=13, U=12, N=26, C=13, Q=17, F=18, X=22, L=5, J=10, A=23, W=9, O=6, D=5, M=10, T=3, E=1)
    have = {name[:3] for name in QUERIES}
    missing = [f"{p}{i:02d}" for p, n in wanted.items() for i in range(1, n + 1) if f"{p}{i:02d}" not in have]
    assert missing == []
