"""Proofs against a tree of all levels in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from statloom.llm import merkle
from statloom.llm.queries import QUERIES, SQL
from tests.llm.helpers import SCHEMA, clashing, documents, empty, listed, rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        other = level[at ^ 1] if at ^ 1 < len(level) else ""
        out.append((at % 2 == 1, other))
        at //= 2
    return out


def brute(table):
    groups = {}
    for row in table:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = tree([leaf(*r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for k, (i, text, lang, source, n) in enumerate(groups[g]):
            siblings = way(trees[g], k) + way(top, at)
            shown = n + 1 if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
            root = leaf(i, text, lang, source, shown)
            for left, other in siblings:
                root = h(other, root) if left else h(root, other)
            out.append((i, leaf(i, text, lang, source, n), trees[g][-1][0], top[-1][0], h(*[o for _, o in siblings]), root, root == top[-1][0]))
    return sorted(out, key=repr)


def run(monkeypatch, df):
    monkeypatch.setattr(merkle, "table", lambda *a: df)
    return listed(QUERIES["op11_merkle_manifest"](df.sparkSession, ""), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_odd_rows_match_brute_force(spark, monkeypatch):
    table = rows() + [(40, "only one", "só", "s", 8), (41, "x", "z", None, None), (42, "y", "", "s", 1)]
    got = run(monkeypatch, clashing(spark.createDataFrame(table, SCHEMA)).withColumn("grp", F.lit(1)).withColumn("pos", F.lit(2)))
    assert got == brute(table)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 64, 65, 4097])
def test_every_height(spark, monkeypatch, n):
    table = [(i, f"text {i}", "en", "s", i) for i in range(n)]
    assert run(monkeypatch, spark.createDataFrame(table, SCHEMA)) == brute(table)


def test_many_groups_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)  # many ranges, equal rows over several of them
    table = [(i, "t", f"l{i % 150}", "s", 1) for i in range(300)] + [(7, "same", "en", "s", 4)] * 200
    assert run(monkeypatch, spark.createDataFrame(table, SCHEMA)) == brute(table)


def test_empty_table_has_no_proofs(spark, monkeypatch):
    assert run(monkeypatch, empty(spark)) == []


def test_stored_levels_stay_few(spark):
    leaves = spark.range(5000).select(F.lit("en").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    levels, over, root = merkle.manifest(leaves)
    assert [x.count() for x in levels] == [79, 2, 1] and [x.count() for x in over] == [1]  # of 10 003 nodes in 14 levels
    assert root.count() == 1


def test_sql_matches_on_odd_rows(spark, monkeypatch, duck):
    import duckdb

    con = duckdb.connect()
    con.register("documents", documents(spark).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = sorted(con.execute(SQL["op11_merkle_manifest"]).fetchall(), key=repr)
    assert run(monkeypatch, documents(spark)) == want
