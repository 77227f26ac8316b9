import random
import re

import pytest

from statloom.llm import jaccard
from statloom.llm.components import components
from tests.llm.helpers import clashing, documents, empty, listed, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(table, words=4, percent=85):
    sets = []
    for r in table:
        w = re.findall("[^\x20\x09-\x0d]+", (r[1] or "").translate(LOWER))
        sets.append((r[0], frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    names = sorted({i for i, _ in sets if i is not None})
    label = {i: i for i in names}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                label[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_matches_brute_force(spark, words, percent):
    r = random.Random(words)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(80)]
    more = []
    for i in range(80):  # one family of near copies: a hot group
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "new%d" % r.randint(0, 40)
        more.append((500 + i, " ".join(w[: r.choice([80, 80, 76, 70])])))
    for i in range(40):  # a shared passage in different texts
        more.append((700 + i, " ".join(base[:20]) + " " + " ".join(f"w{r.randint(0, 500)}" for _ in range(30))))
    got = listed(jaccard.join(clashing(documents(spark, more)), words, percent), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows() + more, words, percent)


def test_one_of_each(spark):
    out = jaccard.one_of_each(documents(spark))
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == documents(spark).columns
    assert kept.count(None) == 2 and 10 in kept and not {11, 12, 26} & set(kept) and {16, 17, 21} <= set(kept)


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    a, b = "a clean text of its own with seven words more", "another text that shares nothing at all"
    near = [(901, a + " x" * k) for k in (0, 0)] + [(901, b), (902, b), (903, None), (903, ""), (904, a)]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(near)], "doc_id long, text string, __mark int")
    table = table.selectExpr("*", "0 AS __content", "map(1, __mark) AS other")
    out = jaccard.one_of_each(table)
    assert out.columns == table.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=repr)[:2] == [(901, a), (901, b)] and len(got) == 3 and got.count((901, a)) == 1
    assert {i for i, _ in got} == {901, 903}
    assert sorted(map(repr, out.collect())) == sorted(map(repr, jaccard.one_of_each(table.repartition(7, "__mark")).collect()))


def test_empty_table(spark):
    assert jaccard.join(empty(spark)).count() == 0
    assert jaccard.one_of_each(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    got = {tuple(r) for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)}
