"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from statloom.llm import simhash
from statloom.llm.queries import QUERIES
from tests.conftest import FOLDER
from tests.llm.helpers import SCHEMA, clashing, empty, prose, rows


def plain(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def parts(fps, distance=3):
    """Component number of each fingerprint."""
    fps = np.array(fps, dtype=np.uint64)
    label = np.full(len(fps), -1)
    for start in range(len(fps)):
        if label[start] < 0:
            label[start], todo = start, [start]
            while todo:
                near = np.flatnonzero((label < 0) & (np.bitwise_count(fps ^ fps[todo.pop()]) <= distance))
                label[near] = start
                todo += near.tolist()
    return label.tolist()


def brute(table):
    fps = [plain(t) for t in (r[1] for r in table)]
    label = parts(fps)
    least = {}
    for row, k in zip(table, label):
        if row[0] is not None:
            least[k] = min(least.get(k, row[0]), row[0])
    return sorted(((row[0], f"{fp:016x}", least.get(k)) for row, fp, k in zip(table, fps, label)), key=repr)


def run(monkeypatch, df):
    monkeypatch.setattr(simhash, "table", lambda *a: df)
    return sorted(map(tuple, QUERIES["op12_simhash_blocks"](df.sparkSession, "").collect()), key=repr)


def test_rows_of_all_kinds_match_brute_force(spark, monkeypatch):
    r = random.Random(4)
    more = []
    for i in range(60):  # near copies: one word in a long text
        words = prose(77, 300).split()
        words[r.randrange(len(words))] = "changed"
        more.append((500 + i, " ".join(words), "en", "s", 1))
    table = rows() + more + [(None, None, None, None, None), (600, "\x1c a b c", "en", "s", 1), (601, "ÀB CD", "en", "s", 1), (602, "Àb cd", "en", "s", 1)]
    got = run(monkeypatch, clashing(spark.createDataFrame(table, SCHEMA)).withColumns({c: F.lit(1) for c in ("fp", "class", "component", "least")}))
    assert got == brute(table)
    assert len({c for _, _, c in got}) < len(got)


def test_given_documents_match_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_simhash_blocks"](spark, FOLDER).collect()), key=repr) == brute(table)


def test_empty_table(spark, monkeypatch):
    assert run(monkeypatch, empty(spark)) == []


def test_long_texts_in_slices(monkeypatch):
    text = prose(3, 3000) + " " + "x" * 500
    monkeypatch.setattr(simhash, "SLICE_BYTES", 37)
    assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint(b"one  two") == plain("one two") and simhash.fingerprint(b"") == 0


def clouds(seed, sizes, reach):
    """Distinct fingerprints around a few middles, and far ones."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(150)}
    for n in sizes:
        middle, target = r.getrandbits(64), len(out) + n
        while len(out) < target:
            out.add(middle ^ sum(1 << b for b in r.sample(range(64), r.randint(0, reach))))
    return sorted(out)


@pytest.mark.parametrize("seed,sizes,reach", [(1, [900], 4), (2, [300, 300], 6), (3, [120] * 4, 9)])
def test_large_buckets_lose_no_link(spark, monkeypatch, seed, sizes, reach):
    """Buckets beyond one task: leaders, parts and further splits give the components of all pairs."""
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "PART", 60)
    fps = clouds(seed, sizes, reach)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all((a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
    up = {f: f for f in signed}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in found:
        up[root(a)] = root(b)
    ours, want = {}, {}
    for f, k in zip(signed, parts(fps)):
        ours.setdefault(root(f), set()).add(f)
        want.setdefault(k, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))
    # Far fewer links than pairs of one cloud.
    assert len(found) < 40 * len(fps)
