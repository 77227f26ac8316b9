import hashlib
import random

import numpy as np
import pytest

from statloom.llm import substrings, suffix
from tests.llm.helpers import clashing, documents, empty, listed, rows

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(table):
    first, out = {}, []
    texts = [(r[0], (r[1] or "").encode()) for r in table]
    for doc, raw in texts:
        if doc is not None:
            for k in range(len(raw) - 49):
                first[raw[k : k + 50]] = min(doc, first.get(raw[k : k + 50], doc))
    for doc, raw in texts:
        gone = np.zeros(len(raw) + 2, dtype=int)
        for k in range(len(raw) - 49):
            if doc is not None and first[raw[k : k + 50]] < doc:
                gone[k + 1 : k + 51] = 1
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force_on_odd_rows(spark):
    assert listed(substrings.digest(clashing(documents(spark))), *COLUMNS) == brute(rows())


def test_one_passage_in_most_documents(spark):
    r = random.Random(5)
    passage = "a passage that a third of all documents hold, and that is longer than fifty bytes."
    more = [(1000 + i, "".join(r.choice("abcdef ") for _ in range(r.randint(0, 60))) + passage * (i % 3 > 0) + str(i)) for i in range(900)]
    table = rows() + [(i, t) for i, t in more]
    assert listed(substrings.digest(documents(spark, more)), *COLUMNS) == brute(table)


def test_frequent_phrase_in_different_surroundings_is_split(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT", 3)
    r = random.Random(6)
    more = [(2000 + i, "".join(r.choice("abc") for _ in range(40)) + "a phrase of thirty bytes, this" + "".join(r.choice("xyz") for _ in range(3)) + "tail " * 9) for i in range(60)]
    assert listed(substrings.digest(documents(spark, more)), *COLUMNS) == brute(rows() + more)


def test_texts_lose_the_bytes_and_rows_stay(spark):
    table = documents(spark)
    out = substrings.deduplicate(table)
    assert out.schema.names == table.schema.names and out.count() == table.count()
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert kept[10] == rows()[0][1] and kept[11] == "" and kept[17] is None and kept[16] == ""


def test_empty_table(spark):
    assert substrings.digest(empty(spark)).count() == 0
    assert substrings.deduplicate(empty(spark)).columns == empty(spark).columns


@pytest.mark.parametrize("letters", ["a", "ab", "aab", "abcdefgh"])
def test_suffix_array_and_common_prefixes(letters):
    r = random.Random(letters)
    for _ in range(150):
        t = []
        for _ in range(r.randint(1, 5)):
            t += [ord(r.choice(letters)) for _ in range(r.randint(1, 30))] + [0]
        number = {e: k for k, e in enumerate(i for i, c in enumerate(t) if c == 0)}
        want = sorted(range(len(t)), key=lambda i: [(t[k], number.get(k, 0)) for k in range(i, len(t))])
        a = np.array(t, dtype=np.uint8)
        assert suffix.suffix_array(a).tolist() == want
        common = [0] * len(t)
        for x, y in zip(want, want[1:]):
            while t[x + common[y]] == t[y + common[y]] and t[x + common[y]] != 0:
                common[y] += 1
        assert suffix.common_prefixes(a, np.array(want)).tolist() == common


def test_pieces_of_a_split_passage_meet_again(spark, monkeypatch):
    """A phrase in different surroundings: after the split its middle is the same bytes in 300 documents."""
    monkeypatch.setattr(substrings, "SPLIT", 3)
    r = random.Random(8)
    passage = "one long passage, shared by many documents, that is cut into several pieces by its anchors; " * 2
    more = [(3000 + i, "".join(r.choice("abcdefgh ") for _ in range(60)) + passage + "".join(r.choice("abcdefgh ") for _ in range(60))) for i in range(300)]
    assert listed(substrings.digest(documents(spark, more)), *COLUMNS) == brute(rows() + more)


def test_ranges_are_even():
    """Anchors are least values; their ranges still get about the same number of segments."""
    r = random.Random(9)
    texts = [bytes(r.randrange(97, 123) for _ in range(4000)) for _ in range(100)]
    import pandas as pd

    frame = pd.DataFrame({"doc_id": np.arange(100), "text": [t.decode() for t in texts]})
    sizes = np.zeros(64)
    for out in substrings._blocks(64)([frame]):
        for bucket, anchors in zip(out["bucket"], out["anchors"]):
            sizes[bucket] += len(anchors) // 8
    assert sizes.max() < 1.5 * sizes.mean() and sizes.min() > 0


def test_only_segments_that_share_a_string_are_sorted():
    import pandas as pd

    a, b = "x" * 10 + "the same fifty bytes are in both of these two texts....", "other words around the same phrase"
    pdf = pd.DataFrame({"doc_id": [1, 2, 3, 4], "bytes": [a.encode(), (a + "tail").encode(), (b + "1" * 30).encode(), (b + "2" * 30).encode()]})
    assert substrings._sharing(pdf).tolist() == [True, True, False, False]


def test_workers_hold_few_documents_at_a_time(spark, monkeypatch):
    """Texts reach the workers in small batches, and their hashes are made in small groups."""
    held, seen = [], {}
    plain = substrings.stored

    def noted(df, purpose, batch_rows=None):
        seen[purpose] = batch_rows
        return plain(df, purpose, batch_rows)

    monkeypatch.setattr(substrings, "stored", noted)
    out = substrings.digest(documents(spark))
    assert listed(out, *COLUMNS) == brute(rows())
    assert seen["anchors"] is not None and seen["anchors"] <= 1000
    for _, _, buf, _ in substrings.B.groups([b"x" * 1000] * 3000):
        held.append(len(buf))
    assert max(held) <= 1 << 19 and sum(held) == 3000 * 1001
