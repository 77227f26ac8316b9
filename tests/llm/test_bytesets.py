"""Hashes of spans."""

import numpy as np

from statloom.llm import bytesets as B
from statloom.llm import jaccard, sentence_spans
from tests.llm.helpers import documents


def thue_morse(n, flip=0):
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


def test_words_that_collide_in_powers_of_two_have_own_hashes():
    for n in (1024, 4096, 1 << 15):
        buf = np.frombuffer((thue_morse(n) + thue_morse(n, 1)).encode(), dtype=np.uint8)
        a, b = B.span_hashes(buf, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_equal_spans_have_equal_hashes_across_sum_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    buf = np.tile(rng.integers(0, 256, 700).astype(np.uint8), 9)
    whole = B.span_hashes(buf, np.arange(0, 5600, 7), np.arange(0, 5600, 7) + 300)
    monkeypatch.setattr(B, "_SUM_PLACES", 64)
    parts = B.span_hashes(buf, np.arange(0, 5600, 7), np.arange(0, 5600, 7) + 300)
    assert (whole == parts).all()
    assert (whole[:100] == whole[100:200]).all() and len(set(whole[:100].tolist())) == 100


def test_documents_that_differ_in_such_a_word_stay_apart(spark):
    a, b = thue_morse(1024), thue_morse(1024, 1)
    more = [(700, a), (701, b), (702, f"one two three. {a} x y z four five six seven eight nine ten."), (703, f"one two three. {b} x y z four five six seven eight nine ten.")]
    docs = documents(spark, more)
    found = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert [found[i] for i, _ in more[:2]] == [700, 701]
    kept = {r.doc_id: r.text for r in sentence_spans.deduplicate(docs).collect()}
    assert [kept[i] for i, _ in more] == [t for _, t in more]
