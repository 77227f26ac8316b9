import random

import numpy as np

from statloom.llm import toxicity
from tests.llm.helpers import clashing, documents, empty, prose, rows

LABELS = "doc_id long, quality int, toxic int"


def labelled(seed, n=240):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(seed * 1000 + i, 40)
        if bad:
            text = text.replace(" ", f" {r.choice(['idiot', 'scum', 'worthless', 'grumbleword'])} ", 2)
        docs.append((3000 + i, text))
        labels.append((3000 + i, 1, int(bad)))
    return docs, labels


def test_held_out_rows_are_caught_and_clean_rows_stay(spark):
    docs, labels = labelled(1)
    chain = toxicity.fit(documents(spark, docs), spark.createDataFrame(labels[:160] + [(None, 1, 1), (1, 1, None), (99999, 1, 1)], LABELS))
    got = {r.doc_id: r.toxic for r in toxicity.predict(clashing(documents(spark, docs)), chain).collect() if r.doc_id is not None}
    wrong = sum(got[i] != bool(t) for i, _, t in labels[160:])
    assert wrong <= 2
    assert not any(got[r[0]] for r in rows() if r[0] is not None)
    assert chain.names == ("insult", "contempt", "toxic") and len(chain.models[2].chain) == 2


def test_every_row_is_scored_and_copies_agree(spark):
    docs, labels = labelled(2, 80)
    chain = toxicity.fit(documents(spark, docs), spark.createDataFrame(labels, LABELS))
    out = toxicity.predict(documents(spark, docs + docs[:3]), chain).toPandas()
    assert len(out) == len(rows()) + len(docs) + 3
    assert (out[out["doc_id"].isin([d for d, _ in docs[:3]])].groupby("doc_id")["p_toxic"].nunique() == 1).all()
    kept = toxicity.keep_clean(documents(spark, docs), chain)
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(rows()) + sum(not t for _, _, t in labels)


def test_without_labels_nothing_is_rejected(spark):
    chain = toxicity.fit(documents(spark), spark.createDataFrame([], LABELS))
    assert toxicity.keep_clean(documents(spark), chain).count() == len(rows())
    assert toxicity.predict(empty(spark), chain).count() == 0


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(0)
    features = [np.unique(r.integers(0, 50, 8).astype(np.uint64)) for _ in range(400)]
    first = np.array([float(3 in f) for f in features])
    chain = toxicity.fit_chain(features, {"a": first, "b": first}, np.arange(400))
    assert chain.models[1].chain[0] > 0.5
