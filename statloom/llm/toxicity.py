"""Toxicity by a classifier chain.

Categories are predicted one after another. The linear model of a category reads the words of a document and the
probabilities of the categories before it. While fitting, those probabilities come from models that have not seen
the row (out of fold), so a later model learns how far earlier ones can be trusted on new rows.

Null and empty texts have no words and get the models' base rate, which never rejects them. Copies of a document get
the same probabilities. Null ids are kept. Labels that are null or belong to no document are ignored; without any
positive row a category has probability 0. Other columns of the documents are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import bytesets as B
from statloom.llm.registry import query, table

#: Seed words that give the toxic rows of ``labels`` their finer categories; the last category is the label itself.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "contempt": ("disgusting", "pathetic", "scum", "trash", "worthless"),
}
FINAL = "toxic"
FIT_ROWS = 6000
FOLDS = 5
FEATURES = 512
PREFIXES = (4, 5)


def _words(texts: list[bytes]):
    """``(document, hashes)`` of each group: whole words and their first bytes, lower case; a word is a run of letters
    or of bytes above ASCII."""
    for first, _, buf, starts in B.groups(texts):
        low = B.lower(buf)
        s, e = B.runs(((low >= 97) & (low <= 122)) | (low >= 128))
        doc = first + np.searchsorted(starts, s, side="right") - 1
        kinds = [B.span_hashes(low, s, e)]
        for n in PREFIXES:
            kinds.append(B.mix(B.span_hashes(low, s, np.minimum(e, s + n)) ^ B.U(n)))
        yield doc, kinds


def _seed_hashes(words) -> np.ndarray:
    return np.concatenate([h for _, kinds in _words([w.encode() for w in words]) for h in kinds[:1]])


def featurise(frames):
    """Distinct feature hashes of each labelled document, as little-endian unsigned 64-bit integers."""
    for pdf in frames:
        rows: list[list[np.ndarray]] = [[] for _ in range(len(pdf))]
        for doc, kinds in _words([B.as_bytes(t) for t in pdf["text"]]):
            cuts = np.searchsorted(doc, np.arange(doc[0], doc[-1] + 2)) if len(doc) else []
            for i in range(len(cuts) - 1):
                if cuts[i] < cuts[i + 1]:
                    rows[doc[0] + i].extend(k[cuts[i] : cuts[i + 1]] for k in kinds)
        yield pd.DataFrame({
            "key": pdf["key"], "toxic": pdf["toxic"],
            "features": [np.unique(np.concatenate(r)).tobytes() if r else b"" for r in rows],
        })


@dataclass(frozen=True)
class Linear:
    """Logistic regression over the presence of chosen features and over earlier probabilities."""

    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    chain: np.ndarray  # weights of the earlier categories
    bias: float

    def probability(self, scores: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = scores + self.bias + (earlier @ self.chain if len(self.chain) else 0.0)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    models: tuple[Linear, ...] = field(repr=False)


def _constant(p: float, n_earlier: int) -> Linear:
    empty = np.empty(0)
    return Linear(np.empty(0, np.uint64), empty, np.zeros(n_earlier), float(np.log(p / (1 - p))))


def _coded(rows: list[np.ndarray], at_a_time: int = 500) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct hashes and every row as places in them. Rows are taken in portions, so what is held beside
    the rows is their places and one portion."""
    names = np.empty(0, np.uint64)
    for k in range(0, len(rows), at_a_time):
        names = np.unique(np.concatenate([names, *rows[k : k + at_a_time]]))
    return names, [np.searchsorted(names, row).astype(np.int32) for row in rows]


def fit_linear(names: np.ndarray, rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> Linear:
    """``rows``: distinct places in ``names``. Features are chosen by chi-square on the rows given; weights by gradient
    steps with a momentum."""
    n, n_pos = len(y), int(y.sum())
    if n_pos == 0 or n_pos == n:
        return _constant(1e-9 if n_pos == 0 else 1 - 1e-9, earlier.shape[1])
    seen, hits = np.zeros(len(names)), np.zeros(len(names))
    for row, positive in zip(rows, y):
        seen[row] += 1
        if positive:
            hits[row] += 1
    expected = seen * n_pos / n
    spread = np.where((seen >= 2) & (seen < n), (hits - expected) ** 2 / np.maximum(expected * (1 - seen / n), 1e-9), 0.0)
    chosen = np.sort(np.argsort(-spread, kind="stable")[:FEATURES])
    chosen = chosen[spread[chosen] > 0]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + earlier.shape[1] + 1), dtype=np.float32)
    for i, row in enumerate(rows):
        at = place[row]
        x[i, at[at >= 0]] = 1.0
    x[:, len(chosen) : -1] = earlier
    x[:, -1] = 1.0
    # Both classes weigh the same; the bias is put back to the base rate of half afterwards, so 0.5 separates them.
    weight = np.where(y > 0, 0.5 / n_pos, 0.5 / (n - n_pos)).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    w[-1] = -2.0
    speed, cache = np.zeros_like(w), np.full_like(w, 1e-8)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((p - y).astype(np.float32) * weight) + penalty * np.r_[w[:-1], 0].astype(np.float32)
        cache = 0.98 * cache + 0.02 * slope**2
        speed = 0.9 * speed + 0.1 * slope / np.sqrt(cache)
        w = w - 0.1 * speed
    k = len(chosen)
    return Linear(names[chosen], w[:k].astype(float), w[k:-1].astype(float), float(w[-1]))


def _scores(model: Linear, names: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    weights = np.zeros(len(names))
    weights[np.searchsorted(names, model.features)] = model.weights
    return np.array([weights[row].sum() for row in rows])


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], keys: np.ndarray) -> Chain:
    """``rows``: sorted distinct feature hashes; ``labels``: 0/1 by category, in the order of the chain."""
    names, rows = _coded(rows)
    fold = (B.mix(keys.astype(np.uint64)) % B.U(FOLDS)).astype(int)
    earlier = np.empty((len(rows), 0))
    models = []
    for y in labels.values():
        out_of_fold = np.zeros(len(rows))
        for k in range(FOLDS):
            train, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = fit_linear(names, [rows[i] for i in train], y[train], earlier[train])
            out_of_fold[held] = model.probability(_scores(model, names, [rows[i] for i in held]), earlier[held])
        models.append(fit_linear(names, rows, y, earlier))
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(tuple(labels), tuple(models))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seeds: dict = SEEDS) -> Chain:
    """Fit on at most ``fit_rows`` labelled documents, drawn by a hash of their id; only these features reach the driver.
    Of several rows of one id, the one of the least feature hash counts."""
    drawn = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("key"), F.col("toxic").cast("int"))
    )
    texts = documents.select(F.col("doc_id").alias("key"), "text")
    # The drawn side has at most ``fit_rows`` rows of two numbers.
    sample = texts.join(F.broadcast(drawn), "key").mapInPandas(featurise, "key long, toxic int, features binary")
    one = F.min(F.struct(F.xxhash64("features"), "toxic", "features")).alias("one")
    pdf = sample.groupBy("key").agg(one).select("key", "one.toxic", "one.features").toPandas().sort_values("key", ignore_index=True)
    rows = [np.frombuffer(b, dtype=np.uint64) for b in pdf["features"]]
    toxic = pdf["toxic"].to_numpy(dtype=float) if len(pdf) else np.empty(0)
    named = {}
    for name, words in seeds.items():
        seed = _seed_hashes(words)
        named[name] = np.array([float(t > 0 and np.isin(seed, r).any()) for t, r in zip(toxic, rows)])
    named[FINAL] = (toxic > 0).astype(float)
    return fit_chain(rows, named, pdf["key"].to_numpy() if len(pdf) else np.empty(0, np.int64))


def _predictor(chain: Chain):
    features = np.unique(np.concatenate([m.features for m in chain.models] + [np.empty(0, np.uint64)]))
    weights = np.zeros((len(features), len(chain.models)))
    for j, m in enumerate(chain.models):
        weights[np.searchsorted(features, m.features), j] = m.weights

    def probabilities(texts: list[bytes]) -> np.ndarray:
        z = np.zeros((len(texts), len(chain.models)))
        for doc, kinds in _words(texts) if len(features) else ():
            # A feature counts once for a document: only the few known features are kept and made distinct.
            found, owner = [], []
            for h in kinds:
                at = np.minimum(np.searchsorted(features, h), len(features) - 1)
                hit = np.flatnonzero(features[at] == h)
                found.append(at[hit])
                owner.append(doc[hit])
            once = np.unique(np.concatenate(owner) * len(features) + np.concatenate(found))
            for j in range(z.shape[1]):
                z[:, j] += np.bincount(once // len(features), weights=weights[once % len(features), j], minlength=len(texts))
        p = np.empty((len(texts), 0))
        for j, m in enumerate(chain.models):
            p = np.column_stack([p, m.probability(z[:, j], p)])
        return p

    return probabilities


def predict(documents: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, one probability for each category (``p_<name>``) and ``toxic``, the decision, for every row."""
    probabilities = _predictor(chain)
    names = chain.names

    def score(frames):
        for pdf in frames:
            p = probabilities([B.as_bytes(t) for t in pdf["text"]])
            out = {"doc_id": pdf["doc_id"].astype("Int64")} | {f"p_{n}": p[:, j] for j, n in enumerate(names)}
            yield pd.DataFrame(out | {"toxic": p[:, -1] >= 0.5})

    columns = ", ".join(f"p_{n} double" for n in names)
    return documents.select("doc_id", "text").mapInPandas(score, f"doc_id long, {columns}, toxic boolean")


def keep_clean(documents: DataFrame, chain: Chain) -> DataFrame:
    """The documents that the chain doesn't reject, with all their columns; one narrow pass."""
    probabilities = _predictor(chain)

    def keep(batches):
        for batch in batches:
            p = probabilities([B.as_bytes(t) for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(p[:, -1] < 0.5))

    return documents.mapInArrow(keep, documents.schema)


@query("op1_toxicity_chain")
def toxicity_chain(spark, folder):
    """Every document with the probabilities of the chain fitted on ``labels`` and its decision."""
    documents = table(spark, folder, "documents")
    return predict(documents, fit(documents, table(spark, folder, "labels")))
