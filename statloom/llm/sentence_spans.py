"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences: up to a full stop, mark, comma, semicolon or colon before white space, or to the end of a
line. From every sentence starts one run: the shortest of at least ``SENTENCES`` consecutive sentences with
``WORDS`` words. Runs are hashed and compared among all documents; a run is first in the smallest document that has it,
and there at its first place. Sentences covered by any other occurrence go, with the white space after them.

Null ids neither give nor take: such rows keep everything. Null and empty texts have no sentences. Rows with one id are
compared with smaller ids and each with itself. Repeated rows of one id therefore stay. Every row gives one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import bytesets as B
from statloom.llm.exchange import later, together
from statloom.llm.registry import query, table, unused
from statloom.llm.storage import stored

SENTENCES = 2
WORDS = 12
CHUNK_BYTES = 6_000_000
_BASE = 0x9E3779B97F4A7C15
_MARKS = np.isin(np.arange(256), list(b".!?,;:"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _powers(n: int, step: int) -> np.ndarray:
    """Powers modulo 2 ** 64; enough for runs, which have few sentences."""
    out = np.full(n, B.U(step))
    out[0] = 1
    return np.multiply.accumulate(out)


def sentences(buf: np.ndarray, starts: np.ndarray):
    """``(document, begin, end, next)`` of each sentence of a group; ``next`` is where the following one begins."""
    space = _SPACE[buf]
    end = np.flatnonzero((_MARKS[buf] & np.append(space[1:], True)) | (buf == 10))
    solid = np.flatnonzero(~space)
    if not len(solid):
        none = np.empty(0, np.int64)
        return none, none, none, none
    after = np.searchsorted(solid, np.concatenate([[0], end[:-1] + 1]))
    last = np.searchsorted(solid, end, side="right") - 1
    real = after <= last
    begin, stop = solid[after[real]], solid[last[real]] + 1
    doc = np.searchsorted(starts, begin, side="right") - 1
    following = np.append(begin[1:], len(buf))
    return doc, begin, stop, np.minimum(following, starts[doc + 1] - 1)


def spans(buf: np.ndarray, starts: np.ndarray):
    """Sentences, and for each that starts a run its last sentence and the run's hash."""
    doc, begin, stop, following = sentences(buf, starts)
    if not len(doc):
        return doc, begin, stop, following, doc, doc, np.empty(0, np.uint64)
    solid = ~_SPACE[buf]
    words = np.concatenate([[0], np.cumsum(solid & ~np.concatenate([[False], solid[:-1]]))])
    before = words[begin]
    total = np.append(before[1:], words[-1])  # words up to the end of each sentence
    last = np.maximum(np.searchsorted(total, before + WORDS), np.arange(len(doc)) + SENTENCES - 1)
    first = np.flatnonzero((last < len(doc)) & (doc[np.minimum(last, len(doc) - 1)] == doc))
    last = last[first]
    up, down = _powers(len(doc) + 1, _BASE), _powers(len(doc) + 1, pow(_BASE, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.span_hashes(buf, begin, stop) * up[: len(doc)])])
    return doc, begin, stop, following, first, last, B.mix((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def _hashes(pdf: pd.DataFrame):
    docs = pdf["doc_id"].to_numpy(dtype=np.int64)
    for at, _, buf, starts in B.groups([B.as_bytes(t) for t in pdf["text"]]):
        doc, _, _, _, first, _, h = spans(buf, starts)
        yield h, docs[at + doc[first]]


def _name(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return B.mix(h ^ B.mix(doc.view(np.uint64) + B.U(1)))


def _drop(kept_text: bool, schema: pa.Schema, id_name: str):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.unique(_name(together(answers["keys"].to_pylist(), np.int64), together(answers["hashes"].to_pylist(), np.uint64)))
        ids, texts = documents[id_name].to_pylist(), documents["text"].to_pylist()
        out, rows = list(texts), []
        for at, end, buf, starts in B.groups([B.as_bytes(t) for t in texts]):
            doc, begin, stop, following, first, last, h = spans(buf, starts)
            named = np.array([i is not None for i in ids[at:end]], dtype=bool)
            own = np.array([0 if i is None else i for i in ids[at:end]], dtype=np.int64)
            name = _name(own[doc[first]], h)
            hit = np.zeros(len(name), dtype=bool)
            if len(known) and len(name):
                hit = known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name
            if len(name):
                # Inside a document every occurrence of a run after its first counts, too.
                order = np.lexsort((first, h, doc[first]))
                d, v = doc[first][order], h[order]
                hit[order[1:][(d[1:] == d[:-1]) & (v[1:] == v[:-1])]] = True
                hit &= named[doc[first]]
            edge = np.zeros(len(doc) + 1, dtype=np.int64)
            np.add.at(edge, first[hit], 1)
            np.add.at(edge, last[hit] + 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            raw = buf.tobytes()
            cut = np.searchsorted(doc, np.arange(end - at + 1))
            for i in range(end - at):
                a, b = int(cut[i]), int(cut[i + 1])
                whole = raw[starts[i] : starts[i + 1] - 1]
                mine = gone[a:b]
                s, e = B.runs(mine)
                kept, place = [], int(starts[i])
                for x, y in zip(s.tolist(), e.tolist()):
                    kept.append(raw[place : int(begin[a + x])])
                    place = int(following[a + y - 1])
                kept = b"".join([*kept, raw[place : starts[i + 1] - 1]]) if len(s) else whole
                if kept_text:
                    out[at + i] = texts[at + i] if not len(s) else kept.decode("utf-8", "ignore")
                else:
                    rows.append((ids[at + i], b - a, int(mine.sum()), len(s), hashlib.sha256(kept).hexdigest()))
        if not kept_text:
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()
        return documents.select(schema.names).set_column(schema.names.index("text"), "text", pa.array(out, pa.string())).cast(schema)

    return run


def _applied(documents: DataFrame, columns: list[str], kept_text: bool, schema: pa.Schema, spark_schema) -> DataFrame:
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(2 * documents.sparkSession.sparkContext.defaultParallelism, -(-total // CHUNK_BYTES))
    named = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    answers = stored(later(named, _hashes, total / 45, chunks), "runs")  # about one run in 45 bytes
    doc = F.col("doc_id").cast("long")
    chunk = F.pmod(F.when(doc.isNotNull(), F.hash(doc)).otherwise(F.hash("text")), F.lit(int(chunks))).cast("int")
    i, c = unused(documents, "__doc", "__chunk")
    texts = documents.select(*columns, doc.alias(i), chunk.alias(c))
    return texts.groupBy(c).cogroup(answers.groupBy("chunk")).applyInArrow(_drop(kept_text, schema, i), spark_schema)


def digest(documents: DataFrame) -> DataFrame:
    """``doc_id``, numbers of sentences, of removed ones and of removed spans, SHA-256 of what stays."""
    types = [("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    columns = "doc_id long, n_sentences long, n_removed long, n_spans long, kept_sha256 string"
    return _applied(documents, ["text"], False, pa.schema(types), columns)


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents without the repeated sentences; rows and columns stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return _applied(documents, documents.columns, True, to_arrow_schema(documents.schema), documents.schema)


@query("op8_sentence_spans")
def sentence_spans(spark, folder):
    """Repeated spans of sentences in all documents."""
    return digest(table(spark, folder, "documents"))
