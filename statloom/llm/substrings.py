"""Exact substring deduplication with suffix arrays over shards.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id; strings are
judged on the input. The work is split so that equal strings always meet and most text never moves:

1. Every string of ``LENGTH`` bytes has an anchor, the grain of ``GRAIN`` bytes with the least hash inside it. Equal
   strings have equal anchors. A segment is the bytes of neighbouring strings with one anchor. Each task sends anchor,
   hash of the segment and smallest document, in blocks by hash range; equal segments of a task are sent once. A range
   finds the anchors that lie in two documents or more. Equal segments are pre-aggregated: all but the one of the
   smallest document are answered as covered.
2. That one document cuts the segment out and sends its bytes to a shard by anchor. Segments of an anchor with many
   different surroundings are cut further by a second anchor, so that frequent phrases are spread; equal pieces are
   aggregated once more.
3. A shard leaves out segments that share only their anchor, no string, sorts the suffixes of the others (induced sorting) and computes permuted common prefixes; runs
   of the order with ``LENGTH`` bytes in common are equal strings, and each gets its smallest document.
4. Answers return to their documents, which drop the bytes of strings that a smaller document has.

Documents whose whole text a smaller document has skip 2 to 4. Null texts are empty; a document shorter than ``LENGTH``
bytes loses nothing. A null id is neither smaller nor larger than another: such rows keep everything. Rows with one id
are judged each for itself against smaller ids. Every input row gives one row. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import bytesets as B
from statloom.llm import suffix
from statloom.llm.exchange import PORTION, cuts_of, number_of_ranges, spark_hash, together
from statloom.llm.registry import query, table, unused
from statloom.llm.storage import stored

LENGTH = 50
GRAIN = 16
#: Expected size of one group of work. They set how many groups there are, never what a group may hold.
CHUNK_BYTES = 6_000_000
SHARD_BYTES = 3_000_000
#: Documents that a Python worker holds at a time.
BATCH_ROWS = 1000
#: An anchor with so many different segments is split by a second anchor.
SPLIT = 500

def _grain_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAIN`` (a power of two) bytes from every place."""
    h = buf.astype(np.uint64) + B.U(0x9E37)
    span = 1
    while span < GRAIN:
        left = h[:-span] * B.U(0xD6E8FEB86659FD93 + 2 * span)
        left ^= left >> B.U(29)
        left *= B.U(0xA0761D6478BD642F)
        left += h[span:]
        h, span = left, 2 * span
    return B.mix(h)


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """Least value of each window of so many neighbours."""
    span = 1
    while 2 * span <= window:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = window - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _strings(buf: np.ndarray, starts: np.ndarray, second: bool = False):
    """For the group's strings of ``LENGTH`` bytes inside one document: anchor of each place and which places count."""
    size = len(buf) - LENGTH + 1
    if size <= 0:
        return None
    h = _grain_hashes(buf)
    anchors = _least(h, LENGTH - GRAIN + 1)[:size]
    counts = np.zeros(size, dtype=bool)
    edge = np.zeros(len(buf) + 1, dtype=np.int32)
    first, last = starts[:-1], starts[1:] - 1 - LENGTH + 1  # the line feed after a document is not part of it
    some = last > first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    counts = np.cumsum(edge[:size]) > 0
    return anchors, (_least(B.mix(h ^ B.U(0x5BD1E995)), LENGTH - GRAIN + 1)[:size] if second else None), counts


def _segments(anchors: np.ndarray, counts: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of places of each run of one anchor."""
    new = counts.copy()
    same = anchors[1:] == anchors[:-1]
    if also is not None:
        same &= also[1:] == also[:-1]
    new[1:] &= ~(same & counts[:-1])
    begin = np.flatnonzero(new)
    stop = counts & ~np.append(counts[1:] & ~new[1:], False)
    return begin, np.flatnonzero(stop) - begin + 1


_BLOCK = "bucket int, docs binary, anchors binary, contents binary, status binary"
_ANSWER = "chunk int, docs binary, contents binary, status binary"
#: Of a sent segment: alone in its batch, or not. Of an answer: a smaller document has all of it, or its one document
#: must cut it out, as it is or split.
_ALONE, _SHARED, _COVERED, _CUT, _SPLIT = range(5)


def _blocks(ranges: int):
    """Segments of a batch of documents by range of the anchor. Of equal segments the smallest document is sent; for
    the others the answer is known."""
    shift = B.U(64 - ranges.bit_length() + 1)

    def sent(parts):
        h, c, d, new = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        shared = np.append(new[1:], True)[new] == False  # noqa: E712
        later = ~new
        rows = []
        if later.any():
            spread = int(B.mix(d[:1].view(np.uint64))[0] % B.U(ranges))
            rows.append((spread, d[later].tobytes(), b"", c[later].tobytes(), np.full(int(later.sum()), _COVERED, np.uint8).tobytes()))
        h, c, d, status = h[new], c[new], d[new], np.where(shared, _SHARED, _ALONE).astype(np.uint8)
        # An anchor is the least of many hashes; mixed again, anchors are even over the ranges.
        bucket = (B.mix(h) >> shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, c, d, status, bucket = h[order], c[order], d[order], status[order], bucket[order]
        cuts = cuts_of(bucket)
        rows += [(int(bucket[a]), d[a:b].tobytes(), h[a:b].tobytes(), c[a:b].tobytes(), status[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame(rows, columns=["bucket", "docs", "anchors", "contents", "status"])

    def run(frames):
        for pdf in frames:
            docs = pdf["doc_id"].to_numpy(dtype=np.int64)
            parts, size = [], 0
            for first, _, buf, starts in B.groups([B.as_bytes(t) for t in pdf["text"]]):
                found = _strings(buf, starts)
                if found is not None:
                    begin, places = _segments(found[0], found[2])
                    content = B.span_hashes(buf, begin, begin + places + LENGTH - 1)
                    parts.append((found[0][begin], content, docs[first + np.searchsorted(starts, begin, side="right") - 1]))
                    size += len(begin)
                if size >= PORTION:
                    yield sent(parts)
                    parts, size = [], 0
            if size:
                yield sent(parts)

    return run


def _distinct(h, c, d, *more):
    """Sorted distinct triples and which are the first of their anchor and content."""
    order = np.lexsort((d, c, h))
    h, c, d, *more = (x[order] for x in (h, c, d, *more))
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    once = np.append(True, ~(same & (d[1:] == d[:-1])))
    new = np.append(True, ~same)
    return *(x[once] for x in (h, c, d)), new[once], *(x[once] for x in more)


def _answers(chunks: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = pdf["anchors"].str.len().to_numpy() > 0
        kinds = (("anchors", np.uint64), ("contents", np.uint64), ("docs", np.int64), ("status", np.uint8))
        h, c, d, s = (together(pdf.loc[sent, n], t) for n, t in kinds)
        if len(h):
            h, c, d, new, s = _distinct(h, c, d, s)
            cuts = cuts_of(h)
            first, many = cuts[:-1], np.diff(cuts)
            contents = np.add.reduceat(new.astype(np.int64), first)
            repeated = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | (np.maximum.reduceat(s, first) > 0)
            # An anchor's only segment has nothing to be compared with, besides its equals.
            cut = np.repeat(np.where(contents >= SPLIT, _SPLIT, np.where(contents > 1, _CUT, _ALONE)), many)
            answer = np.where(new, cut, _COVERED).astype(np.uint8)
            keep = np.repeat(repeated, many) & (answer != _ALONE)
            c, d, s = c[keep], d[keep], answer[keep]
        c, d, s = (np.concatenate([x, together(pdf.loc[~sent, n], t)]) for x, (n, t) in zip((c, d, s), kinds[1:]))
        chunk = np.mod(spark_hash(d), chunks)
        order = np.argsort(chunk, kind="stable")
        c, d, s, chunk = c[order], d[order], s[order], chunk[order]
        cuts = cuts_of(chunk)
        rows = [(int(chunk[a]), d[a:b].tobytes(), c[a:b].tobytes(), s[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame(rows, columns=["chunk", "docs", "contents", "status"])

    return run


_SEGMENT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("places", pa.int32()), ("anchor", pa.int64()), ("split", pa.bool_()), ("bytes", pa.binary())])
_SEGMENT_COLUMNS = "doc_id long, text_key long, start int, places int, anchor long, split boolean, bytes binary"


def _named(doc: np.ndarray, content: np.ndarray) -> np.ndarray:
    return B.mix(content ^ B.mix(doc.view(np.uint64) + B.U(1)))


def _cut(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """Of one chunk of documents: covered runs (without bytes) and the segments to be sorted, with their bytes."""
    kinds = (("docs", np.int64), ("contents", np.uint64), ("status", np.uint8))
    d, c, s = (together((v for v in answers[n].to_pylist() if v is not None), t) for n, t in kinds)
    copies = {(i, k) for i, k in zip(answers["doc_id"].to_pylist(), answers["text_key"].to_pylist()) if i is not None}
    known = _named(d, c)
    order = np.lexsort((-s.astype(np.int64), known))  # of two answers to one document the one that asks for more
    known, s = known[order], s[order]
    with_any = set(np.unique(d).tolist())
    ids, texts, keys = documents["doc_id"].to_pylist(), documents["text"].to_pylist(), documents["text_key"].to_pylist()
    rows = [i for i, doc in enumerate(ids) if doc in with_any and (doc, keys[i]) not in copies]
    parts, held = [], []
    for first, _, buf, starts in B.groups([B.as_bytes(texts[i]) for i in rows]):
        found = _strings(buf, starts, second=True)
        if found is None:
            continue
        anchors, seconds, counts = found
        begin, places = _segments(anchors, counts)
        local = np.searchsorted(starts, begin, side="right") - 1
        row = np.array(rows[first : first + len(starts) - 1])[local]
        doc = np.array([ids[i] for i in rows[first : first + len(starts) - 1]], dtype=np.int64)[local]
        name = _named(doc, B.span_hashes(buf, begin, begin + places + LENGTH - 1))
        at = np.minimum(np.searchsorted(known, name), len(known) - 1)
        status = np.where(known[at] == name, s[at], _ALONE)
        covered = np.flatnonzero(status == _COVERED)
        if len(covered):
            b, n = begin[covered], places[covered]
            apart = np.append(True, (b[1:] != b[:-1] + n[:-1]) | (row[covered][1:] != row[covered][:-1]))
            head = np.flatnonzero(apart)
            parts.append((row[covered][head], b[head] - starts[local[covered][head]], np.add.reduceat(n, head), np.zeros(len(head), np.uint64), np.zeros(len(head), bool)))
            held.extend([None] * len(head))
        raw = buf.tobytes()
        whole = status == _CUT
        name, split = anchors[begin], np.zeros(int(whole.sum()), dtype=bool)
        if (status == _SPLIT).any():
            inside = np.zeros(len(anchors), dtype=bool)
            for b, n in zip(begin[status == _SPLIT].tolist(), places[status == _SPLIT].tolist()):
                inside[b : b + n] = True
            b, n = _segments(anchors, inside, seconds)
            k = np.searchsorted(begin, b, side="right") - 1
            again = B.mix(anchors[b] ^ (seconds[b] << B.U(1)))
            begin, places, name = np.concatenate([begin[whole], b]), np.concatenate([places[whole], n]), np.concatenate([name[whole], again])
            row, local = np.concatenate([row[whole], row[k]]), np.concatenate([local[whole], local[k]])
            split = np.append(split, np.ones(len(b), dtype=bool))
        else:
            begin, places, name, row, local = begin[whole], places[whole], name[whole], row[whole], local[whole]
        parts.append((row, begin - starts[local], places, name, split))
        held.extend(raw[b : b + n + LENGTH - 1] for b, n in zip(begin.tolist(), places.tolist()))
    if not parts:
        return _SEGMENT.empty_table()
    row, start, places, name, split = (np.concatenate(x) for x in zip(*parts))
    doc, key = np.array([-1 if i is None else i for i in ids], dtype=np.int64)[row], np.array(keys, dtype=np.int64)[row]
    columns = [doc, key, start.astype(np.int32), places.astype(np.int32), name.astype(np.uint64).view(np.int64), split]
    return pa.Table.from_arrays([*map(pa.array, columns), pa.array(held, pa.binary())], schema=_SEGMENT)


_FIRST = "doc_id long, text_key long, start int, places int, firsts binary"


def _windows(t: np.ndarray) -> np.ndarray:
    """Hash of the ``LENGTH`` bytes from every place."""
    h, made, at = t.astype(np.uint64), None, 0
    for bit in range(LENGTH.bit_length()):
        if LENGTH >> bit & 1:
            rest = h[at : len(t) - LENGTH + 1 + at]
            made = rest if made is None else B.mix(made * B.U(0xD6E8FEB86659FD93)) + rest
            at += 1 << bit
        h = B.mix(h[: -(1 << bit)] * B.U(0xA0761D6478BD642F) + h[1 << bit :]) if len(h) > 1 << bit else h[:0]
    return made


def _joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments as one text for the suffix array, their sizes and where they begin. Bytes move up by one, so that 0
    is the end of a segment; UTF-8 has no byte 0xFE or 0xFF."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    t = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8) + np.uint8(1)
    return t, sizes, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])


def _sharing(pdf: pd.DataFrame) -> np.ndarray:
    """Which segments have a string whose hash another document's segment of the shard has too. Segments without one
    meet only by a common anchor and need no place in the order."""
    t, sizes, begins = _joined(pdf["bytes"].tolist())
    valid = np.zeros(len(t) + 1, dtype=np.int8)
    np.add.at(valid, begins, 1)
    np.add.at(valid, begins + sizes - LENGTH + 1, -1)
    places = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    h = _windows(t)[places]
    segment = np.searchsorted(begins, places, side="right") - 1
    order = np.argsort(h)
    h, segment = h[order], segment[order]
    owner = pdf["doc_id"].to_numpy(dtype=np.int64)[segment]
    cuts = cuts_of(h)
    several = np.minimum.reduceat(owner, cuts[:-1]) != np.maximum.reduceat(owner, cuts[:-1])
    keep = np.zeros(len(sizes), dtype=bool)
    keep[segment[np.repeat(several, np.diff(cuts))]] = True
    return keep


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """The smallest document of each string of a shard's segments, for segments that have a string of a smaller one."""
    pdf = pdf[_sharing(pdf)]
    segments = pdf["bytes"].tolist()
    if not segments:
        return pdf[["doc_id", "text_key", "start", "places"]].assign(firsts=[])
    t, sizes, begins = _joined(segments)
    order = suffix.suffix_array(t)
    common = suffix.common_prefixes(t, order)
    docs = pdf["doc_id"].to_numpy(dtype=np.int64)
    owner = np.repeat(docs, sizes + 1)
    group = np.flatnonzero(np.append(True, common[order[1:]] < LENGTH))
    least = np.minimum.reduceat(owner[order], group)
    first = np.empty(len(t), dtype=np.int64)
    first[order] = np.repeat(least, np.diff(np.append(group, len(t))))
    firsts, kept = [], []
    for i, (b, n, doc) in enumerate(zip(begins.tolist(), sizes.tolist(), docs.tolist())):
        own = first[b : b + n - LENGTH + 1]
        if (own < doc).any():
            kept.append(i)
            firsts.append(own.tobytes())
    return pdf.iloc[kept][["doc_id", "text_key", "start", "places"]].assign(firsts=firsts)


_DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _drop(kept_text: bool, schema: pa.Schema, id_name: str, key_name: str):
    """Rows of one chunk with what stays of their text, or with the digest of it."""

    def run(documents: pa.Table, found: pa.Table) -> pa.Table:
        marks: dict[tuple, list] = {}
        for doc, key, start, places, firsts in zip(*(found[c].to_pylist() for c in ("doc_id", "text_key", "start", "places", "firsts"))):
            marks.setdefault((doc, key), []).append((start, places, firsts))
        texts, rows = [], []
        for doc, key, text in zip(*(documents[c].to_pylist() for c in (id_name, key_name, "text"))):
            raw = B.as_bytes(text)
            spans = removed_spans(doc, len(raw), marks[doc, key]) if (doc, key) in marks else []
            ends = [0, *(e for _, e in spans)]
            kept = b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(raw)])) if spans else raw
            if kept_text:
                # A cut inside a character leaves bytes that are no character; they go.
                texts.append(text if not spans else kept.decode("utf-8", "ignore"))
            else:
                rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        if not kept_text:
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()
        out = documents.select(schema.names).set_column(schema.names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in schema.names:
            sizes = [n if a == b else len(b) for n, a, b in zip(documents["n_chars"].to_pylist(), documents["text"].to_pylist(), texts)]
            out = out.set_column(schema.names.index("n_chars"), "n_chars", pa.array(sizes, schema.field("n_chars").type))
        return out.cast(schema)

    return run


def removed_spans(doc: int, size: int, marks: list[tuple]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings whose smallest document is below ``doc``. A mark without a start says
    that a smaller document has the whole text; one without firsts, that it has all the places."""
    if any(start is None for start, _, _ in marks):
        return [(0, size)] if size >= LENGTH else []
    edge = np.zeros(size + 1, dtype=np.int32)
    for start, places, firsts in marks:
        if firsts is None:
            edge[start] += 1
            edge[start + places + LENGTH - 1] -= 1
        else:
            at = start + np.flatnonzero(np.frombuffer(firsts, dtype=np.int64) < doc)
            edge[at] += 1
            edge[at + LENGTH] -= 1
    s, e = B.runs(np.cumsum(edge[:size]) > 0)
    return list(zip(s.tolist(), e.tolist()))


def _prepared(documents: DataFrame):
    """What both forms share: the found strings by document, the chunk of a document and their number."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(text)
    sizes = stored(documents.select("doc_id", key.alias("text_key"), F.md5(text).alias("md5"), F.octet_length(text).alias("n_bytes")), "texts")
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]  # one number
    least = 2 * spark.sparkContext.defaultParallelism
    chunks, shards = max(least, -(-total // CHUNK_BYTES)), max(least, -(-total // SHARD_BYTES))
    whole = sizes.filter(f"doc_id IS NOT NULL AND n_bytes >= {LENGTH}")
    firsts = whole.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stored(whole.join(firsts, "md5").filter("doc_id > first").select("doc_id", "text_key").distinct(), "copies")

    def chunk(doc, other):
        return F.pmod(F.when(doc.isNotNull(), F.hash(doc)).otherwise(F.hash(other)), F.lit(int(chunks))).cast("int")

    named = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    doc = F.col("doc_id")
    ranges = number_of_ranges(total / 18)  # about one anchor in 18 bytes
    answers = named.mapInPandas(_blocks(ranges), _BLOCK).groupBy("bucket").applyInPandas(_answers(int(chunks)), _ANSWER)
    answers = stored(answers.unionByName(copies.withColumn("chunk", chunk(doc, doc)), allowMissingColumns=True), "anchors", BATCH_ROWS)
    texts = named.withColumn("text_key", key).withColumn("chunk", chunk(doc, doc))
    segments = stored(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut, _SEGMENT_COLUMNS), "segments")
    shard = F.pmod(F.hash("anchor"), F.lit(int(shards)))
    # Pieces of one anchor are often the same bytes in many documents: only those of the smallest one are sorted.
    split = segments.filter("split AND bytes IS NOT NULL").withColumn("content", F.md5("bytes"))
    least = stored(split.groupBy("anchor", "content").agg(F.min("doc_id").alias("least")), "pieces")
    split = split.join(least, ["anchor", "content"])
    again = split.filter("doc_id > least").select("doc_id", "text_key", "start", "places")
    sorted_here = segments.filter("NOT split AND bytes IS NOT NULL").unionByName(split.filter("doc_id = least").select(*segments.columns))
    found = sorted_here.withColumn("shard", shard).groupBy("shard").applyInPandas(_shard, _FIRST)
    covered = segments.filter("bytes IS NULL").select("doc_id", "text_key", "start", "places").unionByName(again)
    found = found.unionByName(covered, allowMissingColumns=True)
    found = found.unionByName(copies, allowMissingColumns=True)
    return found.withColumn("chunk", chunk(doc, doc)), chunk, key


def _applied(documents: DataFrame, columns: list[str], kept_text: bool, schema: pa.Schema, spark_schema) -> DataFrame:
    found, chunk, key = _prepared(documents)
    doc = F.col("doc_id").cast("long")
    i, k, c = unused(documents, "__doc", "__key", "__chunk")
    texts = documents.select(*columns, doc.alias(i), key.alias(k), chunk(doc, F.xxhash64("text")).alias(c))
    return texts.groupBy(c).cogroup(found.groupBy("chunk")).applyInArrow(_drop(kept_text, schema, i, k), spark_schema)


def digest(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` for every row."""
    types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    return _applied(documents, ["text"], False, pa.schema(types), "doc_id long, " + _DIGEST)


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents without the repeated bytes; rows and columns stay, ``n_chars`` follows the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return _applied(documents, documents.columns, True, to_arrow_schema(documents.schema), documents.schema)


@query("op2_suffix_array_dedup")
def suffix_array_dedup(spark, folder):
    """Repeated strings of 50 bytes in all documents."""
    return digest(table(spark, folder, "documents"))
