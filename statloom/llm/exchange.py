"""Which hashes occur under two or more keys? Blocks of numbers instead of rows.

Each task sorts the (hash, key) pairs of a batch and sends them as one block per hash range; a range answers with one
block per chunk of keys, holding only hashes that occur under several keys and a class that grows with how many.
A hash that is hot within one batch is answered there and sent once, so no range ever gets all entries of a hot hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from statloom.llm import bytesets as B

BLOCK = "bucket int, keys binary, hashes binary, classes binary, ready boolean"
ANSWER = "chunk int, keys binary, hashes binary, classes binary"
#: A hash of so many keys in one portion is hot there.
BATCH_HOT = 200
#: Pairs that a task sorts and sends at a time.
PORTION = 1 << 19
#: Class of hashes that were hot in some batch; others have the bit length of their number of keys.
TOP = 255
#: Expected entries of a range. It sets how many ranges there are, never what one may hold.
RANGE_ENTRIES = 250_000


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's ``hash`` of a long column (Murmur3, 32 bits, seed 42), so that blocks can name the chunk of a key."""
    u = np.uint32

    def turn(v, k):
        return (v << u(k)) | (v >> u(32 - k))

    x = x.astype(np.int64).view(np.uint64)
    h = np.full(len(x), 42, dtype=u)
    for part in ((x & B.U(0xFFFFFFFF)).astype(u), (x >> B.U(32)).astype(u)):
        h = turn(h ^ (turn(part * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def number_of_ranges(entries: float) -> int:
    """A power of two."""
    return 1 << max(4, int(entries / RANGE_ENTRIES).bit_length())


def together(parts: Iterable[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=kind)


def cuts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def _portions(produce: Callable, pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (hash, key) pairs of a frame by hash and key, some ``PORTION`` at a time, however large the frame is."""
    held, size = [], 0

    def distinct():
        h, k = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        once = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))
        return h[once], k[once]

    for h, k in produce(pdf):
        if len(h):
            held.append((h, k))
            size += len(h)
        if size >= PORTION:
            yield distinct()
            held, size = [], 0
    if held:
        yield distinct()


def _frame(rows) -> pd.DataFrame:
    rows = [(a, k.tobytes(), h.tobytes(), c.tobytes(), ready) for a, k, h, c, ready in rows]
    return pd.DataFrame(rows, columns=["bucket", "keys", "hashes", "classes", "ready"])


def _blocks(produce: Callable, ranges: int):
    shift = B.U(64 - ranges.bit_length() + 1)

    def run(frames) -> Iterator[pd.DataFrame]:
        for h, k in (p for pdf in frames for p in _portions(produce, pdf)):
            cuts = cuts_of(h)
            many = np.diff(cuts)
            hot = np.repeat(many >= BATCH_HOT, many)
            if hot.any():
                spread = int(B.mix(k[:1].view(np.uint64))[0] % B.U(ranges))
                yield _frame([(spread, k[hot], h[hot], np.full(int(hot.sum()), TOP, np.uint8), True)])
                keep = ~hot
                keep[cuts[:-1][many >= BATCH_HOT]] = True
                h, k, hot = h[keep], k[keep], hot[keep]
            bucket = (h >> shift).astype(np.int64)
            classes = np.where(hot, TOP, 0).astype(np.uint8)
            cuts = cuts_of(bucket)
            yield _frame([(int(bucket[a]), k[a:b], h[a:b], classes[a:b], False) for a, b in zip(cuts[:-1], cuts[1:])])

    return run


def _answers(chunks: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf["ready"].to_numpy(dtype=bool)
        kinds = (("keys", np.int64), ("hashes", np.uint64), ("classes", np.uint8))
        k, h, c = (together(pdf.loc[~ready, n], t) for n, t in kinds)
        if len(h):
            order = np.argsort(h, kind="stable")
            k, h, c = k[order], h[order], c[order]
            cuts = cuts_of(h)
            many, first = np.diff(cuts), cuts[:-1]
            marked = np.maximum.reduceat(c, first)
            repeated = (np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)) | (marked > 0)
            bits = np.minimum(np.frexp(many.astype(float))[1], TOP - 1).astype(np.uint8)
            keep = np.repeat(repeated, many)
            c = np.repeat(np.where(marked > 0, np.uint8(TOP), bits), many)[keep]
            k, h = k[keep], h[keep]
        k, h, c = (np.concatenate([a, together(pdf.loc[ready, n], t)]) for a, (n, t) in zip((k, h, c), kinds))
        chunk = np.mod(spark_hash(k), chunks)
        order = np.argsort(chunk, kind="stable")
        k, h, c, chunk = k[order], h[order], c[order], chunk[order]
        cuts = cuts_of(chunk)
        rows = [(int(chunk[a]), k[a:b].tobytes(), h[a:b].tobytes(), c[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame(rows, columns=["chunk", "keys", "hashes", "classes"])

    return run


def repeated(rows: DataFrame, produce: Callable, entries: float, chunks: int) -> DataFrame:
    """``produce(pandas frame of rows)`` gives pairs of arrays (unsigned 64-bit hashes, 64-bit keys). Returns blocks
    ``chunk, keys, hashes, classes`` with the hashes that have two keys or more; ``chunk`` is ``pmod(hash(key), chunks)``.
    ``entries`` is the expected number of pairs."""
    blocks = rows.mapInPandas(_blocks(produce, number_of_ranges(entries)), BLOCK)
    return blocks.groupBy("bucket").applyInPandas(_answers(int(chunks)), ANSWER)


def _later_blocks(produce: Callable, ranges: int):
    shift = B.U(64 - ranges.bit_length() + 1)

    def run(frames) -> Iterator[pd.DataFrame]:
        for h, k in (p for pdf in frames for p in _portions(produce, pdf)):
            new = np.append(True, h[1:] != h[:-1])
            rows = []
            if not new.all():
                spread = int(B.mix(k[:1].view(np.uint64))[0] % B.U(ranges))
                rows.append((spread, k[~new], h[~new], np.zeros(0, np.uint8), True))
            h, k = h[new], k[new]
            bucket = (h >> shift).astype(np.int64)
            cuts = cuts_of(bucket)
            rows += [(int(bucket[a]), k[a:b], h[a:b], np.zeros(0, np.uint8), False) for a, b in zip(cuts[:-1], cuts[1:])]
            yield _frame(rows)

    return run


def _later_answers(chunks: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf["ready"].to_numpy(dtype=bool)
        k, h = (together(pdf.loc[~ready, n], t) for n, t in (("keys", np.int64), ("hashes", np.uint64)))
        order = np.lexsort((k, h))
        k, h = k[order], h[order]
        first = k[cuts_of(h)[:-1]] if len(h) else k
        later = k != np.repeat(first, np.diff(cuts_of(h))) if len(h) else np.zeros(0, dtype=bool)
        k = np.concatenate([k[later], together(pdf.loc[ready, "keys"], np.int64)])
        h = np.concatenate([h[later], together(pdf.loc[ready, "hashes"], np.uint64)])
        chunk = np.mod(spark_hash(k), chunks)
        order = np.argsort(chunk, kind="stable")
        k, h, chunk = k[order], h[order], chunk[order]
        cuts = cuts_of(chunk)
        rows = [(int(chunk[a]), k[a:b].tobytes(), h[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame(rows, columns=["chunk", "keys", "hashes"])

    return run


def later(rows: DataFrame, produce: Callable, entries: float, chunks: int) -> DataFrame:
    """Blocks ``chunk, keys, hashes`` of the pairs whose hash a smaller key has too. Of each hash a task sends its
    smallest key; for the others the answer is known there."""
    blocks = rows.mapInPandas(_later_blocks(produce, number_of_ranges(entries)), BLOCK)
    return blocks.groupBy("bucket").applyInPandas(_later_answers(int(chunks)), "chunk int, keys binary, hashes binary")
