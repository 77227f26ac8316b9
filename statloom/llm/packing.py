"""Harmonic packing of tokenised documents into sequences.

A document's ids are its tokens and a closing id 0. Every whole sequence of a document is a sequence of its own. The
rest is cut into reciprocal-capacity sizes, ``capacity // j`` for j = 1..16, largest first; what stays is a sliver
shorter than the smallest size and is classed by its exact length. A bin of a class takes a fixed number of pieces
(``capacity // size``), so it is full by count alone and workers need not know of each other. At the end of a task the
pieces of its unfinished bins are laid end to end, cut where a sequence ends; so a task pads one sequence only, besides
the few positions that a size leaves when it doesn't divide the capacity.

There is no shuffle: tasks pack what they read. ``sequence_id`` holds the task's number in its upper half; a repeated
attempt reads the same rows in the same order and gives the same ids.

Null and empty texts are the closing id alone. Copies are packed like any document. Null ids are kept. An empty table
has no pieces. Very long texts are cut like others; memory is bounded by one document and a sequence for each class.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.registry import query, table

CAPACITY = 1024
CLASSES = 16
CLOSING_ID = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters on which the splitting pattern means the same to every regular expression library; texts with others
#: are given to the tokenizer whole.
_PLAIN = re.compile("[\t\n\x20-\x7e¡-ɏΑ-Ωα-ωА-я‐-‧€]*")
_ID = np.dtype("<u4")


#: The vocabulary's split into words, written without backtracking.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes. The ranks of the same vocabulary give the same ids several
    times faster; texts with unusual characters or added tokens go through the tokenizer itself."""

    def __init__(self, path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) is None or self.added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=_ID).tobytes()
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(_ID, copy=False).tobytes()


@cache
def encoder(path: str, ranks_path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, ranks_path)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, reciprocal sizes, a sliver."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    smallest = max(1, capacity // CLASSES)
    while rest >= smallest:
        size = capacity // -(-capacity // rest)
        # capacity // ceil(capacity / rest) is the largest reciprocal size not above the rest
        out.append(size)
        rest -= size
    if rest:
        out.append(rest)
    return out


class Packer:
    """Bins of one task. ``add`` and ``close`` give finished rows."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.next, self.capacity = first_sequence, capacity
        self.open: dict[int, list[tuple]] = {}

    def _finish(self, held: list[tuple]):
        offset = 0
        for doc, start, ids, total in held:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next, offset
            offset += n
        self.next += 1

    def add(self, doc, ids: bytes):
        total, start = len(ids) // 4, 0
        for n in pieces_of(total, self.capacity):
            held = self.open.setdefault(n, [])
            held.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(held) == self.capacity // n:
                yield from self._finish(self.open.pop(n))

    def close(self):
        held, room = [], self.capacity
        for size in sorted(self.open, reverse=True):
            for doc, start, ids, total in self.open[size]:
                while ids:
                    n = min(room, len(ids) // 4)
                    held.append((doc, start, ids[: 4 * n], total))
                    ids, start, room = ids[4 * n :], start + n, room - n
                    if not room:
                        yield from self._finish(held)
                        held, room = [], self.capacity
        if held:
            yield from self._finish(held)
        self.open = {}


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack(documents: DataFrame, path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of a document; see the module."""
    path, ranks_path = path or vocabulary_path(), ranks_path or vocabulary_path(RANKS)
    closing = np.array([CLOSING_ID], dtype=_ID).tobytes()

    def run(frames):
        encode = encoder(path, ranks_path).encode
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)
        rows: list[tuple] = []
        for pdf in frames:
            ids = [None if missing else int(i) for i, missing in zip(pdf["doc_id"], pdf["doc_id"].isna())]
            for doc, text in zip(ids, pdf["text"]):
                rows.extend(packer.add(doc, (encode(text) if isinstance(text, str) else b"") + closing))
                if len(rows) >= 20_000:
                    yield _frame(rows)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield _frame(rows)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_NAMES)
    return frame.assign(doc_id=frame["doc_id"].astype("Int64"))


@query("op7_harmonic_packing")
def harmonic_packing(spark, folder):
    """All documents in sequences of 1024 ids."""
    return pack(table(spark, folder, "documents"))
