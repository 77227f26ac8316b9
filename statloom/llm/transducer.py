"""SentencePiece encoding and decoding by weighted transducers.

A model is compiled to three transducers: the normaliser (a word mark for each space and before the text), the pieces
(one arc for each piece, from its characters to its id) and byte fallback (from a character without a piece to its
bytes). A text is composed with them to a lattice, and the path of least weight in the tropical semiring (minimum, plus)
is the encoding.

For a unigram model an arc weighs minus the score of its piece. For a model of merges the weights lie on pairs: a pair
of neighbouring pieces weighs nothing if merging their characters gives just these two, and infinitely much otherwise.
Exactly one path has a finite weight, and it is the one that merging yields, since merges act on neighbours alone. So the
search keeps one state for each place, tries long pieces first and enters no place twice. Pair weights are computed when first met and remembered.

Word marks only begin pieces (or make them up), so the lattice is cut before each mark that follows another character;
each distinct part is composed once and remembered, up to ``REMEMBERED`` parts a worker.

Null texts have no ids; the empty text has none either. Every row gives one row. Literal word marks read as spaces, so
they come back as spaces; every other text comes back as it was. Ids that are unknown or control pieces decode to
nothing. Other columns don't matter.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.registry import query, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 400_000
REMEMBERED_PAIRS = 200_000
#: Rows that leave a task at a time.
ROWS = 1000
_ID = np.dtype("<i4")
_UNIGRAM, _MERGES = 1, 2


class Transducer:
    """A compiled model; one for each worker."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, spec = pb.ModelProto.SentencePiece.Type, model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep characters and spaces as they are")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.merges = model.trainer_spec.model_type == _MERGES
        self.score, self.ids = {}, {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = model.trainer_spec.unk_id
        for i, p in enumerate(model.pieces):
            raw = b""
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                raw = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                self.score[p.piece], self.ids[p.piece] = p.score, i
                raw = p.piece.replace(MARK, " ").encode()
            self.bytes_of.append(raw)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.ready = False

    def _compile(self) -> None:
        """The arcs, which only encoding needs."""
        self.ready = True
        if self.merges:  # a piece that merging never makes has no arc
            self.ids = {p: i for p, i in self.ids.items() if self._merged(p) == [p]}
        #: Every beginning of a piece; the id where it is a piece, else -1.
        self.arcs = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        for c in {p[0] for p in self.ids} - self.ids.keys():
            self.arcs[c] = -1
        self.inner = {pair for p in self.ids for pair in zip(p, p[1:])}
        # Characters (no letters, digits or marks) that follow no other character inside a piece, but for each other.
        apart = {c for pair in self.inner for c in pair if not c.isalnum() and c != MARK} | set("\n")
        while odd := {c for x, c in self.inner if c in apart and x not in apart and x != MARK}:
            apart -= odd
        p = "".join(map(re.escape, sorted(apart)))
        self.parts = re.compile(f"{MARK}+[{p}]*[^{MARK}{p}]*|[^{MARK}{p}]+|[{p}]+[^{MARK}{p}]*").findall

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short string: the best pair first, of equals the leftmost."""
        out = list(text)
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = self.score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _weighed(self, pair: tuple[str, str]) -> bool:
        """Whether a pair met for the first time weighs 0."""
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        free = self.pairs[pair] = self._merged(pair[0] + pair[1]) == [*pair]
        return free

    def cut(self, part: str) -> list[str]:
        """The part between characters that are neighbours in no piece; there every path has an end."""
        if len(part) < 2:
            return [part]
        out, begin, inner = [], 0, self.inner
        for i, pair in enumerate(zip(part, part[1:]), 1):
            if pair not in inner:
                out.append(part[begin:i])
                begin = i
        out.append(part[begin:])
        return out

    def shortest(self, part: str) -> bytes:
        """Ids of the least path of one part's lattice."""
        return self._finite(part) if self.merges else self._least(part)

    def _finite(self, part: str) -> bytes:
        """The only path of finite weight, depth first and longest pieces first. One path at most reaches a place, so a
        place from which the search failed is never entered again."""
        n, arcs, pairs, ids = len(part), self.arcs, self.pairs, self.ids
        path: list[str] = []
        dead: set[int] = set()
        i, fresh = 0, True
        while i < n:
            if fresh:  # the end of the longest piece
                end = j = i + 1
                if part[i] in ids:
                    while j < n:
                        j += 1
                        known = arcs.get(part[i:j])
                        if known is None:
                            break
                        if known >= 0:
                            end = j
            while end > i:
                if end not in dead:
                    piece = part[i:end]
                    if piece in ids:
                        if not path:
                            break
                        pair = path[-1], piece
                        free = pairs.get(pair)
                        if free if free is not None else self._weighed(pair):
                            break
                    elif end == i + 1:
                        break  # its bytes; they join with no neighbour
                end -= 1
            else:
                dead.add(i)
                end = i - 1
                i -= len(path.pop())
                fresh = False
                continue
            path.append(piece)
            i, fresh = end, True
        try:
            return array("i", [ids[p] for p in path]).tobytes()
        except KeyError:
            out: list[int] = []
            for piece in reversed(path):
                self._emit(piece, out)
            return array("i", out[::-1]).tobytes()

    def _least(self, part: str) -> bytes:
        """The path of least weight, pieces weighing minus their score."""
        n, arcs = len(part), self.arcs
        weight = [0.0] + [np.inf] * n
        last: list[str | None] = [None] * (n + 1)
        for i in range(n):
            for j in range(i + 1, n + 1):
                known = arcs.get(part[i:j])
                if known is None and j > i + 1:
                    break
                if known is None or known < 0:
                    w = weight[i] + 1e3 if j == i + 1 else np.inf
                else:
                    w = weight[i] - self.score[part[i:j]]
                if w < weight[j]:
                    weight[j], last[j] = w, part[i:j]
        out: list[int] = []
        while n:
            self._emit(last[n], out)
            n -= len(last[n])
        return np.array(out[::-1], dtype=_ID).tobytes()

    def _emit(self, piece: str, out: list[int]) -> None:
        i = self.ids.get(piece)
        if i is not None:
            out.append(i)
        else:
            out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(piece.encode("utf-8", "surrogatepass")))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.ready:
            self._compile()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in self.parts(self.prefix + text.replace(" ", MARK)):
            ids = known.get(p)
            if ids is None:
                ids = known[p] = self._composed(p)
            out.append(ids)
        return b"".join(out)

    def _composed(self, part: str) -> bytes:
        """Ids of a part met for the first time."""
        inner = self.cut(part)
        if len(inner) == 1:
            return self.shortest(part)
        known, out = self.known, []
        for q in inner:
            ids = known.get(q)
            if ids is None:
                ids = known[q] = self.shortest(q)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table_ = self.bytes_of
        raw = b"".join([table_[i] for i in np.frombuffer(ids, dtype=_ID).tolist()])
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@cache
def compiled(path: str) -> Transducer:
    return Transducer(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _few(frames):
    """Frames of at most ``ROWS`` rows, so that ids of few texts are held at a time."""
    for pdf in frames:
        for at in range(0, len(pdf), ROWS):
            yield pdf.iloc[at : at + ROWS]


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian 32-bit integers; null for a null text) and ``n_ids``."""
    path = path or model_path()

    def run(frames):
        for pdf in _few(frames):
            ids = [compiled(path).encode(t) if isinstance(t, str) else None for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids, "n_ids": [len(i) // 4 if i is not None else 0 for i in ids]})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, ids binary, n_ids long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``text``, and ``ids`` and ``n_ids`` as they came."""
    path = path or model_path()

    def run(frames):
        for pdf in _few(frames):
            texts = [compiled(path).decode(i) if i is not None else None for i in pdf["ids"]]
            yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), text=texts)[["doc_id", "text", "ids", "n_ids"]]

    return encoded.select("doc_id", "ids", "n_ids").mapInPandas(run, "doc_id long, text string, ids binary, n_ids long")


def digest(decoded: DataFrame) -> DataFrame:
    """Number and checksum of the ids, and SHA-256 of the text decoded from them."""
    return decoded.select(
        "doc_id", "n_ids", F.crc32(F.coalesce("ids", F.lit(b""))).alias("ids_crc32"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("decoded_sha256"),
    )


@query("op9_piece_transducer")
def piece_transducer(spark, folder):
    """All documents encoded, and decoded from their ids."""
    return digest(decode(encode(table(spark, folder, "documents"))))
