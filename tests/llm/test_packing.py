import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from statloom.llm import packing
from tests.llm.helpers import clashing, documents, empty, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def test_every_id_lies_in_one_piece(spark, tokenizer):
    more = [(900, "tail <|endoftext|> here"), (901, "tabs\tand  double  spaces \n end ")]
    got = packing.pack(clashing(documents(spark, more)).coalesce(1)).toPandas()
    table = rows() + more
    wanted = []
    for r in table:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        wanted.append((r[0], ids))
    seen = []
    for doc, pieces in got.groupby("doc_id", dropna=False):
        ids = [i for d, i in wanted if d == doc or (d is None and doc is not doc and False)]
        if ids and len(ids) == 1:
            place = 0
            for p in pieces.sort_values("start").itertuples():
                assert p.start == place and p.doc_tokens == len(ids[0])
                assert zlib.crc32(ids[0][p.start : p.start + p.length].tobytes()) == p.ids_crc32
                place += p.length
            assert place == len(ids[0])
            seen.append(doc)
    assert len(seen) >= 20
    assert got["length"].sum() == sum(len(i) for _, i in wanted)
    bins = got.sort_values(["sequence_id", "offset"])
    assert (bins.groupby("sequence_id")["length"].cumsum() - bins["length"] == bins["offset"]).all()
    sizes = bins.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 1024 and sizes.sum() / (1024 * len(sizes)) > 0.9


def test_pieces_are_reciprocal_sizes():
    sizes = {1024 // j for j in range(1, 17)}
    for n in range(1, 3000):
        pieces = packing.pieces_of(n)
        assert sum(pieces) == n and all(p in sizes for p in pieces if p >= 64) and sum(p < 64 for p in pieces) <= 1


def test_empty_table_and_repeat(spark):
    assert packing.pack(empty(spark)).count() == 0
    table = documents(spark).coalesce(1)
    assert sorted(map(repr, packing.pack(table).collect())) == sorted(map(repr, packing.pack(table).collect()))
