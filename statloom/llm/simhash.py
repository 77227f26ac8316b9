"""SimHash near-duplicates: fingerprints that share a block, verified by Hamming distance.

1. A text's fingerprint has a bit where more than half of its shingles' hashes have it (three words; repeats count).
   Equal fingerprints are one node from here on, so exact copies cost nothing.
2. Pigeonhole: of ``DISTANCE + 1`` blocks of bits, fingerprints at that distance or less share one at least. A node goes
   into one bucket per block, by its bits there.
3. Small buckets are joined with themselves, and the distance is verified in the join.
4. Buckets of up to ``PART`` nodes are searched in one task, which returns a spanning forest instead of all pairs.
5. A larger bucket gets a leader, the node nearest to the majority of its bits. Nodes linked with the leader are
   one class and need no comparison with each other. If few are left, they go to every part of the class; parts hold
   ``PART`` nodes at most. If many are left, the bucket is split by blocks of the bits not used yet, which is the same pigeonhole
   again; classes stay known. Bits run out, so this ends, and no link is lost on the way.
6. Links give components by alternating stars.

Texts are lower-cased (A-Z) and cut at ASCII white space; with fewer words than a shingle, the whole sequence is one. Null
texts and texts without words have fingerprint zero and are linked like any other. Long texts are read in slices.
Rows are documents, whatever their ids: rows of one id are linked only by their texts, each has its own row. A row with
a null id links others; its component is null where no id is reachable. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm import bytesets as B
from statloom.llm.components import components
from statloom.llm.registry import query, table
from statloom.llm.storage import stored

WORDS = 3
DISTANCE = 3
SEED = 42
#: Nodes of a bucket that is joined with itself, and of a bucket (or a part of one) that is searched in one task.
SMALL = 64
PART = 4096
#: Bytes of a text that are cut into words at a time.
SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in slices that end where a word ends."""
    start = 0
    while start < len(text):
        end = _SPACE.search(text, start + SLICE_BYTES) if start + SLICE_BYTES < len(text) else None
        stop = end.start() if end else len(text)
        yield text[start:stop]
        start = stop


def _set_bits(shingles: list[bytes]) -> np.ndarray:
    """How many of the shingles' hashes have each bit, from the highest."""
    h = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=SEED), shingles)), dtype=np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, unsigned."""
    have, n, carried = np.zeros(64, dtype=np.int64), 0, []
    for part in _slices(text):
        carried += part.lower().split()
        whole = len(carried) - words + 1
        if whole > 0:
            have += _set_bits([b" ".join(s) for s in zip(*[carried[k : k + whole] for k in range(words)])])
            n, carried = n + whole, carried[whole:]
    if not n and carried:
        have, n = _set_bits([b" ".join(carried)]), 1
    return int.from_bytes(np.packbits(2 * have > n).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (signed) of every row."""

    def run(frames):
        for pdf in frames:
            fps = np.array([fingerprint(B.as_bytes(t), words) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def apart(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _blocks(mask: int, count: int) -> list[int]:
    """The set bits of a mask (signed), in ``count`` masks of about equal size."""
    places = [k for k in range(64) if mask >> k & 1]
    cuts = [len(places) * k // count for k in range(count + 1)]
    masks = [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _split(buckets: DataFrame, count: int) -> DataFrame:
    """Every entry in one bucket for each block of its bucket's unused bits. ``free`` has one value at first and
    ``count`` times as many with each split; its few masks are part of the plan."""
    masks = [r[0] for r in buckets.select("free").distinct().collect()]
    if not masks:
        return buckets

    def cuts(mask: int) -> Column:
        return F.array(*[F.struct(_long(b).alias("block"), _long(mask & ~b).alias("left")) for b in _blocks(mask, count)])

    known = F.create_map(*[c for m in masks for c in (_long(m), cuts(m))])
    rows = buckets.select("key", "fp", "class", F.inline(F.element_at(known, F.col("free"))))
    key = F.xxhash64("key", "block", F.col("fp").bitwiseAND(F.col("block"))).alias("key")
    return rows.select(key, F.col("left").alias("free"), "fp", "class")


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _search(distance: int):
    """Links of one part: a spanning forest of the others, and for each of them one link with the class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, joined = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["joined"].to_numpy(bool)
        own, others = fps[joined], fps[~joined]
        found = []
        if len(own):
            for k in range(0, len(others), 256):
                near = np.bitwise_count(others[k : k + 256, None] ^ own[None, :]) <= distance
                hit = near.any(axis=1)
                found.append((others[k : k + 256][hit], own[near.argmax(axis=1)[hit]]))
        if pdf["part"].iloc[0] == 0:
            left = others
            while len(left):
                reached, left = [left[0]], left[1:]
                while reached:
                    x = reached.pop()
                    near = np.bitwise_count(left ^ x) <= distance
                    new, left = left[near], left[~near]
                    found.append((np.full(len(new), x), new))
                    reached += list(new)
        a, b = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    return run


def _led(large: DataFrame, distance: int) -> DataFrame:
    """Entries of large buckets, where those without a class that are linked with their bucket's leader have its class."""
    free = large.filter("class IS NULL")
    bits = free.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    one = F.expr("shiftright(fp, bit) & 1")
    votes = bits.groupBy("key", "bit").agg(F.sum(one).alias("ones"), F.count("*").alias("n"))
    center = votes.groupBy("key").agg(F.bit_or(F.when(F.expr("2 * ones > n"), F.expr("shiftleft(1L, bit)")).otherwise(_long(0))).alias("center"))
    near = free.join(center, "key").groupBy("key").agg(F.min(F.struct(apart("fp", "center").alias("d"), "fp")).alias("near"))
    leader = stored(near.select("key", F.col("near.fp").alias("leader")), "leaders")
    linked = F.when(F.col("class").isNull() & (apart("fp", "leader") <= distance), F.col("leader")).otherwise(F.col("class"))
    return large.join(leader, "key", "left").select("key", "free", "fp", linked.alias("class"))


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links among distinct fingerprints ``fp``, not all, but enough for the same components."""
    entries = nodes.select(_long(0).alias("key"), _long(-1).alias("free"), "fp", F.lit(None).cast("long").alias("class"))
    entries = stored(_split(entries, distance + 1), "buckets")
    out = []
    while True:
        sizes = entries.groupBy("key").agg(F.count("*").alias("size"))
        big = stored(sizes.filter(F.col("size") > SMALL), "sizes")
        small = entries.join(big, "key", "left_anti")
        x = small.select("key", F.col("fp").alias("a"), F.col("class").alias("p"))
        y = small.select("key", F.col("fp").alias("b"), F.col("class").alias("q"))
        other = ~F.coalesce(F.col("p") == F.col("q"), F.lit(False))
        out.append(x.join(y, "key").filter((F.col("a") < F.col("b")) & (apart("a", "b") <= distance) & other).select("a", "b"))
        if big.isEmpty():
            break
        held = entries.join(big, "key")
        first = held.filter(F.col("size") <= PART).select("key", "fp", F.lit(False).alias("joined"), F.lit(0).alias("part"))
        led = stored(_led(held.filter(F.col("size") > PART).drop("size"), distance), "led")
        out.append(led.filter("class <> fp").select(F.col("fp").alias("a"), F.col("class").alias("b")))
        by_class = led.groupBy("key", "class").agg(F.count("*").alias("n"))
        top = F.max(F.when(F.col("class").isNotNull(), F.struct("n", "class"))).alias("top")
        most = by_class.groupBy("key").agg(F.sum("n").alias("size"), top)
        most = stored(most.select("key", F.col("top.class").alias("widest"), F.col("top.n").alias("n"), (F.col("size") - F.col("top.n")).alias("others")), "classes")
        marked = led.join(most.filter("others > 0"), "key").withColumn("joined", F.coalesce(F.col("class") == F.col("widest"), F.lit(False)))
        parts = F.ceil(F.col("n") / PART).cast("int")
        where = F.when(F.col("joined"), F.array(F.pmod(F.hash("fp"), parts))).otherwise(F.sequence(F.lit(0), parts - 1))
        few = marked.filter(F.col("others") <= PART).select("key", "fp", "joined", F.explode(where).alias("part"))
        out.append(stored(first.union(few).groupBy("key", "part").applyInPandas(_search(distance), "a long, b long"), "forests"))
        many = marked.filter(F.col("others") > PART).select("key", "free", "fp", "class")
        entries = stored(_split(many, distance + 1), "buckets")
        if entries.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def join(documents: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of the documents."""
    rows = stored(fingerprints(documents, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    label = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = stored(nodes.join(label, "fp", "left").select("fp", "least", "component"), "named")
    several = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(stored(several, "components"), "component", "left")
    by_fp = stored(by_fp.select("fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "labels")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


@query("op12_simhash_blocks")
def simhash_blocks(spark, folder):
    """Fingerprints of 3-word shingles of all documents, components at 3 bits or fewer."""
    found = join(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
