"""Exact Jaccard join over word shingles, by prefixes of token combinations.

A document's tokens are the hashes of its distinct runs of four words. Documents with equal sets are one set, named by a
hash. Two sets of Jaccard ``PERCENT`` or more must share tokens early in any common order, and more of them if both
prefixes are extended:

1. Extended prefix. In hash order the first ``2p - 1`` tokens of a set (p is the plain prefix length) share at
   least p with those of a partner of its size. The exchange tells which of these occur in several sets, with a
   frequency class.
2. Rare first. Of the extended prefix only the rarest ``2p - p'`` tokens are indexed (p' is p of the smallest partner),
   so up to half may be frequent and cost nothing. Tokens of one set only fill their places without a row.
3. Single tokens and combinations. A rare token is indexed alone: its group is small, and all its pairs are candidates.
   A frequent token makes a large group. The tokens that more than half of a group have are its core, and the set nearest
   to the core is its leader, with which all are compared. Two sets of the group that aren't both linked with
   the leader either share a token beside the core, which makes the combined key (group, token), or share none and
   must pass a bound on what they have of the core. A combined key has half of its group at most; large ones get a core,
   a leader and another token. Rows grow with the tokens beside the core, not with pairs of the group.
4. Candidates are verified on whole texts. Links give components by alternating stars.

Null and empty texts have an empty set and are linked with nothing. A text with fewer than four words has one token.
Null ids take no part in components: theirs is null. Rows with one id count as one document that has all their links.
Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import bytesets as B
from statloom.llm.components import components
from statloom.llm.exchange import repeated, together
from statloom.llm.registry import query, table, unused
from statloom.llm.storage import stored

WORDS = 4
PERCENT = 85
#: A group of so many sets is verified pair by pair; a larger one gets a leader.
SMALL_GROUP = 48
#: Members of a large group whose tokens are counted in one task.
PART_SETS = 256
CHUNK_SETS = 20_000
#: Rows whose texts are compared at a time.
PIECE_ROWS = 500
#: Rows with texts or cores that a Python worker holds at a time.
BATCH_ROWS = 1000


def tokens(texts: list[bytes], words: int = WORDS):
    """For each group ``(first, cuts, tokens)``: text ``first + i`` has the sorted distinct ``tokens[cuts[i]:cuts[i+1]]``."""
    for first, end, buf, starts in B.groups(texts):
        low = B.lower(buf)
        s, e = B.runs(~((low == 32) | ((low >= 9) & (low <= 13))))
        doc = np.searchsorted(starts, s, side="right") - 1
        h = B.span_hashes(low, s, e)
        n = np.bincount(doc, minlength=end - first)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        whole = np.flatnonzero(doc[words - 1 :] == doc[: max(0, len(doc) - words + 1)]) if len(doc) >= words else np.empty(0, np.int64)
        shingle = np.full(len(whole), B.U(words))
        for k in range(words):
            shingle = B.mix(shingle * B.U(0x9E3779B97F4A7C15) + h[whole + k])
        few = np.flatnonzero((n > 0) & (n < words))
        short = n[few].astype(np.uint64)
        for k in range(words - 1):
            more = n[few] > k
            short = np.where(more, B.mix(short * B.U(0x9E3779B97F4A7C15) + h[np.minimum(begin[few] + k, max(len(h) - 1, 0))] if len(h) else short), short)
        owner, value = np.concatenate([doc[whole], few]), np.concatenate([shingle, short])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        once = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))[: len(owner)]
        owner, value = owner[once], value[once]
        yield first, np.searchsorted(owner, np.arange(end - first + 1)), value


def set_keys(cuts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(value ^ B.U(0x2545F4914F6CDD1D)))])
    n = np.diff(cuts).astype(np.uint64)
    key = B.mix(sums[cuts[1:]] - sums[cuts[:-1]] + n)
    return np.where(n > 0, np.where(key == 0, B.U(1), key), B.U(0)).view(np.int64)


def shares(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Tokens that a set of n shares at least with a partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def prefix(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - shares(n, percent) + 1


def _signatures(words: int):
    """Size and name of each row's set."""

    def run(frames):
        for pdf in frames:
            n, key = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for first, cuts, value in tokens([B.as_bytes(t) for t in pdf["text"]], words):
                n[first : first + len(cuts) - 1] = np.diff(cuts)
                key[first : first + len(cuts) - 1] = set_keys(cuts, value)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "content": pdf["content"], "n": n, "key": key})

    return run


def _extended(words: int, percent: int):
    def produce(pdf: pd.DataFrame):
        for _, cuts, value in tokens([B.as_bytes(t) for t in pdf["text"]], words):
            n, key = np.diff(cuts), set_keys(cuts, value)
            some = n > 0
            length = np.where(some, 2 * prefix(np.maximum(n, 1), percent) - 1, 0)
            rank = np.arange(len(value)) - np.repeat(cuts[:-1], n)
            kept = rank < np.repeat(length, n)
            yield value[kept], np.repeat(key, n)[kept]

    return produce


def _postings(percent: int):
    """Rarest-first index entries of one chunk of sets."""

    def run(sets: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        kinds = (("keys", np.int64), ("hashes", np.uint64), ("classes", np.uint8))
        key, h, c = (together(answers[col], t) for col, t in kinds)
        order = np.lexsort((h, c, key))
        key, h = key[order], h[order]
        names = sets["key"].to_numpy(dtype=np.int64)
        by = np.argsort(names)
        names, n = names[by], sets["n"].to_numpy(dtype=np.int64)[by]
        known = np.isin(key, names)
        key, h = key[known], h[known]
        at = np.searchsorted(names, key)
        size = n[at]
        first = np.searchsorted(key, key, side="left")
        seen = np.searchsorted(key, key, side="right") - first
        p = prefix(size, percent)
        # Tokens of this set only come first and take places; what is left of the places goes to shared tokens.
        places = 2 * p - prefix(shares(size, percent), percent) - ((2 * p - 1) - seen)
        kept = np.arange(len(key)) - first < places
        return pd.DataFrame({"token": h[kept].view(np.int64), "key": key[kept], "n": size[kept]})

    return run


def _pieces(frames):
    """Frames of few rows: the tokens of all texts of one are held at a time."""
    for pdf in frames:
        for k in range(0, len(pdf), PIECE_ROWS):
            yield pdf.iloc[k : k + PIECE_ROWS]


def _sides(words: int, pdf: pd.DataFrame, *sides: tuple[str, str]) -> dict:
    """Tokens of the sets named in the columns, each computed once."""
    found = {}
    for name, text in sides:
        unique = pdf.drop_duplicates(name)
        for first, cuts, value in tokens([B.as_bytes(t) for t in unique[text]], words):
            names = unique[name].to_numpy()[first : first + len(cuts) - 1]
            found.update((k, value[a:b]) for k, a, b in zip(names.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))
    return found


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the sorted a are in the sorted b."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), dtype=bool)


def _compare(words: int, percent: int):
    """Which pairs are linked."""

    def run(frames):
        for pdf in _pieces(frames):
            value = _sides(words, pdf, ("x", "text_x"), ("y", "text_y"))
            rows = []
            for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist()):
                a, b = value[x], value[y]
                both = int(_shared(a, b).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    rows.append((x, y))
            yield pd.DataFrame(rows, columns=["x", "y"])

    return run


def _cores(words: int):
    """Tokens that more than half of a part of a group have. A token that is no part's is in half of the group at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = _sides(words, pdf, ("key", "text"))
        names, n = np.unique(np.concatenate([value[k] for k in pdf["key"].tolist()]), return_counts=True)
        return pd.DataFrame({"token": pdf["token"].iloc[:1], "core": [names[2 * n > len(pdf)].view(np.int64)]})

    return run


_PROFILE = "token long, key long, both long, n long, near double, beside binary"


def _profiles(words: int, percent: int):
    """What a set has of its group's core, and the tokens beside the core of which a partner must have one."""

    def run(frames):
        for pdf in _pieces(frames):
            value = _sides(words, pdf, ("key", "text"))
            rows = []
            for group, key, core in zip(pdf["token"].tolist(), pdf["key"].tolist(), pdf["core"].tolist()):
                a, b = value[key], np.sort(np.asarray(core, dtype=np.int64).view(np.uint64))
                common = _shared(a, b)
                both = int(common.sum())
                extra = a[~common]
                need = max(int(shares(np.int64(len(a)), percent)) - both, 1)
                rows.append((group, key, both, len(a), both / (len(a) + len(b) - both), extra[: max(len(extra) - need + 1, 0)].tobytes()))
            yield pd.DataFrame(rows, columns=["token", "key", "both", "n", "near", "beside"])

    return run


def _combined(pdf: pd.DataFrame):
    """Combined keys of a group and a token beside its core, with the member they belong to."""
    n = (pdf["beside"].str.len() // 8).to_numpy()
    flat = together(pdf["beside"], np.uint64)
    yield B.mix(np.repeat(pdf["token"].to_numpy().view(np.uint64), n) ^ B.mix(flat)), np.repeat(pdf["member"].to_numpy(), n)


def _unpack(frames):
    for pdf in frames:
        yield pd.DataFrame({"token": together(pdf["hashes"], np.int64), "member": together(pdf["keys"], np.int64)})


def _grouped(index: DataFrame) -> DataFrame:
    """Index entries of tokens that have two sets or more, with the size of the group and its smallest set. Sets that
    are all linked with one leader are joined already."""
    groups = index.groupBy("token").agg(F.count("*").alias("size"), F.min("key").alias("least"), F.min("linked").alias("joined"))
    return stored(index.join(groups.filter("size > 1 AND NOT joined").drop("joined"), "token"), "groups")


def links(rows: DataFrame, sets: DataFrame, index: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All pairs of sets ``x, y`` that reach ``percent``, but for pairs that links of a common leader join anyway.
    ``rows``: (doc_id, text); ``sets``: (key, doc_id, content) with the row that stands for a set and the hash of its
    text; ``index``: (token, key, n)."""
    groups = _grouped(stored(index.withColumn("linked", F.lit(False)), "index"))
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    wanted = sets.join(groups.select("key").distinct(), "key").select("key", "doc_id", "content")
    texts = rows.withColumn("content", content).join(wanted, ["doc_id", "content"]).select("key", "text").dropDuplicates(["key"])
    texts = stored(texts, "active")

    def verified(pairs: DataFrame) -> DataFrame:
        x = texts.select(F.col("key").alias("x"), F.col("text").alias("text_x"))
        y = texts.select(F.col("key").alias("y"), F.col("text").alias("text_y"))
        pairs = pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        return stored(pairs.join(x, "x").join(y, "y").mapInPandas(_compare(words, percent), "x long, y long"), "links", BATCH_ROWS)

    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"  # a bound by sizes alone
    pending = groups.select(F.col("key").alias("x"), F.col("key").alias("y")).filter("x <> y")
    out, first = pending, True
    while not groups.isEmpty():
        few = groups.filter(f"size <= {SMALL_GROUP}").select("token", "key", "n", "linked")
        other = few.select("token", F.col("key").alias("other"), F.col("n").alias("m"), F.col("linked").alias("also"))
        near = few.join(other, "token").filter("key > other AND NOT (linked AND also)").filter(fits)
        pending = pending.union(near.select(F.col("key").alias("x"), F.col("other").alias("y")))
        large = groups.filter(f"size > {SMALL_GROUP}")
        if large.isEmpty():
            break
        # Tokens of one family often have the same sets: at first, groups with one smallest set are taken as one.
        large = large.select((F.col("least") if first else F.col("token")).alias("token"), "key").distinct()
        sizes = large.groupBy("token").agg(F.ceil(F.count("*") / PART_SETS).cast("int").alias("parts"))
        part = F.pmod(F.hash("key"), F.col("parts")).alias("part")
        member = stored(large.join(sizes, "token").select("token", "key", part).join(texts, "key"), "members", BATCH_ROWS)
        core = member.groupBy("token", "part").applyInPandas(_cores(words), "token long, core array<bigint>")
        core = core.groupBy("token").agg(F.array_distinct(F.flatten(F.collect_list("core"))).alias("core"))
        member = member.join(core, "token")
        profile = stored(member.mapInPandas(_profiles(words, percent), _PROFILE), "profiles", BATCH_ROWS)
        leader = profile.groupBy("token").agg(F.max_by("key", F.struct("near", "key")).alias("leader"))
        led = stored(profile.join(leader, "token"), "leaders")
        direct = led.filter("key <> leader").select(F.col("key").alias("x"), F.col("leader").alias("y"))
        done = verified(pending.union(direct))
        out = out.union(done)
        hit = done.select(F.col("x").alias("p"), F.col("y").alias("q"), F.lit(True).alias("hit"))
        led = led.join(hit, (F.greatest("key", "leader") == F.col("p")) & (F.least("key", "leader") == F.col("q")), "left")
        led = led.withColumn("linked", F.coalesce("hit", F.col("key") == F.col("leader")))
        led = stored(led.select("token", "key", "both", "n", "linked", "beside"), "led")
        pending = _within_core(led.drop("beside"), percent)
        # Only combined keys that several members have come back from the exchange.
        led = led.withColumn("member", F.xxhash64("token", "key"))
        some = led.filter("length(beside) > 0")
        total = some.agg(F.coalesce(F.sum(F.length("beside")), F.lit(0)), F.count("*")).first()
        shared = repeated(some.select("token", "member", "beside"), _combined, total[0] / 8, -(-total[1] // CHUNK_SETS) or 1)
        entries = stored(shared.mapInPandas(_unpack, "token long, member long"), "combined")
        groups = _grouped(entries.join(some.select("member", "key", "n", "linked"), "member").drop("member"))
        first = False
    return out.union(verified(pending))


def _within_core(led: DataFrame, percent: int) -> DataFrame:
    """Pairs of a group, not both linked with its leader, that may reach ``percent`` without a common token beside the
    core: they have at most the smaller of their shares of it in common. Sets are first taken by profile, so
    profiles are compared and not sets; sets that need a token beside the core are out."""
    one = led.filter(f"100 * both >= {percent} * n")
    kinds = one.select("token", "both", "n", "linked").distinct()
    a, b = kinds.alias("a"), kinds.alias("b")
    least, size = F.least("a.both", "b.both"), F.col("a.n") + F.col("b.n")
    fit = (F.col("a.token") == F.col("b.token")) & ~F.col("a.linked") & (100 * least >= percent * (size - least))
    names = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in ("both", "n", "linked")]
    match = a.join(b, fit).select(F.col("a.token").alias("token"), *names)
    sides = [one.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("both", "n", "linked")], F.col("key").alias(f"key_{s}")) for s in ("a", "b")]
    for s, side in zip(("a", "b"), sides):
        match = match.join(side, ["token", f"both_{s}", f"n_{s}", f"linked_{s}"])
    pairs = match.filter("key_a <> key_b")
    return pairs.select(F.greatest("key_a", "key_b").alias("x"), F.least("key_a", "key_b").alias("y")).distinct()


def _labelled(documents: DataFrame, words: int, percent: int, tie: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, content, n, key) and their sets (key, doc_id, content, component): the first row of a set and
    the name of its component. With ``tie``, rows of one id are one document."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    content = F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")
    signs = stored(rows.select("*", content).mapInPandas(_signatures(words), "doc_id long, content long, n long, key long"), "signatures", BATCH_ROWS)
    first = F.min(F.struct("doc_id", "content")).alias("first")
    sets = signs.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(first, F.max("n").alias("n"))
    sets = stored(sets.select("key", "n", "first.doc_id", "first.content"), "sets")
    total, number = signs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    chunks = max(2 * spark.sparkContext.defaultParallelism, -(-number // CHUNK_SETS))
    answers = stored(repeated(rows.filter("doc_id IS NOT NULL"), _extended(words, percent), 0.3 * total, chunks), "answers", BATCH_ROWS)
    chunk = F.pmod(F.hash("key"), F.lit(int(chunks))).alias("chunk")
    index = sets.select(chunk, "key", "n").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_postings(percent), "token long, key long, n long")
    found = links(rows, sets, index, words, percent)
    # Rows with one id and several sets tie these sets together.
    edges = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
    twice = signs.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y")
    tied = signs.join(twice.select("doc_id", F.col("x").alias("b")), "doc_id").filter("n > 0").select(F.col("key").alias("a"), "b")
    label = components(edges.union(tied) if tie else edges).withColumnRenamed("node", "key")
    return signs, sets.join(label, "key", "left").select("key", "doc_id", "content", F.coalesce("component", "key").alias("component"))


def join(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of the documents."""
    signs, named = _labelled(documents, words, percent, tie=True)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_key = named.join(least, "component").select("key", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signs.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The document of the smallest id of each component, with all columns. Rows of one id with different texts are
    documents of their own; of rows with one id and one text, the one of the least row hash stays. Documents without
    words and rows with a null id stay."""
    signs, named = _labelled(documents, words, percent, tie=False)
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "content")).alias("first")).select("first.*")
    wordless = signs.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id", "content").distinct()
    kept = first.unionByName(wordless)
    content, mark = unused(documents, "__content", "__mark")
    # A hash skips nulls, so it says where they are; maps have no hash.
    hashed = [F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()]
    rows = documents.filter("doc_id IS NOT NULL").withColumn(content, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn(mark, F.xxhash64(*hashed, *[c.isNull() for c in hashed]))
    one = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(content).alias("content"), F.col(mark).alias("mark"))
    one = one.groupBy("doc_id", "content").agg(F.min("mark").alias("mark")).join(kept, ["doc_id", "content"], "left_semi")
    one = one.select(F.col("doc_id").alias("i"), F.col("content").alias("c"), F.col("mark").alias("m")).alias("one")
    same = (F.col("all.doc_id") == F.col("one.i")) & (F.col(f"all.{content}") == F.col("one.c")) & (F.col(f"all.{mark}") == F.col("one.m"))
    single = rows.dropDuplicates(["doc_id", content, mark]).alias("all").join(one, same, "left_semi").drop(content, mark)
    return single.union(documents.filter("doc_id IS NULL"))


@query("op10_ngram_jaccard")
def ngram_jaccard(spark, folder):
    """Components of all documents by 4-word shingles at 85 percent."""
    return join(table(spark, folder, "documents"))
