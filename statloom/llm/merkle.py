"""Merkle manifest of a dataset: few stored levels, proofs by recomputation.

Every row is a leaf. The leaves of a group stand by key; each two neighbours become their parent, a last one without a
neighbour alone, until one node remains: the group's root. The roots of all groups, by name, form one more such tree.

1. Leaves are put in ranges of group and key (sampled, so that no group, however large, is one task) and numbered there;
   counts per range give each leaf its place in its group.
2. Only every ``STEP``-th level is stored: a row holds the nodes of one aligned subtree, ``2 ** STEP`` at most, at its
   lower edge. Nodes between two stored levels exist while such a row is folded, and nowhere else.
3. Proofs go from the top down. A subtree's missing nodes are made again from the stored row, each of its nodes gets the
   siblings on the way to the subtree's root, followed by those that this root has, and the made nodes are dropped.

A digest is the lowercase hex SHA-256 of its parts in a row. A field is ``-`` if null, else its UTF-8 length, ``:`` and its
value. All of it is DataFrame functions.

Null keys stand first, then rows by key, rows of one key by digest; equal rows have neighbouring places, in any order.
The null group is a group, in front of the others. Empty texts are fields of length 0. Long texts are hashed once, whole;
only their digest travels. An empty table has no leaves, no root and no proofs. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.common import join_null_safe, let
from statloom.llm.registry import query, table
from statloom.llm.storage import stored

#: Levels between two stored ones.
STEP = 6
#: Expected leaves of a range. It sets how many ranges there are, never what one may hold.
RANGE_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ENTRY = "array<struct<left:boolean,other:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(fields: list[Column]) -> Column:
    """The leaf of a row with these fields."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _height(n: Column, step: int) -> Column:
    """Levels that the subtree of a group of n nodes has below its root, ``step`` at most."""
    whole = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return F.least(whole, F.lit(step))


def _subtree(nodes: Column, height: Column) -> Column:
    """All levels of a subtree, from the given nodes to its root."""

    def parents(level: Column) -> Column:
        pair = lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))
        return F.transform(_upto(F.floor((F.size(level) + 1) / 2).cast("int")), pair)

    grown = lambda levels, _: let(F.element_at(levels, -1), lambda last: F.concat(levels, F.array(parents(last))))
    return F.reduce(_upto(height), F.array(nodes), grown)


def _siblings(levels: Column, place: Column, height: Column) -> Column:
    """From the node at ``place`` up: on which side its neighbour stands, and the neighbour, null if there is none."""

    def entry(k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(2), k)).cast("int")
        other = F.get(F.get(levels, k), at.bitwiseXOR(F.lit(1)))
        return F.struct((at % 2 == 1).alias("left"), other.alias("other"))

    return F.transform(_upto(height), entry)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(h: Column, s: Column) -> Column:
        other = F.coalesce(s["other"], F.lit(""))
        return F.when(s["left"], digest(other, h)).otherwise(digest(h, other))

    return F.reduce(siblings, leaf, up)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place in their group from 0, and ``n``, the group's rows."""
    spark = rows.sparkSession
    # A number of their own keeps equal rows apart, so that many of them spread over ranges too.
    rows = stored(rows.withColumn("own", F.monotonically_increasing_id()), "leaves")
    ranges = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "own")]
    # The number that follows is the range and the row's place there.
    ranged = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("own")
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("range", F.shiftright("at", 33))
    spans = ranged.groupBy("range", group).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    before = F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("range", group, "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    out = join_null_safe(ranged, spans, ["range", group])
    return out.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before")


def grow(nodes: DataFrame, group: str, step: int = STEP) -> list[DataFrame]:
    """The stored levels of the trees over ``nodes(group, pos, n, node)``, lowest first: one row an aligned subtree,
    ``group, block, n, nodes``, where n counts the group's nodes at this level. ``node`` is a struct with a ``digest``."""
    width, levels = 1 << step, []
    while True:
        block = F.floor(F.col("pos") / width).cast("long").alias("block")
        inside = F.sort_array(F.collect_list(F.struct("pos", "node")))
        rows = nodes.groupBy(group, block).agg(F.max("n").alias("n"), inside.alias("held"))
        levels.append(stored(rows.select(group, "block", "n", F.transform("held", lambda x: x["node"]).alias("nodes")), "level"))
        open_ = levels[-1].filter(F.col("n") > width)
        if open_.isEmpty():
            return levels
        n = F.ceil(F.col("n") / width).cast("long").alias("n")
        nodes = _roots(open_, group, step).select(group, F.col("block").alias("pos"), n, F.struct("digest").alias("node"))


def _roots(blocks: DataFrame, group: str, step: int) -> DataFrame:
    """The root of each subtree."""
    height = _height(F.col("n"), step)
    levels = _subtree(F.col("nodes.digest"), height)
    return blocks.select(group, "block", "n", F.get(F.element_at(levels, -1), F.lit(0)).alias("digest"))


def group_roots(levels: list[DataFrame], group: str, step: int = STEP) -> DataFrame:
    """``group, digest``: what remains of each group."""
    done = [_roots(level.filter(F.col("n") <= 1 << step), group, step).select(group, "digest") for level in levels]
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _members(step: int) -> Column:
    """The nodes of a stored subtree with their place and all their siblings. The nodes between are made once a row."""
    height = _height(F.col("n"), step)

    def ways(made: Column) -> Column:
        way = lambda p: F.concat(_siblings(made, p, height), F.col("siblings"))
        return F.transform("nodes", lambda node, p: F.struct(node.alias("node"), p.alias("place"), way(p).alias("siblings")))

    return let(_subtree(F.col("nodes.digest"), height), ways)


def extracted(levels: list[DataFrame], group: str, above: DataFrame, step: int = STEP) -> DataFrame:
    """The node of every leaf with ``siblings`` up to its group's root, followed by those of ``above(group, siblings,
    ...)``, whose other columns come along. Levels from the top down; only the level below keeps its result."""
    carried = [c for c in above.columns if c not in (group, "siblings")]
    wide, below = F.col("n") > 1 << step, None
    for i, level in reversed(list(enumerate(levels))):
        rows = join_null_safe(level.filter(~wide), above, [group])
        if below is not None:
            rows = rows.unionByName(join_null_safe(level.filter(wide), below, [group, "block"]))
        made = rows.select(group, "block", *carried, F.inline(_members(step)))
        if i == 0:
            return made.select(group, "node", "siblings", *carried)
        pos = (F.col("block") * (1 << step) + F.col("place")).alias("block")
        below = stored(made.select(group, pos, "siblings", *carried), "siblings")


def manifest(leaves: DataFrame, step: int = STEP) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Trees over ``leaves(grp, key, digest, ...)``: the stored levels of the groups, those over the groups' roots, and
    ``grp, root`` with the one root of all (no row without leaves). Other columns of a leaf stay beside its digest."""
    node = F.struct("digest", *[c for c in leaves.columns if c not in ("grp", "digest")]).alias("node")
    levels = grow(placed(leaves, "grp", ["key", "digest"]).select("grp", "pos", "n", node), "grp", step)
    roots = group_roots(levels, "grp", step).select(F.lit(0).alias("all"), F.col("grp").alias("name"), "digest")
    top = placed(roots, "all", ["name"]).select("all", "pos", "n", F.struct("digest", "name").alias("node"))
    over = grow(top, "all", step)
    return levels, over, group_roots(over, "all", step).select("all", F.col("digest").alias("root"))


def proofs(levels: list[DataFrame], over: list[DataFrame], root: DataFrame, step: int = STEP) -> DataFrame:
    """Each leaf (its own columns), its group ``grp`` and ``subroot``, ``root`` and ``siblings`` from it up to the root."""
    start = root.select("all", "root", F.array().cast(_ENTRY).alias("siblings"))
    above = extracted(over, "all", start, step)
    above = above.select(F.col("node.name").alias("grp"), "siblings", F.col("node.digest").alias("subroot"), "root")
    return extracted(levels, "grp", stored(above, "above"), step).select("grp", "node.*", "siblings", "subroot", "root")


_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, source, text, n_chars, doc_id IS NOT NULL AND
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 7 = 0 AS tampered
  FROM documents),
fields AS (
  SELECT doc_id, lang, tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM docs),
digests AS (
  SELECT doc_id, lang, sha256(head || n || body) AS leaf, sha256(head || CASE WHEN tampered THEN n1 ELSE n END || body) AS shown FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests),
tree AS (
  SELECT 0 AS level, lang, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS many FROM tree) WHERE many > 1 GROUP BY level, lang, pos // 2),
height AS (SELECT lang, max(level) AS top FROM tree GROUP BY lang),
subroots AS (
  SELECT t.lang, t.h, h.top, row_number() OVER (ORDER BY t.lang NULLS FIRST) - 1 AS pos
  FROM tree t JOIN height h ON t.lang IS NOT DISTINCT FROM h.lang AND t.level = h.top),
over AS (
  SELECT 0 AS level, pos, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS many FROM over) WHERE many > 1 GROUP BY level, pos // 2),
root AS (SELECT level AS top, h FROM over ORDER BY level DESC LIMIT 1),
levels AS (SELECT unnest(range(64)) AS level),
steps AS (
  SELECT l.lang, l.pos, k.level AS step, (l.pos >> k.level) % 2 = 1 AS on_left, s.h AS other
  FROM leaves l JOIN height h ON l.lang IS NOT DISTINCT FROM h.lang JOIN levels k ON k.level < h.top
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = k.level AND s.pos = xor(l.pos >> k.level, 1)
  UNION ALL
  SELECT l.lang, l.pos, s.top + k.level, (s.pos >> k.level) % 2 = 1, o.h
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN root r ON true JOIN levels k ON k.level < r.top
  LEFT JOIN over o ON o.level = k.level AND o.pos = xor(s.pos >> k.level, 1)),
ways AS (
  SELECT l.lang, l.pos, sha256(coalesce(string_agg(p.other, '' ORDER BY p.step), '')) AS proof, count(p.step) AS long
  FROM leaves l LEFT JOIN steps p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos GROUP BY l.lang, l.pos),
fold AS (
  SELECT 0 AS step, lang, pos, shown AS h FROM leaves
  UNION ALL
  SELECT f.step + 1, f.lang, f.pos, sha256(CASE WHEN p.on_left THEN coalesce(p.other, '') || f.h ELSE f.h || coalesce(p.other, '') END)
  FROM fold f JOIN steps p ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.step = p.step)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, w.proof AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN root r ON true
JOIN ways w ON w.lang IS NOT DISTINCT FROM l.lang AND w.pos = l.pos
JOIN fold f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.step = w.long
"""


@query("op11_merkle_manifest", _SQL)
def merkle_manifest(spark, folder):
    """Proofs of all documents; where 7 divides the checksum of the id, the row shown has one character more."""
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {"n_chars": F.col("n_chars") + 1}
    # The field that changes is chosen, so that a text is hashed a second time only where it does.
    shown = F.when(tampered & F.col("n_chars").isNotNull(), row_digest(list(changed.values())))
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), row_digest(list(fields.values())).alias("digest"), shown.alias("shown"))
    out = proofs(*manifest(leaves)).withColumn("folded_root", folded(F.coalesce("shown", "digest"), F.col("siblings")))
    return out.select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join("siblings.other", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
