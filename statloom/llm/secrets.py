"""Secret scans with an incremental blob ledger.

A path (here a document) may have many versions, and most versions of most paths are the same bytes. So texts are
content-addressed: each distinct blob is scanned once per rule version, the finding goes to a ledger in shared storage,
and findings are joined back to every path that holds the blob. A later run scans only the pairs of blob and rule
version that the ledger doesn't have. Only DataFrame functions are used.

A null text is an empty blob and has no findings. Every row of the input gives one row, also repeated or null ids.
An empty table gives no rows. Other columns of the input don't matter. Positions count code points; ends are exclusive.
Very long texts are scanned whole, once per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.registry import query, table, unused
from statloom.session import fresh_dir

LEDGER = "blob string, rule string, version int, found array<struct<start:int,end:int,kind:string,place:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, not overlapping; a match stays if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: Letter classes instead of a flag, so that every engine folds ASCII letters only.
_NAMES = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is a run that stays
)


def _matches(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in one text: the pieces between matches give the positions."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    kept = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    span = "struct<start:int,end:int,kind:string,place:int>"
    table_ = F.arrays_zip(whole.alias("m"), F.slice(between, 1, F.size(whole)).alias("b"), kept.alias("k"))
    # One pass: the position reached so far and the spans that stay.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(state, item):
        begin = state["at"] + F.length(item["b"])
        end = begin + F.length(item["m"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(place).alias("place"))
        out = F.when(F.length(item["k"]) >= rule.least, F.concat(state["out"], F.array(one))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(table_, start, step, lambda s: s["out"])).otherwise(
        F.array().cast(f"array<{span}>")
    )


def scan(documents: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``blob`` and ``found`` (spans by start, then place of the rule) for every row; the ledger at path
    ``ledger`` gets what it lacked."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.sha2("text", 256))
    _extend(texts, ledger, rules)
    return texts.select("doc_id", "blob").join(_known(documents, ledger, rules), "blob", "left").select("doc_id", "blob", _ordered("found"))


def redact(documents: DataFrame, ledger: str, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span found replaced by ``mask``; spans that overlap are one. Rows and columns stay;
    ``n_chars``, if there is one, follows the text."""
    blob = F.sha2(F.coalesce("text", F.lit("")), 256)
    _extend(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob), ledger, rules)
    b, found = unused(documents, "__blob", "__found")
    known = _known(documents, ledger, rules).select(F.col("blob").alias(b), F.col("found").alias(found))
    joined = documents.join(known, blob == F.col(b), "left")
    # From the last span to the first, so that earlier positions stay right; ``left`` is where the text after begins.
    spans = F.reverse(_ordered(found))
    start = F.struct(F.lit("").alias("after"), F.length("text").alias("left"))

    def step(state, span):
        after = F.concat(F.lit(mask), _cut(span["end"], state["left"]), state["after"])
        return F.struct(after.alias("after"), span["start"].alias("left"))

    masked = F.aggregate(_merged(spans), start, step, lambda s: F.concat(_cut(F.lit(0), s["left"]), s["after"]))
    text = F.when(F.size(found) > 0, masked).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        changed = F.when(F.size(found) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(documents.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])


def _cut(begin: Column, end: Column) -> Column:
    return F.substring(F.col("text"), begin + 1, end - begin)


def _merged(spans_from_last: Column) -> Column:
    """Spans sorted from last to first, with those that overlap made one."""
    kind = "array<struct<start:int,end:int>>"

    def step(out, x):
        one = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        last = F.try_element_at(out, F.lit(-1))
        both = F.struct(F.least(x["start"], last["start"]).alias("start"), F.greatest(x["end"], last["end"]).alias("end"))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))
        return F.when(last["start"] < x["end"], joined).otherwise(F.concat(out, F.array(one)))

    return F.aggregate(spans_from_last, F.array().cast(kind), step)


_FOUND = "array<struct<start:int,end:int,kind:string,place:int>>"


def _ordered(found: str) -> Column:
    by_place = F.array_sort(
        F.coalesce(found, F.array().cast(_FOUND)),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["place"] - b["place"]),
    )
    return by_place.alias("found")


def _known(documents: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of the wanted rule versions by blob."""
    wanted = " OR ".join(f"(rule = '{r.kind}' AND version = {r.version})" for r in rules)
    return (
        documents.sparkSession.read.schema(LEDGER).parquet(ledger).filter(wanted).filter("size(found) > 0")
        .dropDuplicates(["blob", "rule", "version"])
        .groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))  # one entry for each rule
    )


def _extend(texts: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> None:
    """Scan every pair of blob and rule version that is not in the ledger and append it. Each run appends files of its
    own; a pair that two runs add at a time is the same row twice."""
    spark = texts.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = (
        spark.read.schema(LEDGER).parquet(ledger).select("blob", F.concat_ws(":", "rule", "version").alias("pair"))
        .groupBy("blob").agg(F.collect_set("pair").alias("seen"))
    )
    # The first path of each blob stands for it, so no text is grouped; copies of one blob meet in partial sums. Equal
    # rows of one path are one.
    blobs = texts.groupBy("blob").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-1)), "doc_id")["doc_id"]).alias("doc_id"))
    pairs = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    todo = (
        blobs.join(seen, "blob", "left")
        .select("blob", "doc_id", F.array_except(pairs, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        .filter("size(todo) > 0")
    )
    one = texts.dropDuplicates(["blob", "doc_id"]).withColumnsRenamed({"blob": "b", "doc_id": "d"}).join(todo, (F.col("b") == F.col("blob")) & F.col("d").eqNullSafe(F.col("doc_id")))
    lines = F.array(*[
        F.struct(
            "blob", F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
            F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), _matches(F.col("text"), r, i)).alias("found"),
        )
        for i, r in enumerate(rules)
    ])
    one.select(F.inline(lines)).filter("found IS NOT NULL").write.mode("append").parquet(ledger)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind, the spans as text and their SHA-256."""

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in rules]
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _sql() -> str:
    def of(rule: Rule, place: int) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""list_filter(list_transform(range(1, len(m{place}) + 1), lambda i: {{
          's': CAST(list_sum(list_transform(b{place}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{place}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
          'p': {place}, 'kind': '{rule.kind}', 'n': length(m{place}[i]), 'k': length(k{place}[i])}}), lambda x: x.k >= {rule.least})""", pattern

    parts = [of(r, i) for i, r in enumerate(RULES)]
    pieces = ", ".join(
        f"regexp_extract_all(t, '{p}') AS m{i}, regexp_split_to_array(t, '{p}') AS b{i}, regexp_extract_all(t, '{p}', {RULES[i].group}) AS k{i}"
        for i, (_, p) in enumerate(parts)
    )
    counts = ", ".join(f"CAST(len(list_filter(f, lambda x: x.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {pieces} FROM d),
f AS (SELECT doc_id, list_sort(flatten([{", ".join(x for x, _ in parts)}])) AS f FROM m),
j AS (SELECT doc_id, {counts}, coalesce(array_to_string(list_transform(f, lambda x: x.kind || ':' || x.s || ':' || (x.s + x.n)), ','), '') AS spans FROM f)
SELECT doc_id, {", ".join(f"n_{r.kind}" for r in RULES)}, sha256(spans) AS base_sha256, spans FROM j"""


@query("op3_secret_ledger", _sql())
def secret_ledger(spark, folder):
    """Secrets in all documents, through a new ledger."""
    return digest(scan(table(spark, folder, "documents"), fresh_dir(spark, "ledger")))
