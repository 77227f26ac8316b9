"""JSON payloads: API arrays, flat objects, nested documents and result dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import numbers
from statloom.functions import rules as R
from statloom.functions.common import col, each
from statloom.functions.text import parse_json
from statloom.session import cut_lineage

#: Depth up to which all documents are walked in one chain, and levels between two checkpoints of a chain.
BAND = 12
CHAIN = 24
_ITEM = (
    "array<struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,date:string,value:double>>"
)


def api_items(payloads: DataFrame, content: str = "content") -> DataFrame:
    """``[meta, [items]]`` payloads: one row per item with a numeric value."""
    items = F.from_json(F.get_json_object(content, "$[1]"), _ITEM)
    keep = [c for c in payloads.columns if c != content]
    rows = each(payloads, keep, items, "item", "idx").filter("item.value IS NOT NULL")
    date = F.coalesce("item.date", F.col("idx").cast("string"))
    indicator = F.coalesce("item.indicator.value", F.lit("GDP"))
    country = F.coalesce("item.country.value", F.lit("Tunisia"))
    return rows.select(
        *keep, "idx", F.concat_ws("_", F.lit("wb"), date, F.col("idx").cast("string")).alias("obs_key"),
        F.concat_ws(" ", indicator, country, date).alias("indicator_name"), F.col("item.value").alias("value"),
        F.lit("USD").alias("unit"), F.lit("json_worldbank").alias("method"), F.lit(0.95).alias("confidence_score"),
        F.when(date.rlike("^[0-9]+$"), date.try_cast("int")).otherwise(R.DEFAULT_YEAR).alias("year"),
    )


#: One extracted value, as the extraction arrays hold it.
OBSERVATION = (
    "struct<method:string,obs_key:string,o1:int,o2:int,o3:int,indicator_name:string,value:double,unit:string,year:int,"
    "raw_text:string,confidence_score:double>"
)


def _observed(method: str, key: Column, place, name: Column, value: Column, unit: str, year, raw: Column, confidence: float) -> Column:
    return F.struct(
        F.lit(method).alias("method"), key.alias("obs_key"), place.cast("int").alias("o1"), F.lit(None).cast("int").alias("o2"),
        F.lit(None).cast("int").alias("o3"), name.alias("indicator_name"), value.alias("value"), F.lit(unit).alias("unit"),
        year.cast("int").alias("year"), raw.alias("raw_text"), F.lit(confidence).alias("confidence_score"),
    )


def api_items_array(content) -> Column:
    """As :func:`api_items`, as one array per payload; other payloads have an empty one."""
    items = F.from_json(F.get_json_object(col(content), "$[1]"), _ITEM)

    def row(item: Column, idx: Column) -> Column:
        date = F.coalesce(item["date"], idx.cast("string"))
        indicator = F.coalesce(item["indicator"]["value"], F.lit("GDP"))
        country = F.coalesce(item["country"]["value"], F.lit("Tunisia"))
        return _observed(
            "json_worldbank", F.concat_ws("_", F.lit("wb"), date, idx.cast("string")), idx, F.concat_ws(" ", indicator, country, date),
            item["value"], "USD", F.when(date.rlike("^[0-9]+$"), date.try_cast("int")).otherwise(R.DEFAULT_YEAR), F.to_json(item), 0.95,
        )

    found = F.filter(F.transform(items, row), lambda m: m["value"].isNotNull())
    return F.coalesce(found, F.array().cast(f"array<{OBSERVATION}>"))


def flat_numbers_array(content) -> Column:
    """As :func:`flat_numbers`, as one array per payload; what is no JSON object has an empty one."""
    members = F.map_entries(F.try_variant_get(parse_json(content), "$", "map<string,variant>"))

    def row(member: Column, idx: Column) -> Column:
        value, key = number_of(member["value"]), member["key"]
        raw = F.concat(key, F.lit(": "), value.cast("string"))
        return _observed("json_generic", F.concat(F.lit("json_"), key), idx, key, value, "", F.lit(None), raw, 0.8)

    numeric = F.filter(F.transform(members, row), lambda m: m["value"].isNotNull() & numbers.is_quick_value(m["value"]))
    return F.coalesce(numeric, F.array().cast(f"array<{OBSERVATION}>"))


def _exploded(df: DataFrame, variant: str, outer: bool = False) -> DataFrame:
    """Adds pos, key and value of each member of a variant object or array."""
    tvf = df.sparkSession.tvf
    members = tvf.variant_explode_outer(F.col(variant).outer()) if outer else tvf.variant_explode(F.col(variant).outer())
    return df.lateralJoin(members)


def flat_numbers(payloads: DataFrame, content: str = "content") -> DataFrame:
    """Numeric top-level members of JSON objects that pass the quick value test; booleans count as
    numbers."""
    keep = [c for c in payloads.columns if c != content]
    parsed = payloads.select(*keep, parse_json(content).alias("doc")).filter(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")))
    members = _exploded(parsed, "doc").withColumn("value", number_of("value"))
    kept = members.filter(F.col("value").isNotNull() & numbers.is_quick_value("value"))
    return kept.select(
        *keep, F.concat(F.lit("json_"), "key").alias("obs_key"), F.col("key").alias("indicator_name"), "value",
        F.lit("").alias("unit"), F.concat("key", F.lit(": "), F.col("value").cast("string")).alias("raw_text"),
        F.lit("json_generic").alias("method"), F.lit(0.8).alias("confidence_score"),
    )


def number_of(variant) -> Column:
    """Value of a numeric or boolean variant, null for other kinds (text is not converted)."""
    variant = col(variant)
    kind = F.schema_of_variant(variant)
    number = F.try_variant_get(variant, "$", "double")
    flag = F.try_variant_get(variant, "$", "boolean").cast("int").cast("double")
    return F.when(kind == "BOOLEAN", flag).when(kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), number)


def nesting(content) -> Column:
    """How deep the containers of a JSON text are nested, 0 without any. Texts are taken out first, then brackets are
    counted in one linear fold."""
    brackets = F.regexp_replace(F.regexp_replace(col(content), r'(?s)"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    deeper = lambda s, d: F.struct((s["at"] + d).alias("at"), F.greatest(s["most"], s["at"] + d).alias("most"))
    return F.coalesce(F.reduce(steps, zero, deeper, lambda s: s["most"]), F.lit(0))


def walk(documents: DataFrame, content: str = "content", stop_at: str | None = None) -> DataFrame:
    """Every leaf of a JSON document with its path. Level by level: a container is replaced by its members, a leaf stays
    one row, so the plan is a chain of lateral joins without unions.

    The depth comes from the data: one pass over the texts gives the largest nesting, which ends the chain. Documents
    much deeper than others are walked apart, in bands of at most four times the depth of the band before, so that
    shallow ones don't pay for them; long chains are checkpointed.

    Adds ``path`` (array of steps), ``last_key`` (null directly inside a list) and ``node``. With ``stop_at`` an object
    below that key is kept whole."""
    deepest = documents.agg(F.max(nesting(content))).first()[0] or 0  # one number
    if deepest <= BAND:
        return _walked(documents, content, deepest, stop_at)
    bands, low, high = [], -1, BAND
    while low < deepest:
        inside = documents.filter((nesting(content) > low) & (nesting(content) <= high))
        bands.append(_walked(inside, content, min(high, deepest), stop_at))
        low, high = high, 4 * high
    out = bands[0]
    for more in bands[1:]:
        out = out.union(more)
    return out


def _walked(documents: DataFrame, content: str, depth: int, stop_at: str | None) -> DataFrame:
    keep = [c for c in documents.columns if c != content]
    level = documents.select(
        *keep, parse_json(content).alias("node"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("last_key")
    )
    for k in range(depth):
        kind = F.schema_of_variant("node")
        opens = kind.rlike("^(?:OBJECT|ARRAY)")
        if stop_at is not None:
            opens = opens & ~(F.coalesce(F.col("last_key") == stop_at, F.lit(False)) & F.startswith(kind, F.lit("OBJECT")))
        marked = level.withColumn("inner", F.when(opens, F.col("node")))
        members = _exploded(marked, "inner", outer=True)
        is_member = F.col("pos").isNotNull()
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = members.select(
            *keep,
            F.when(is_member, F.col("value")).otherwise(F.col("node")).alias("node"),
            F.when(is_member, F.array_append("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(is_member, F.col("key")).otherwise(F.col("last_key")).alias("last_key"),
        )
        if (k + 1) % CHAIN == 0 and k + 1 < depth:
            level = cut_lineage(level)
    return level


def nested_numbers(documents: DataFrame, content: str = "content") -> DataFrame:
    """Numeric fields at any depth. Scalars directly inside lists and the keys id, code and status
    are skipped."""
    leaves = walk(documents, content).filter(
        F.col("last_key").isNotNull() & ~F.lower("last_key").isin("id", "code", "status")
    )
    keep = [c for c in documents.columns if c != content]
    return leaves.select(
        *keep, F.array_join("path", "_").alias("obs_key"), F.col("last_key").alias("indicator_name"), number_of("node").alias("value")
    ).filter("value IS NOT NULL")


def value_maps(documents: DataFrame, content: str = "content", key: str = "extracted_values") -> DataFrame:
    """Every object below the key at any depth, with its path and its number of entries."""
    keep = [c for c in documents.columns if c != content]
    found = walk(documents, content, stop_at=key).filter(
        (F.col("last_key") == key) & F.startswith(F.schema_of_variant("node"), F.lit("OBJECT"))
    )
    shown = F.transform("path", lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("."), s)))
    entries = F.size(F.map_keys(F.try_variant_get("node", "$", "map<string,variant>")))
    return found.select(*keep, F.ltrim(F.array_join(shown, ""), F.lit(".")).alias("path"), entries.alias("n_values"))


_RECORD = "struct<value:double,raw_text:string,indicator_name:string,category:string,unit:string,year:int,confidence_score:double,is_target_indicator:boolean>"
_FIGURE = "struct<value:double,unit:string,indicator_name:string,category:string,confidence:double,is_priority_indicator:boolean>"
DUMP_SCHEMA = (
    "struct<task_id:string,status:string,results:array<struct<url:string,content:struct<structured_data:struct<"
    f"target_indicators:map<string,{_FIGURE}>,key_figures:map<string,{_FIGURE}>,"
    "tables_data:array<struct<rows:array<map<string,string>>>>,"
    f"extracted_values:map<string,{_RECORD}>>>>>>"
)


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Result dumps, one JSON document per file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return dump_observations(files.select(F.col("_metadata.file_name").alias("dump_id"), F.col("value").alias("content")))


def dump_observations(dumps: DataFrame, content: str = "content") -> DataFrame:
    """Observation map of every result as rows; the key gives the method and up to three ordinals."""
    parsed = dumps.select("dump_id", F.from_json(content, DUMP_SCHEMA).alias("d"))
    results = each(parsed, ("dump_id", "d.task_id"), F.col("d.results"), "r", "result_idx")
    values = F.map_entries("r.content.structured_data.extracted_values")
    rows = each(results, ("dump_id", "task_id", "result_idx", F.col("r.url").alias("url")), values, "e")
    place = F.regexp_extract_all("e.key", F.lit(r"_([0-9]+)"), F.lit(1))
    return rows.select(
        "dump_id", "task_id", "result_idx", "url", F.col("e.key").alias("obs_key"),
        F.regexp_extract("e.key", r"^([a-zA-Z]+)", 1).alias("method"),
        *[F.get(place, F.lit(i)).try_cast("int").alias(f"o{i + 1}") for i in range(3)],
        "e.value.*",
    )


def structure_profile(records: DataFrame, content: str = "content") -> DataFrame:
    """Per top-level key and JSON type: how many records, and the total length of the values."""
    parsed = records.select(parse_json(content).alias("doc")).filter("doc IS NOT NULL")
    kind = F.regexp_extract(F.schema_of_variant("value"), "^([A-Z]+)", 1)
    members = _exploded(parsed, "doc").select("key", kind.alias("kind"), F.length(F.to_json("value")).alias("size"))
    return members.groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("total_length"))


def marker_presence(records: DataFrame, markers: list[str], content: str = "content") -> DataFrame:
    """How many records mention each marker."""
    counted = records.agg(*[F.count_if(F.contains(content, F.lit(m))).alias(m) for m in markers])
    return counted.unpivot([], markers, "marker", "n")


def all_values(dumps: DataFrame, content: str = "content") -> DataFrame:
    """Value collections of all results of each dump as one relation: dump_id, collection,
    name, value, unit, category, confidence, is_priority."""
    results = each(dumps, ("dump_id",), F.from_json(content, DUMP_SCHEMA)["results"], "r")
    data = results.select("dump_id", F.col("r.content.structured_data").alias("s"))

    def figures(source: str, collection: str) -> DataFrame:
        rows = each(data, ("dump_id",), F.map_entries(F.col(f"s.{source}")), "e").filter("e.value.value IS NOT NULL")
        v = "e.value"
        name = F.coalesce(f"{v}.indicator_name", "e.key") if source == "target_indicators" else F.col("e.key")
        return rows.select(
            "dump_id", F.lit(collection).alias("collection"), name.alias("name"), F.col(f"{v}.value").alias("value"),
            F.coalesce(f"{v}.unit", F.lit("unknown")).alias("unit"), F.coalesce(f"{v}.category", F.lit("unknown")).alias("category"),
            F.coalesce(f"{v}.confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce(f"{v}.is_priority_indicator", F.lit(False)).alias("is_priority"),
        )

    tables = each(data, ("dump_id",), F.col("s.tables_data"), "tab")
    rows = each(tables, ("dump_id",), F.col("tab.rows"), "row")
    cells = each(rows, ("dump_id", F.col("row")["indicator_name"].alias("row_name")), F.map_entries("row"), "e")
    cell_value = F.get_json_object("e.value", "$.value").try_cast("double")
    in_tables = cells.select(
        "dump_id", F.lit("table_values").alias("collection"), F.coalesce("row_name", "e.key").alias("name"),
        cell_value.alias("value"), F.coalesce(F.get_json_object("e.value", "$.unit"), F.lit("unknown")).alias("unit"),
        F.lit("unknown").alias("category"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_priority"),
    ).filter("value IS NOT NULL")
    return figures("target_indicators", "target_indicators").unionByName(figures("key_figures", "key_figures")).unionByName(in_tables)


def collection_counts(dumps: DataFrame, content: str = "content") -> DataFrame:
    """Number of values per collection over all results, in place, without exploding."""
    staged = dumps.select("dump_id", F.from_json(content, DUMP_SCHEMA)["results"]["content"]["structured_data"].alias("s"))

    def total(numbers) -> Column:
        return F.coalesce(F.aggregate(numbers, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0))), F.lit(0))

    def valued(source: str) -> Column:
        return total(F.transform("s", lambda d: F.size(F.filter(F.map_values(d[source]), lambda v: v["value"].isNotNull()))))

    def in_rows(tables) -> Column:
        rows = F.flatten(F.filter(F.transform(tables, lambda t: t["rows"]), lambda r: r.isNotNull()))
        return total(F.transform(rows, lambda r: F.size(F.filter(F.map_values(r), lambda c: F.get_json_object(c, "$.value").isNotNull()))))

    return staged.select(
        "dump_id",
        valued("target_indicators").alias("target_indicators"),
        valued("key_figures").alias("key_figures"),
        total(F.transform("s", lambda d: in_rows(d["tables_data"]))).alias("table_values"),
        valued("extracted_values").alias("extracted_values"),
    )
