"""Numbers, units, text and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import html, labels, numbers, text, units, years
from statloom.functions import rules as R
from statloom.operators import extraction, records
from statloom.plans.oracle import (
    noise_pattern,
    clean_number, has, labels as case_labels, number, page_text, rx, text as lit, with_views,
)
from statloom.plans.registry import query

_OBS = with_views("obs")
_NOTES = with_views("notes")
_TASKS = with_views("tasks")


@query("N01_parse_european", "o1:L parsed:D parsed_name:D",
       f"{_OBS} SELECT o1, {number('value_text')} AS parsed, {number('indicator_name')} AS parsed_name FROM obs")
def _(t):
    return t.view("obs").select("o1", numbers.parse_european("value_text").alias("parsed"),
                                numbers.parse_european("indicator_name").alias("parsed_name"))


@query("N02_parse_or_zero", "o1:L parsed:D", f"{_OBS} SELECT o1, coalesce({number('value_text')}, 0) AS parsed FROM obs")
def _(t):
    return t.view("obs").select("o1", numbers.parse_or_zero("value_text").alias("parsed"))


@query("N03_parse_clean", "o1:L parsed:D parsed_signed:D", f"""
{_OBS} SELECT o1, {clean_number('value_text')} AS parsed, {clean_number("'+' || value_text")} AS parsed_signed FROM obs""")
def _(t):
    signed = F.concat(F.lit("+"), F.col("value_text"))
    return t.view("obs").select("o1", numbers.parse_clean("value_text").alias("parsed"),
                                numbers.parse_clean(signed).alias("parsed_signed"))


_N04_INPUT = "CASE o1 % 4 WHEN 0 THEN value_text WHEN 1 THEN concat(CAST(o1 AS VARCHAR), '/', CAST(o1 % 9 AS VARCHAR)) WHEN 2 THEN concat(' ', CAST(o1 % 20 AS VARCHAR), ',5 % ') ELSE concat('www.x/', value_text) END"


@query("N04_parse_table_value", "o1:L parsed:D", f"""
{_OBS}, a AS (SELECT o1, trim({_N04_INPUT}) AS x FROM obs),
b AS (SELECT *, TRY_CAST(regexp_extract(x, '^([0-9]+)/([0-9]+)$', 1) AS DOUBLE) AS num, TRY_CAST(regexp_extract(x, '^([0-9]+)/([0-9]+)$', 2) AS DOUBLE) AS den,
  CASE WHEN contains(x, ',') AND contains(x, '.') THEN
         CASE WHEN instr(reverse(x), ',') < instr(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.') ELSE x END
       ELSE replace(x, ',', '.') END AS d FROM a)
SELECT o1, CASE WHEN x = '' OR length(x) > 50 OR {has('lower(x)', ['http', 'www', '@', '#', 'javascript'])} THEN NULL
  WHEN num IS NOT NULL AND (num > 1000 OR den > 1000 OR (num < 10 AND den < 10 AND num < den)) THEN NULL
  WHEN contains(x, '%') THEN TRY_CAST(trim(replace(x, '%', '')) AS DOUBLE)
  WHEN num IS NOT NULL THEN CASE WHEN den <> 0 THEN num / den END
  ELSE TRY_CAST(regexp_replace(regexp_replace(d, '([0-9])\\s+([0-9])', '\\1\\2', 'g'), '[^0-9.-]', '', 'g') AS DOUBLE) END AS parsed
FROM b""")
def _(t):
    source = F.expr(_N04_INPUT.replace("VARCHAR", "STRING"))
    return t.view("obs").select("o1", numbers.parse_table_value(source).alias("parsed"))


@query("N05_first_number", "doc_id:L first_number:D", f"""
{_NOTES} SELECT doc_id, TRY_CAST(replace(nullif(regexp_extract(text, '([0-9]+[,.]?[0-9]*)', 1), ''), ',', '.') AS DOUBLE) AS first_number FROM notes""")
def _(t):
    return t.view("notes").select("doc_id", numbers.first_number("text").alias("first_number"))


@query("N06_all_numbers", "doc_id:L n:L total:D listed:S", f"""
{_NOTES}, n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\b[0-9]+[.,]?[0-9]*\\b'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)) AS xs FROM notes)
SELECT doc_id, len(xs) AS n, coalesce(list_sum(xs), 0) AS total, array_to_string(list_transform(xs, lambda x: CAST(floor(x) AS BIGINT)::VARCHAR), ' ') AS listed FROM n""")
def _(t):
    found = t.view("notes").select("doc_id", numbers.all_numbers("text").alias("xs"))
    return found.select(
        "doc_id", F.size("xs").alias("n"), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.array_join(F.transform("xs", lambda x: F.floor(x).cast("string")), " ").alias("listed"))


def _unit_case(expr: str, pairs, tail: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {rx(p, False)}) THEN {lit(u)}" for p, u in pairs) + f" ELSE {tail} END"


_COMBINED = "lower(value_text || ' ' || indicator_name)"
_UNIT_SQL = _unit_case(_COMBINED, R.UNIT_PATTERNS, "''")
_UNIT_CLEAN_SQL = _unit_case(_COMBINED, R.UNIT_PATTERNS_CLEAN, case_labels("lower(indicator_name)", R.UNIT_BY_NAME_CLEAN, ""))


@query("N07_unit_from_text", "o1:L unit_plain:S unit_clean:S",
       f"{_OBS} SELECT o1, {_UNIT_SQL} AS unit_plain, {_UNIT_CLEAN_SQL} AS unit_clean FROM obs")
def _(t):
    return t.view("obs").select("o1", units.from_text("value_text", "indicator_name").alias("unit_plain"),
                                units.from_text_or_name("value_text", "indicator_name").alias("unit_clean"))


@query("N08_unit_default", "o1:L unit_bank:S unit_office:S unit_context:S", f"""
{_OBS}, o AS (SELECT *, lower(indicator_name) AS n FROM obs)
SELECT o1, CASE WHEN unit <> '' THEN upper(unit) WHEN {has('n', ['taux', 'rate'])} THEN '%' WHEN value > 1000 THEN 'MD' ELSE 'TND' END AS unit_bank,
  CASE WHEN {has('n', ['épargne', 'formation', 'capital'])} THEN CASE WHEN value > 1000 THEN 'MD' ELSE 'MDT' END
    WHEN {has('n', ['taux', 'croissance'])} THEN '%' WHEN {has('n', ['population'])} THEN 'habitants' ELSE 'MD' END AS unit_office,
  CASE WHEN {has('n', ['taux', '%', 'croissance'])} THEN '%' WHEN {has('n', ['pib', 'budget', 'dette'])} THEN CASE WHEN value > 100 THEN 'MD' ELSE 'MDT' END
    WHEN {has('n', ['population'])} THEN 'habitants' ELSE '' END AS unit_context
FROM o""")
def _(t):
    return t.view("obs").select(
        "o1", units.default_bank("indicator_name", "unit", "value").alias("unit_bank"),
        units.default_office("indicator_name", "value").alias("unit_office"),
        units.default_context("indicator_name", "value").alias("unit_context"))


_STANDARD = (
    f"CASE WHEN trim(unit) = '' THEN CASE WHEN {has('lower(indicator_name)', ['taux', 'inflation', 'chomage', '%'])} THEN '%' "
    f"WHEN {has('lower(indicator_name)', ['pib', 'dette', 'budget'])} THEN CASE WHEN value > 1000 THEN 'MD' ELSE 'MDT' END "
    f"WHEN {has('lower(indicator_name)', ['population'])} THEN 'habitants' ELSE '' END "
    + " ".join(f"WHEN contains(lower(unit), {lit(k)}) THEN {lit(v)}" for k, v in R.UNIT_STANDARD)
    + " ELSE trim(unit)[1:10] END"
)


@query("N09_standardise_unit", "o1:L unit_standard:S", f"{_OBS} SELECT o1, {_STANDARD} AS unit_standard FROM obs")
def _(t):
    return t.view("obs").select("o1", units.standardise("unit", "indicator_name", "value").alias("unit_standard"))


_DESCRIBED = "coalesce((MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in R.UNIT_DESCRIPTION.items()) + "})[upper(unit)], unit)"


@query("N10_unit_description", "o1:L described:S", f"{_OBS} SELECT o1, {_DESCRIBED} AS described FROM obs")
def _(t):
    return t.view("obs").select("o1", units.describe("unit").alias("described"))


_CLEAN_NAME = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g'), '\s+', ' ', 'g'))"


@query("N11_clean_name", "o1:L clean_name:S clean_long:S", f"""
{_OBS}, c AS (SELECT o1, {_CLEAN_NAME.format(x='indicator_name')} AS n, {_CLEAN_NAME.format(x="repeat(indicator_name || chr(9) || '  ', 9)")} AS m FROM obs)
SELECT o1, CASE WHEN length(n) > 100 THEN n[1:97] || '...' ELSE n END AS clean_name, CASE WHEN length(m) > 100 THEN m[1:97] || '...' ELSE m END AS clean_long FROM c""")
def _(t):
    long = F.repeat(F.concat("indicator_name", F.lit("\t  ")), F.lit(9))
    return t.view("obs").select("o1", text.clean_name("indicator_name").alias("clean_name"), text.clean_name(long).alias("clean_long"))


@query("N12_clean_text", "page_id:L cell_text:S page_text:S", rf"""
{with_views('sites')} SELECT page_id,
  trim(regexp_replace(regexp_replace(html, '[\x00-\x1f\x7f-\x9f]', '', 'g'), '\s+', ' ', 'g')) AS cell_text,
  regexp_replace(trim(regexp_replace(html, '\s+', ' ', 'g')), '[\x00-\x1f\x7f-\x9f]', '', 'g') AS page_text
FROM sites""")
def _(t):
    return t.view("sites").select("page_id", text.clean_cell("html").alias("cell_text"), text.clean_text("html").alias("page_text"))


@query("N13_truncate_sentence", "doc_id:L at_1000:S at_100:S", f"""
{_NOTES} SELECT doc_id, {" , ".join(
    f"CASE WHEN length(text) <= {n} THEN text WHEN instr(reverse(text[1:{n}]), '.') BETWEEN 1 AND {n} - {int(n * 0.8)} - 1 "
    f"THEN text[1:{n} - instr(reverse(text[1:{n}]), '.') + 1] || '...' ELSE text[1:{n}] || '...' END AS at_{n}" for n in (1000, 100))}
FROM notes""")
def _(t):
    return t.view("notes").select("doc_id", *[text.truncate_sentence("text", n).alias(f"at_{n}") for n in (1000, 100)])


def _ints(expr: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, {rx(pattern)}, 1), lambda y: CAST(y AS INTEGER))"


def _first(values: str, low: int, high: int) -> str:
    return f"list_filter({values}, lambda y: y BETWEEN {low} AND {high})[1]"


def _name_year(expr: str) -> str:
    parts = []
    for p in R.YEAR_NAME_PATTERNS:
        v = _ints(f"lower({expr})", p)
        parts += [_first(v, 2018, 2025), f"list_max(list_filter({v}, lambda y: y BETWEEN 1900 AND 2030))"]
    return "coalesce(" + ", ".join(parts) + ")"


def _vote(values: str) -> str:
    return (
        f"(SELECT y FROM (SELECT y, count(*) AS n, min(i) AS i FROM (SELECT unnest({values}) AS y, "
        f"unnest(range(len({values}))) AS i) GROUP BY y) ORDER BY n DESC, i LIMIT 1)"
    )


def _text_year(expr: str) -> str:
    contextual = ", ".join(_first(_ints(f"lower({expr})", p), 2018, 2025) for p in R.YEAR_TEXT_PATTERNS)
    vote = _vote(_ints(expr, r"\b(20(?:1[8-9]|2[0-5]))\b"))
    return f"coalesce({contextual}, {vote})"


@query("N14_year_from_name", "o1:L name_year:I", f"{_OBS} SELECT o1, {_name_year('indicator_name')} AS name_year FROM obs")
def _(t):
    return t.view("obs").select("o1", years.from_name("indicator_name").alias("name_year"))


@query("N15_year_from_text", "doc_id:L text_year:I", f"{_NOTES} SELECT doc_id, {_text_year('text')} AS text_year FROM notes")
def _(t):
    return t.view("notes").select("doc_id", years.from_text("text").alias("text_year"))


_HEADER_YEAR = "CASE WHEN length(text) <= 5000 THEN coalesce(" + ", ".join(
    _first(_ints("lower(text[1:2000])", p), 2018, 2025) for p in R.YEAR_HEADER_PATTERNS) + ") END"
_CANDIDATES = "list_filter(flatten([" + ", ".join(_ints("lower(text[1:1500])", p) for p in R.YEAR_CONTEXT_PATTERNS) + "]), lambda y: y BETWEEN 2018 AND 2025)"


@query("N16_year_from_header", "doc_id:L header_year:I context_year:I", f"""
{_NOTES} SELECT doc_id, {_HEADER_YEAR} AS header_year, CASE WHEN length(text) <= 5000 THEN {_vote(_CANDIDATES)} END AS context_year FROM notes""")
def _(t):
    return t.view("notes").select("doc_id", years.from_header("text").alias("header_year"), years.from_context_vote("text").alias("context_year"))


_WIDE = ", ".join(_first(_ints("indicator_name", p), 1900, 2030) for p in R.YEAR_WIDE_NAME_PATTERNS)
_RAW = "concat('{\"date\": \"', CAST(2012 + o1 % 15 AS VARCHAR), '\"} en ', CAST(2011 + o1 % 16 AS VARCHAR), ' ', value_text)"


@query("N17_year_cascade", "o1:L strict_year:I wide_year:I strict_no_fallback:I", f"""
{_OBS}, r AS (SELECT *, {_RAW} AS raw FROM obs)
SELECT o1, coalesce(CASE WHEN year BETWEEN 1900 AND 2030 THEN year END, {_name_year('indicator_name')}, {_text_year('raw')}, 2024) AS strict_year,
  coalesce(CASE WHEN year BETWEEN 1900 AND 2030 THEN year END, {_WIDE}, {_first(_ints('raw', R.YEAR_JSON_PATTERNS[0]), 2018, 2025)}, 2024) AS wide_year,
  coalesce(CASE WHEN year BETWEEN 1900 AND 2030 THEN year END, {_name_year('indicator_name')}, {_text_year('raw')}) AS strict_no_fallback
FROM r""")
def _(t):
    raw = F.expr(_RAW.replace("VARCHAR", "STRING"))
    obs = t.view("obs").withColumn("raw", raw)
    return obs.select(
        "o1", years.strict_cascade("year", "indicator_name", "raw").alias("strict_year"),
        years.wide_cascade("year", "indicator_name", "raw").alias("wide_year"),
        years.strict_cascade("year", "indicator_name", "raw", as_of_year=1990).alias("strict_no_fallback"))


@query("N18_year_of_column", "page_id:L column_index:I column_year:I record_year:I", f"""
SELECT p_partkey AS page_id, i AS column_index, CASE WHEN i = 1 AND 2016 + p_size % 12 BETWEEN 2018 AND 2025 THEN 2016 + p_size % 12 ELSE
    CASE WHEN i = 0 AND 2016 + p_size % 12 BETWEEN 2018 AND 2025 THEN 2016 + p_size % 12 ELSE 2023 END END AS column_year,
  CASE WHEN i > 0 THEN CASE i WHEN 1 THEN CASE WHEN 2016 + p_size % 12 BETWEEN 2018 AND 2025 THEN 2016 + p_size % 12 END ELSE 2023 END END AS record_year
FROM part, (VALUES (0), (1), (2)) v(i)""")
def _(t):
    headers = F.transform(F.get(F.get("cells", F.lit(0)), F.lit(0)), html.cell_text)
    pages = extraction.with_cells(t.view("html"), "html").select("page_id", "url", headers.alias("headers"))
    cols = pages.select("page_id", "url", "headers", F.posexplode("headers").alias("column_index", "header"))
    return cols.select("page_id", "column_index", years.from_headers("headers", "column_index", "url").alias("column_year"),
                       years.from_record("header", F.lit("")).alias("record_year"))


def _parsed(expr: str, default: int) -> str:
    head = f"split_part({expr}, '/', 1)"
    return f"CAST(coalesce(floor(greatest(TRY_CAST(trim({head}) AS DOUBLE), 0)), {default}) AS BIGINT)"


_TOTAL = f"greatest({_parsed('progress_total', 1)}, 1)"
_CURRENT = f"least({_parsed('progress_current', 0)}, {_TOTAL})"


@query("N19_progress", "row_id:L current:L total:L percentage:D display:S", f"""
{_TASKS} SELECT row_id, {_CURRENT} AS current, {_TOTAL} AS total, round({_CURRENT} / {_TOTAL} * 100, 1) AS percentage,
  {_CURRENT} || '/' || {_TOTAL} AS display FROM tasks""")
def _(t):
    p = text.progress("progress_current", "progress_total")
    return t.view("tasks").select("row_id", p.alias("p")).select("row_id", "p.*")


@query("N20_duration", "event_id:L seconds:D task_seconds:D", """
SELECT event_id, round((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1e6, 3) AS seconds,
  CASE WHEN event_type = 'error' THEN 0 ELSE round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6, 3) END AS task_seconds FROM events""")
def _(t):
    e = t.events
    finished = F.when(F.col("event_type") != "error", F.col("ts"))
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return e.select("event_id", text.seconds_between(start, "ts").alias("seconds"), text.seconds_between(day, finished).alias("task_seconds"))


@query("N21_iso_timestamp", "event_id:L iso:S iso_hour:S", """
SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
  strftime(ts, '%Y-%m-%dT%H:00:00') AS iso_hour FROM events""")
def _(t):
    return t.events.select("event_id", text.iso_timestamp("ts").alias("iso"),
                           text.iso_timestamp(F.date_trunc("hour", "ts")).alias("iso_hour"))


@query("N22_tolerant_json", "event_id:L json_text:S", """
SELECT event_id, CASE WHEN json_valid(x) THEN CAST(json(x) AS VARCHAR) ELSE '{}' END AS json_text
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 2) ELSE props END AS x FROM events)""")
def _(t):
    damaged = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return t.events.select("event_id", text.tolerant_json(damaged).alias("json_text"))


@query("N23_bounded_parameters", "row_id:L quality_threshold:D timeout:I priority:I warnings:S", f"""
{_TASKS}, p AS (SELECT row_id, (priority - 2) / 5.0 AS q, CASE WHEN row_id % 9 = 0 THEN 60 ELSE n_urls * 40 END AS s, priority FROM tasks)
SELECT row_id, greatest(0.05, least(1, q)) AS quality_threshold, least(300, greatest(10, s)) AS timeout, least(10, greatest(1, priority)) AS priority,
  array_to_string(list_filter([CASE WHEN q NOT BETWEEN 0 AND 1 THEN 'quality_threshold ajusté entre 0 et 1' END,
    CASE WHEN s NOT BETWEEN 10 AND 300 THEN 'timeout ajusté entre 10 et 300 secondes' END,
    CASE WHEN priority NOT BETWEEN 1 AND 10 THEN 'priority ajustée entre 1 et 10' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM p""")
def _(t):
    timeout = F.when(F.col("row_id") % 9 != 0, F.col("n_urls") * 40)
    parts = text.bounded_parameters((F.col("priority") - 2) / 5, timeout, "priority")
    parts["warnings"] = F.array_join(parts["warnings"], "; ")
    return t.view("tasks").select("row_id", *[c.alias(n) for n, c in parts.items()])


@query("N24_record_size", "o1:L size:L", f"""
{_OBS} SELECT o1, length(CAST(to_json({{'page_id': page_id, 'o1': o1, 'source_domain': source_domain, 'indicator_name': indicator_name, 'unit': unit, 'year': year}}) AS VARCHAR)) AS size FROM obs""")
def _(t):
    return t.view("obs").select("o1", text.record_size("page_id", "o1", "source_domain", "indicator_name", "unit", "year").alias("size"))


@query("N25_page_text", "page_id:L visible:S cleaned:S", f"""
{with_views('sites')} SELECT page_id, {page_text('html')} AS visible,
  {page_text('html', lit(noise_pattern()))} AS cleaned FROM sites""")
def _(t):
    return t.view("sites").select("page_id", html.page_text("html").alias("visible"), html.clean_page_text("html").alias("cleaned"))


@query("N25_nested_noise", "page_id:L cleaned:S", """
SELECT p_partkey AS page_id, 'Page ' || p_partkey || 'Taux ' || p_brand || p_size || ',5 %Dette ' || p_brand || p_size || '9' AS cleaned FROM part""")
def _(t):
    """Noise blocks go with the blocks that they hold; an unclosed script ends with the page."""
    return t.view("messy_pages").select("page_id", html.clean_page_text("html").alias("cleaned"))


_QUALITY = (
    "least(1.0, 0.5 + CASE WHEN length({n}) > 8 AND regexp_matches({n}, '[A-Za-zÀ-ÿ]') THEN 0.2 ELSE 0 END "
    "+ CASE WHEN {u} <> '' THEN 0.1 ELSE 0 END + CASE WHEN abs({v}) BETWEEN 0.01 AND 1000000 THEN 0.2 ELSE 0 END)"
)
_PLAUSIBLE = (
    f"CASE WHEN {{v}} BETWEEN 1950 AND 2030 AND {has('lower({n})', R.YEAR_WORDS)} THEN false "
    f"WHEN {has('lower({n})', R.RATE_WORDS)} THEN {{v}} BETWEEN -100 AND 1000 "
    f"WHEN {has('lower({n})', ['population'])} THEN {{v}} BETWEEN 1000 AND 50000000 "
    f"WHEN {has('lower({n})', R.GDP_WORDS)} THEN {{v}} >= 0 AND {{v}} < 1e15 ELSE abs({{v}}) < 1e12 END"
)


@query("N26_enriched_record", "o1:L indicator_name:S category:S unit_description:S year:I temporal_context:S is_target_indicator:B semantic_quality:D raw_text:S clean_category:S", f"""
{_OBS}, r AS (SELECT *, indicator_name || ': ' || value_text AS raw FROM obs WHERE {_PLAUSIBLE.format(v='value', n='indicator_name')}),
y AS (SELECT *, coalesce(CASE WHEN TRY_CAST(regexp_extract(lower(raw || ' ' || indicator_name), '\\b(20[1-2][0-9])\\b', 1) AS INTEGER) BETWEEN 2018 AND 2025
   THEN CAST(regexp_extract(lower(raw || ' ' || indicator_name), '\\b(20[1-2][0-9])\\b', 1) AS INTEGER) END, 2024) AS y0 FROM r)
SELECT o1, trim(indicator_name) AS indicator_name, {case_labels('lower(indicator_name)', R.CATEGORY_GROUPS, 'OTHER')} AS category, {_DESCRIBED} AS unit_description,
  coalesce(year, y0) AS year, coalesce(year, y0) || '-record' AS temporal_context, {has('lower(indicator_name)', R.TARGET_TERMS)} AS is_target_indicator,
  {_QUALITY.format(n='indicator_name', u='unit', v='value')} AS semantic_quality, raw[1:200] AS raw_text,
  {case_labels('lower(indicator_name)', R.CATEGORY_GROUPS_CLEAN, 'ECONOMIC_GENERAL')} AS clean_category
FROM y""")
def _(t):
    obs = t.view("obs").withColumn("raw_text", F.concat("indicator_name", F.lit(": "), "value_text"))
    return records.enrich(obs).withColumn("clean_category", labels.category_clean("indicator_name"))
