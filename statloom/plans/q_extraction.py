"""Pages to observation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import advice, html
from statloom.functions import rules as R
from statloom.operators import extraction as X
from statloom.plans.oracle import clean_number, has, number, noise_pattern, page_text, rx, text as lit, with_views
from statloom.plans.registry import query

_FIELDS = with_views("field_pages")
_YEAR1 = "CASE WHEN 2016 + p_size % 12 BETWEEN 2018 AND 2025 THEN 2016 + p_size % 12 ELSE 2023 END"
_PRICE = "floor(p_retailprice)"


@query("X01_adjacent_pairs", "page_id:L obs_key:S indicator_name:S value:D unit:S year:I category:S", """
SELECT p_partkey AS page_id, 'table_0_1_0' AS obs_key, 'Taux ' || p_brand AS indicator_name, p_size + 0.5 AS value, '%' AS unit, 2024 AS year, 'OTHER' AS category FROM part""")
def _(t):
    return X.adjacent_pairs(t.view("html"))


_MESSY_DETTE = "SELECT p_partkey AS page_id, '{0}' AS obs_key, 'Dette ' || p_brand AS indicator_name, CAST(p_size AS DOUBLE) AS value FROM part"


@query("X01_nested_cells", "page_id:L obs_key:S indicator_name:S value:D", f"""
SELECT p_partkey AS page_id, 'table_0_0_0' AS obs_key, 'Taux ' || p_brand || p_size || ',5 %' AS indicator_name, p_size + 0.5 AS value FROM part
UNION ALL SELECT p_partkey, 'table_0_1_0', 'Dette ' || p_brand || p_size, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) FROM part
UNION ALL {_MESSY_DETTE.format('table_0_1_1')} UNION ALL {_MESSY_DETTE.format('table_0_2_0')} UNION ALL {_MESSY_DETTE.format('table_1_0_0')}""")
def _(t):
    """An unclosed cell holds the next one; rows of a nested table are rows of both tables; comments hold no table."""
    return X.adjacent_pairs(t.view("messy_pages"))


@query("X02_header_tables", "page_id:L obs_key:S indicator_name:S value:D unit:S year:I raw_text:S", f"""
SELECT p_partkey AS page_id, 'table_0_1_1' AS obs_key, 'Taux ' || p_brand AS indicator_name, p_size + 0.5 AS value, '%' AS unit, {_YEAR1} AS year,
  'Taux ' || p_brand || ': ' || p_size || ',5 %' AS raw_text FROM part
UNION ALL SELECT p_partkey, 'table_0_1_2', 'Taux ' || p_brand, {_PRICE}, '%', 2023, 'Taux ' || p_brand || ': ' || CAST({_PRICE} AS BIGINT) FROM part WHERE {_PRICE} NOT BETWEEN 1900 AND 2030""")
def _(t):
    return X.header_tables(t.view("html"))


@query("X03_first_two_cells", "page_id:L obs_key:S indicator_name:S value:D", """
SELECT p_partkey AS page_id, 'table_0_0' AS obs_key, 'Indicateur' AS indicator_name, 2016 + p_size % 12 AS value FROM part
UNION ALL SELECT p_partkey, 'table_0_1', 'Taux ' || p_brand, p_size + 0.5 FROM part UNION ALL SELECT p_partkey, 'table_0_2', 'Tableau', 1 FROM part""")
def _(t):
    return X.first_two_cells(t.view("html"))


@query("X03_guarded_parser", "page_id:L obs_key:S indicator_name:S value:D", """
SELECT p_partkey AS page_id, 'row_0_0' AS obs_key, 'Indicateur' AS indicator_name, 2016 + p_size % 12 AS value FROM part
UNION ALL SELECT p_partkey, 'row_0_2', 'Tableau', 1 FROM part""")
def _(t):
    return X.labelled_table_values(t.view("html"))


@query("X04_list_items", "page_id:L obs_key:S indicator_name:S value:D unit:S year:I", """
SELECT p_partkey AS page_id, 'list_0_0' AS obs_key, 'Inflation' AS indicator_name, CAST((p_size % 9) || '.' || (p_size % 10) AS DOUBLE) AS value, '%' AS unit, 2024 AS year FROM part
UNION ALL SELECT p_partkey, 'list_0_1', 'Population', p_size, 'Habitants', 2021 FROM part""")
def _(t):
    return X.list_items(t.view("html"))


@query("X05_data_blocks", "page_id:L obs_key:S indicator_name:S value:D unit:S", """
SELECT p_partkey AS page_id, 'struct_0_0_0' AS obs_key, 'Inflation' AS indicator_name, CAST((p_size % 9) || '.' || (p_size % 10) AS DOUBLE) AS value, '%' AS unit FROM part
UNION ALL SELECT p_partkey, 'struct_0_1_0', 'Inflation', CAST((p_size % 9) || '.' || (p_size % 10) AS DOUBLE), '' FROM part""")
def _(t):
    # The population item is below the plausible size of a population and drops out.
    return X.data_blocks(t.view("html"))


def _pattern_rows(source: str, body: str, patterns, ignore_case: bool = True) -> str:
    """CTE text: one row per match with position, raw match and groups."""
    arms = []
    for i, (p, groups) in enumerate(patterns):
        cols = ", ".join(
            f"coalesce(unnest(regexp_extract_all({body}, {rx(p, ignore_case)}, {g})), '') AS g{g}" if g <= groups else f"'' AS g{g}" for g in range(4)
        )
        arms.append(f"SELECT page_id, url, {i} AS p, unnest(range(len(regexp_extract_all({body}, {rx(p, ignore_case)})))) AS m, {cols} FROM {source}")
    return " UNION ALL ".join(arms)


def _case(expr: str, pairs, tail: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {rx(p, False)}) THEN {lit(u)}" for p, u in pairs) + f" ELSE {tail} END"


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_CLEAN_TEXT = page_text("html", lit(noise_pattern()))


@query("X06_text_patterns", "page_id:L obs_key:S indicator_name:S value:D unit:S year:I", f"""
{_FIELDS}, bodies AS (SELECT page_id, url, {_CLEAN_TEXT} AS b FROM field_pages),
m AS ({_pattern_rows('bodies', 'b', [(p, 3 if u else 2) for p, u in R.TEXT_PATTERNS])}),
v AS (SELECT *, {_STRIP.format('g1')} AS n, {clean_number('g2')} AS value, lower({_STRIP.format('g2')} || ' ' || {_STRIP.format('g1')}) AS joined FROM m)
SELECT page_id, 'text_' || p || '_' || m AS obs_key, n AS indicator_name, value,
  CASE WHEN g3 <> '' THEN g3 ELSE {_case('joined', R.UNIT_PATTERNS_CLEAN, f"CASE WHEN {has('lower(n)', ['taux', 'inflation', 'chomage'])} THEN '%' WHEN {has('lower(n)', ['pib', 'dette', 'budget'])} THEN 'MD' WHEN {has('lower(n)', ['population'])} THEN 'Habitants' ELSE '' END")} END AS unit,
  CAST(coalesce(nullif(regexp_extract(g0, '\\b(20(?:1[8-9]|2[0-5]))\\b', 1), ''), nullif(regexp_extract(url, '\\b(20(?:1[8-9]|2[0-5]))\\b', 1), ''), '2024') AS INTEGER) AS year
FROM v WHERE value IS NOT NULL""")
def _(t):
    return X.text_patterns(t.view("field_pages"))


@query("X07_government_patterns", "page_id:L obs_key:S indicator_name:S value:D unit:S year:I", f"""
{_FIELDS}, gov AS (SELECT page_id, url, html AS b FROM field_pages WHERE {has('lower(url)', R.DOMAIN_GOV)}),
m AS ({_pattern_rows('gov', 'b', [(p, 1) for p in R.GOV_PATTERNS])}), v AS (SELECT *, {clean_number('g1')} AS value FROM m)
SELECT page_id, 'gov_' || p || '_' || m AS obs_key, 'Indicateur gouvernemental tunisien ' || p AS indicator_name, value,
  CASE WHEN g0 LIKE '%\\%%' ESCAPE '\\' OR lower(g0) LIKE '%percent%' THEN '%' ELSE '' END AS unit, 2024 AS year FROM v WHERE value > 0""")
def _(t):
    return X.government_patterns(t.view("field_pages"))


def _plausible(v: str, n: str) -> str:
    return (f"CASE WHEN {has(f'lower({n})', R.YEAR_WORDS)} AND {v} BETWEEN 1950 AND 2030 THEN false WHEN {has(f'lower({n})', R.RATE_WORDS)} THEN {v} BETWEEN -100 AND 1000 "
            f"WHEN contains(lower({n}), 'population') THEN {v} BETWEEN 1000 AND 50000000 WHEN {has(f'lower({n})', R.GDP_WORDS)} THEN {v} >= 0 AND {v} < 1e15 ELSE abs({v}) < 1e12 END")


def _on_site(site: str, patterns) -> str:
    return f"""{_FIELDS}, site AS (SELECT page_id, url, {page_text('html')} AS b FROM field_pages WHERE contains(lower(url), {lit(site)})),
m AS ({_pattern_rows('site', 'b', [(p, 3 if u else 2) for p, u in patterns])}),
v AS (SELECT page_id, p, m, g0, g3, {_STRIP.format('g1')} AS n, {number(_STRIP.format('g2'))} AS value FROM m),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p, m) AS rn FROM v WHERE value IS NOT NULL),
k AS (SELECT * FROM c WHERE {_plausible('value', "(n || '')")})"""


@query("X08_bank_patterns", "page_id:L obs_key:S indicator_name:S value:D unit:S confidence_score:D", f"""
{_on_site('bct.gov.tn', R.BANK_PATTERNS)}
SELECT page_id, 'bct_' || p || '_' || m AS obs_key, 'BCT ' || n AS indicator_name, value,
  CASE WHEN g3 <> '' THEN upper(g3) WHEN {has('lower(n)', ['taux', 'rate'])} THEN '%' WHEN value > 1000 THEN 'MD' ELSE 'TND' END AS unit, 0.9 AS confidence_score FROM k""")
def _(t):
    return X.bank_patterns(t.view("field_pages"))


@query("X09_piped_lines", "page_id:L obs_key:S indicator_name:S value:D unit:S", """
SELECT 3000000000 + p_partkey AS page_id, 'ins_1_1' AS obs_key, 'INS Emploi' AS indicator_name, CAST(p_size AS DOUBLE) AS value, 'MD' AS unit FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 3000000000 + p_partkey, 'ins_1_2', 'INS Emploi', 7.5, 'MD' FROM part WHERE p_partkey % 3 = 1""")
def _(t):
    return X.piped_lines(t.view("field_pages"))


@query("X10_finance_patterns", "page_id:L obs_key:S indicator_name:S value:D unit:S", f"""
{_on_site('finances.gov.tn', R.FINANCE_PATTERNS)}
SELECT page_id, 'finance_' || p || '_' || m AS obs_key, 'Finance ' || n AS indicator_name, value,
  CASE WHEN g3 <> '' THEN g3 WHEN value > 1000 THEN 'MD' ELSE 'MDT' END AS unit FROM k""")
def _(t):
    return X.finance_patterns(t.view("field_pages"))


_GENERIC = [(p, g) if g >= 2 else ("zz(z)zz(z)zz", 2) for p, g in R.GENERIC_PATTERNS]


@query("X11_generic_patterns", "page_id:L obs_key:S indicator_name:S value:D unit:S raw_text:S", f"""
{with_views('sites')}, m AS ({_pattern_rows('sites', 'html', _GENERIC)}),
v AS (SELECT *, {_STRIP.format('g1')}[1:60] AS n, {number(_STRIP.format('g2'))} AS value FROM m)
SELECT page_id, 'pattern_' || p || '_' || m AS obs_key, {_STRIP.format('n').replace("'^\\s+|\\s+$'", "'^ +| +$'")} AS indicator_name, value, {_STRIP.format('g3')}[1:10] AS unit, g0[1:200] AS raw_text FROM v
WHERE value IS NOT NULL AND NOT value BETWEEN 1990 AND 2030 AND abs(value) <= 1e10 AND {_plausible('value', 'n')}""")
def _(t):
    return X.generic_patterns(t.view("sites"))


_SITE_ARMS = []
for _site, _key in (("ins.tn", "statistical_institute"), ("bct.gov.tn", "central_bank"), ("finances.gov.tn", "ministry_finance")):
    for _i, _p in enumerate(R.SITE_PATTERNS[_key]):
        _SITE_ARMS.append(
            f"SELECT page_id, {_i} AS p, unnest(range(len(regexp_extract_all(html, {rx(_p)})))) AS m, unnest(regexp_extract_all(html, {rx(_p)})) AS raw FROM field_pages WHERE contains(url, {lit(_site)})"
        )


@query("X12_site_patterns", "page_id:L obs_key:S indicator_name:S value:D", f"""
{_FIELDS}, m AS ({' UNION ALL '.join(_SITE_ARMS)}),
v AS (SELECT page_id, p, m, TRY_CAST(replace(regexp_extract(raw, '([0-9]+[,.]?[0-9]*)', 1), ',', '.') AS DOUBLE) AS value FROM m)
SELECT page_id, 'pattern_' || p || '_' || (row_number() OVER (PARTITION BY page_id ORDER BY p, m) - 1) AS obs_key, 'Pattern_' || p AS indicator_name, value FROM v WHERE value IS NOT NULL""")
def _(t):
    return X.site_patterns(t.view("field_pages"))


@query("X13_class_values", "page_id:L raw_text:S value:D indicator_name:S", f"""
SELECT p_partkey AS page_id, 'Taux ' || p_brand AS raw_text, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS value, 'Selector_0' AS indicator_name FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT p_partkey, p_size || ',5 %', p_size + 0.5, 'Selector_0' FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT p_partkey, CAST({_PRICE} AS BIGINT)::VARCHAR, {_PRICE}, 'Selector_0' FROM part WHERE p_partkey % 3 < 2 AND {_PRICE} >= 1000""")
def _(t):
    return X.class_values(t.view("html"))


_LINK_ROWS = """l AS (SELECT p_partkey AS k, 'https://s' || (p_partkey % 40) || '.example.org' AS root, p_size AS z FROM part),
links AS (SELECT k, root, root || '/n/' || (k + 40) AS link, '/n/' AS href FROM l UNION ALL SELECT k, root, root || '/n/' || (k + 80), '/n/' FROM l
  UNION ALL SELECT k, root, root || '/statistique/' || z, 'http' FROM l UNION ALL SELECT k, root, root || '/n/' || k || '#top', '#top' FROM l
  UNION ALL SELECT k, root, root || '/contact', '/contact' FROM l UNION ALL SELECT k, root, 'https://other.example.net/x', 'https' FROM l
  UNION ALL SELECT k, root, root || '/n/' || k || '.zip', '.zip' FROM l UNION ALL SELECT k, root, root || '/q?a=1&b=2&c=3&d=4&e=5', '&' FROM l
  UNION ALL SELECT k, root, root || '/n/page-' || (k % 7), 'rel' FROM l)"""


@query("X14_page_links", "page_id:L link:S", f"WITH {_LINK_ROWS} SELECT DISTINCT k AS page_id, link FROM links")
def _(t):
    return X.page_links(t.view("link_pages"))


@query("X14_page_links_raw", "page_id:L link:S", """
SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<a [^>]*?href="([^"]*)"', 1)) AS href FROM pages)""")
def _(t):
    return X.page_links(t.wide("pages"))


@query("F17_crawl_links", "page_id:L dst_url:S",
       f"WITH {_LINK_ROWS} SELECT DISTINCT k AS page_id, link AS dst_url FROM links WHERE href IN ('/n/', 'http', 'rel')")
def _(t):
    return X.crawl_links(t.view("link_pages"))


@query("X15_script_urls", "page_id:L data_url:S", """
SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'https://www.bct.gov.tn' WHEN 1 THEN 'https://www.ins.tn' ELSE 'https://news.example.org' END || '/data/' || p_partkey || '.json' AS data_url FROM part""")
def _(t):
    return X.script_urls(t.view("html"))


@query("X16_forms", "page_id:L form_idx:I action:S method:S inputs:S submit_url:S", """
SELECT p_partkey AS page_id, 0 AS form_idx, '/q' AS action, 'post' AS method, 'k=' || p_partkey AS inputs,
  CASE p_partkey % 3 WHEN 0 THEN 'https://www.bct.gov.tn' WHEN 1 THEN 'https://www.ins.tn' ELSE 'https://news.example.org' END || '/q' AS submit_url FROM part""")
def _(t):
    f = X.forms(t.view("html"))
    pairs = F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return f.withColumn("inputs", F.array_join(pairs, "&"))


@query("X16_unquoted_forms", "page_id:L form_idx:I action:S method:S inputs:S submit_url:S", """
SELECT p_partkey AS page_id, 0 AS form_idx, '/q?a=1' AS action, 'post' AS method, 'k=' || p_partkey || '&go=Submit' AS inputs, 'https://www.ins.tn/q?a=1' AS submit_url FROM part""")
def _(t):
    f = X.forms(t.view("messy_pages"))
    pairs = F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return f.withColumn("inputs", F.array_join(pairs, "&"))


_INV_NUM = rx(R.INVENTORY_NUMBER)
_INV_WORDS = rx(r"\b(?:" + "|".join(R.INVENTORY_WORDS) + r")\b")
_INVENTORY_SQL = f"""{with_views('field_pages')}, f AS (SELECT page_id, url, html, regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1) AS tabs FROM field_pages),
inv AS (SELECT page_id, url, coalesce(nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), 'No title') AS title, len(tabs) AS n_tables,
  list_sort(list_distinct(regexp_extract_all(html, {_INV_NUM}))) AS numbers, list_sort(list_distinct(regexp_extract_all(html, {_INV_WORDS}))) AS words,
  list_sort(list_distinct(regexp_extract_all(html, '\\b(20[0-2][0-9])\\b', 1))) AS years, list_transform(tabs, lambda x: len(regexp_extract_all(x, '(?is)<tr[^>]*>'))) AS table_rows FROM f)"""


@query("X17_inventory", "page_id:L title:S n_tables:I numbers:S words:S years:S table_rows:S n_data_links:I", f"""
{_INVENTORY_SQL} SELECT page_id, title, n_tables, array_to_string(numbers, '|') AS numbers, array_to_string(words, ',') AS words, array_to_string(years, ',') AS years,
  array_to_string(list_transform(table_rows, lambda x: x::VARCHAR), ',') AS table_rows, 0 AS n_data_links FROM inv""")
def _(t):
    i = X.inventory(t.view("field_pages"))
    return i.select("page_id", "title", "n_tables", F.array_join("numbers", "|").alias("numbers"), F.array_join("indicator_words", ",").alias("words"),
                    F.array_join("years", ",").alias("years"), F.array_join(F.transform("table_rows", lambda x: x.cast("string")), ",").alias("table_rows"),
                    F.size("data_links").alias("n_data_links"))


@query("X17_data_links", "page_id:L n_data_links:L", """
SELECT page_id, len(list_filter(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<a [^>]*?href="([^"]*)"', 1),
  lambda x: regexp_matches(lower(x), 'statistique|donnee|data|excel|csv|pdf'))) AS n_data_links FROM pages""")
def _(t):
    return X.inventory(t.wide("pages")).select("page_id", F.size("data_links").alias("n_data_links"))


@query("Q17_inventory_advice", "page_id:L advice:S", f"""
{_INVENTORY_SQL} SELECT page_id, array_to_string(list_filter([CASE WHEN n_tables = 0 THEN 'URL ' || url || ': Aucun tableau trouvé - probablement une page de navigation' END,
  CASE WHEN len(numbers) < 5 THEN 'URL ' || url || ': Peu de données numériques - vérifier si c''est la bonne page' END], lambda x: x IS NOT NULL), ' | ') AS advice FROM inv""")
def _(t):
    i = X.inventory(t.view("field_pages"))
    lines = advice.for_inventory("url", "n_tables", F.size("numbers"), F.size("data_links"))
    return i.select("page_id", F.array_join(lines, " | ").alias("advice"))


@query("X18_pattern_profile", "doc_id:L pattern:S n:L samples:S", f"""
{with_views('notes')}, m AS ({' UNION ALL '.join(f"SELECT doc_id, {lit(n)} AS pattern, regexp_extract_all(text, {rx(p)}, 1) AS ms FROM notes" for n, p in R.PROFILE_PATTERNS)})
SELECT doc_id, pattern, len(ms) AS n, array_to_string(ms[1:5], '|') AS samples FROM m WHERE len(ms) > 0""")
def _(t):
    return X.pattern_profile(t.view("notes")).withColumn("samples", F.array_join("samples", "|"))


_PAIR = rx(R.TEXT_PAIR_PATTERN, False)


@query("X19_text_pairs", "doc_id:L name:S value:D raw:S", f"""
{with_views('notes')}, m AS (SELECT doc_id, unnest(range(len(regexp_extract_all(text, {_PAIR})))) AS i, unnest(regexp_extract_all(text, {_PAIR}, 1)) AS g1, unnest(regexp_extract_all(text, {_PAIR}, 2)) AS raw FROM notes),
v AS (SELECT doc_id, i, raw, {_STRIP.format('g1')} AS name, CASE WHEN length(raw) > 50 THEN NULL WHEN contains(raw, '%') THEN TRY_CAST(replace(raw, '%', '') AS DOUBLE)
  WHEN contains(raw, ',') AND contains(raw, '.') THEN CASE WHEN instr(reverse(raw), ',') < instr(reverse(raw), '.') THEN TRY_CAST(replace(replace(raw, '.', ''), ',', '.') AS DOUBLE) ELSE TRY_CAST(replace(raw, ',', '') AS DOUBLE) END
  ELSE TRY_CAST(replace(raw, ',', '.') AS DOUBLE) END AS value FROM m WHERE i < 10),
k AS (SELECT * FROM v WHERE abs(value) <= 1e15 AND length(name) > 3 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY i DESC) = 1)
SELECT doc_id, name, value, raw FROM k
UNION ALL SELECT doc_id, 'content_summary', NULL, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END FROM notes WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def _(t):
    return X.text_pairs(t.view("notes"))


@query("X22_site_tables", "page_id:L obs_key:S indicator_name:S value:D", """
SELECT p_partkey AS page_id, 'row_0_0' AS obs_key, 'Indicateur' AS indicator_name, 2016 + p_size % 12 AS value FROM part
UNION ALL SELECT p_partkey, 'row_0_2', 'Tableau', 1 FROM part""")
def _(t):
    return X.site_tables(t.view("html"))
