"""Extraction: pages to observation rows.

Input is a table of pages (page_id, url, html). Per-page caps are applied to arrays before they are
exploded, so extraction is one narrow stage: no shuffle, no window, no Python.

Output rows carry page_id, url, method, obs_key, o1..o3, indicator_name, value, unit, year,
raw_text and confidence_score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import html, markup, numbers, predicates, units, urls, years
from statloom.functions import rules as R
from statloom.functions.common import all_matches, any_in, col, cut, each, first_of, let, regex, staged
from statloom.functions.text import strip
from statloom.operators import merging, records
from statloom.sources import payloads

_PAGE = ("page_id", "url")


def _observation(method: str, prefix: str, confidence: float, places: Sequence[Column], name, value, unit, raw, year=None) -> Column:
    """Uniform struct of one extracted value; the key is made of the prefix and the places."""
    parts = [p.cast("int") for p in places]
    padded = parts + [F.lit(None).cast("int")] * (3 - len(parts))
    return F.struct(
        F.lit(method).alias("method"),
        F.concat_ws("_", F.lit(prefix), *[p.cast("string") for p in parts]).alias("obs_key"),
        *[p.alias(f"o{i + 1}") for i, p in enumerate(padded)],
        name.alias("indicator_name"),
        value.alias("value"),
        unit.alias("unit"),
        (F.lit(None) if year is None else year).cast("int").alias("year"),
        raw.alias("raw_text"),
        F.lit(confidence).alias("confidence_score"),
    )


def explode_observations(pages: DataFrame, *arrays: Column) -> DataFrame:
    """Observation rows of one or more extraction arrays: a single pass over the pages."""
    found = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return each(pages, _PAGE, found, "m").select(*_PAGE, "m.*")


def _plausible(found: Column) -> Column:
    return F.filter(found, lambda m: numbers.plausible_for_name(m["value"], m["indicator_name"]))


def _flat(array: Column, body: Callable) -> Column:
    """Body per element, results put into one array."""
    return F.flatten(F.transform(array, body))


# -- tables ------------------------------------------------------------------------------------


def with_cells(pages: DataFrame, source, name: str = "cells", hidden_gone: bool = False) -> DataFrame:
    """Adds the inner markup of every cell, per table and row. Each level is made once a page and stays a column, so that
    the methods share it and no expression nests the levels."""
    return _celled(staged(pages, {"_tables": html.tables(source, hidden_gone=hidden_gone)}), name)


def _celled(tables: DataFrame, name: str = "cells") -> DataFrame:
    rows = staged(tables, {"_rows": F.transform("_tables", lambda t: html.rows(t))}).drop("_tables")
    return staged(rows, {name: F.transform("_rows", lambda table: F.transform(table, lambda r: html.cells(r)))}).drop("_rows")


def with_items(pages: DataFrame, source, name: str = "items") -> DataFrame:
    """Adds the inner markup of every list item, per list."""
    lists = staged(pages, {"_lists": html.lists(source)})
    return staged(lists, {name: F.transform("_lists", lambda x: html.items(x))}).drop("_lists")


def _cleaned(pages: DataFrame) -> DataFrame:
    return staged(pages.select(*_PAGE, "html"), {"cleaned": html.without_noise("html")})


def adjacent_pairs_array(limit: int | None = None, cells="cells") -> Column:
    """Every adjacent cell pair of the first tables whose label is an indicator."""

    def in_row(row: Column, ti: Column, ri: Column) -> Column:
        def pairs(texts: Column) -> Column:
            n = F.greatest(F.size(texts) - 1, F.lit(0))
            zipped = F.arrays_zip(F.slice(texts, 1, n).alias("label"), F.slice(texts, 2, n).alias("value_text"))
            placed = F.transform(zipped, lambda p, i: p.withField("cell_idx", i))
            named = F.filter(placed, lambda p: predicates.is_general_indicator(p["label"]))
            parsed = F.transform(named, lambda p: p.withField("value", numbers.parse_european(p["value_text"])))
            return F.transform(
                F.filter(parsed, lambda p: p["value"].isNotNull()),
                lambda p: _observation(
                    "html_table", "table", 0.8, [ti, ri, p["cell_idx"]], cut(p["label"], 50), p["value"],
                    units.from_text(p["value_text"], p["label"]), F.concat(p["label"], F.lit(": "), p["value_text"]),
                ),
            )

        return let(F.transform(row, html.inner_text), pairs)

    found = _flat(first_of(cells, limit), lambda rows, ti: _flat(rows, lambda row, ri: in_row(row, ti, ri)))
    return _plausible(found)


def adjacent_pairs(pages: DataFrame) -> DataFrame:
    return records.enrich(explode_observations(with_cells(pages, "html"), adjacent_pairs_array()))


def header_tables_array(limit: int | None = None, as_of_year: int = R.DEFAULT_YEAR, cells="cells") -> Column:
    """Label by value column with the year of the column header; noise removed. The header row is read
    once per table and used for all its rows."""
    url = F.col("url")

    def in_row(row: Column, headers: Column, ti: Column, ri: Column) -> Column:
        def values(texts: Column) -> Column:
            label = F.get(texts, F.lit(0))
            parsed = F.transform(
                texts, lambda c, i: F.struct(i.alias("cell_idx"), c.alias("value_text"), numbers.parse_clean(c).alias("value"))
            )
            numeric = F.filter(parsed, lambda v: (v["cell_idx"] > 0) & v["value"].isNotNull())
            listed = F.transform(
                numeric,
                lambda v: _observation(
                    "clean_table", "table", 0.8, [ti, ri, v["cell_idx"]], strip(label), v["value"],
                    units.from_text_or_name(v["value_text"], label),
                    cut(F.concat(label, F.lit(": "), v["value_text"]), 200),
                    years.from_headers(headers, v["cell_idx"], url, as_of_year),
                ),
            )
            return F.filter(listed, lambda m: predicates.is_clean_indicator(label) & years.in_period(m["year"]))

        return F.when(ri > 0, let(F.transform(row, html.cell_text), values)).otherwise(_none())

    def in_table(rows: Column, ti: Column) -> Column:
        headers = F.transform(F.get(rows, F.lit(0)), html.cell_text)
        return let(headers, lambda h: _flat(rows, lambda row, ri: in_row(row, h, ti, ri)))

    return _flat(first_of(cells, limit), in_table)


def _none() -> Column:
    return F.array().cast(f"array<{payloads.OBSERVATION}>")


def header_tables(pages: DataFrame, as_of_year: int = R.DEFAULT_YEAR) -> DataFrame:
    return explode_observations(with_cells(_cleaned(pages), "cleaned"), header_tables_array(as_of_year=as_of_year))


def first_two_cells(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Label and first number of the second cell of each row."""

    def in_row(row: Column, ti: Column, ri: Column) -> Column:
        def value(texts: Column) -> Column:
            label, raw = F.get(texts, F.lit(0)), F.get(texts, F.lit(1))
            return _observation(
                "table_extraction", "table", 0.7, [ti, ri], cut(label, 60), numbers.first_number(raw), F.lit(""),
                F.concat(label, F.lit(": "), raw),
            )

        def long_label(texts: Column) -> Column:
            return F.when(F.length(F.get(texts, F.lit(0))) > 3, value(texts))

        return let(F.transform(row, html.inner_text), long_label)

    found = _flat(first_of("cells", limit), lambda rows, ti: F.transform(rows, lambda row, ri: in_row(row, ti, ri)))
    return explode_observations(with_cells(pages, "html"), F.filter(found, lambda m: m["value"].isNotNull()))


def labelled_table_values(pages: DataFrame, chosen: Column | None = None) -> DataFrame:
    """Guarded parser over the first two cells of each row. ``chosen`` holds the tables to read."""

    def in_row(row: Column, ti: Column, ri: Column) -> Column:
        return let(
            html.inner_text(F.get(row, F.lit(1))),
            lambda r: _observation(
                "specialized", "row", 0.7, [ti, ri], html.cell_text(F.get(row, F.lit(0))), numbers.parse_table_value(r), F.lit(""), r
            ),
        )

    celled = _celled(staged(pages, {"_tables": chosen if chosen is not None else html.tables("html")}))
    found = _flat(F.col("cells"), lambda rows, ti: F.transform(rows, lambda row, ri: in_row(row, ti, ri)))
    return explode_observations(celled, F.filter(found, lambda m: (m["indicator_name"] != "") & m["value"].isNotNull()))


def site_tables(pages: DataFrame) -> DataFrame:
    """Site-specific choice of tables: the first selector with a match decides, every other site
    reads all tables."""

    page = F.col("shown")

    def says(name: str, pattern: str):
        return lambda m: F.coalesce(html.attribute(m["head"], name).rlike("(?i)" + pattern), F.lit(False))

    def nested(blocks: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda x: markup.bodies(x, ("table",))))

    def classed(marker: str) -> Column:
        return markup.bodies(page, ("table",), says("class", marker), markup.attribute_hint("class", marker))

    def inside(tag: str, marker: str) -> Column:
        return nested(markup.bodies(page, (tag,), says("class", marker), markup.attribute_hint("class", marker)))

    options = {
        "central_bank": [
            classed(r"\btable-stat\b"), classed("stat"), classed("data"), inside(markup.ANY, r"\bstatistiques\b"),
        ],
        "industry_portal": [
            nested(markup.bodies(page, ("div",), says("id", "^dbs$"), markup.attribute_hint("id", "dbs"))),
            classed(r"\bdata\b"), inside(markup.ANY, r"\bentreprises\b"), inside(markup.ANY, r"\bsecteurs\b"),
        ],
    }
    sections = F.concat(
        inside("div", "indicateur"), inside("div", "stat"), inside("section", "data"),
        inside(markup.ANY, r"\bstatistiques\b"), inside(markup.ANY, r"\bindicateurs\b"), inside("div", "contenu"),
    )
    # One candidate list per option; only the list of the page's own site type is evaluated.
    ranked = (
        F.when(F.col("site") == "central_bank", F.array(*options["central_bank"]))
        .when(F.col("site") == "industry_portal", F.array(*options["industry_portal"]))
        .when(F.col("site") == "statistical_institute", F.array(sections))
    )
    sites = pages.select("page_id", "url", "html", urls.site_type("url").alias("site"))
    listed = staged(
        staged(sites, {"shown": html.without_hidden("html")}),
        {"everything": html.tables("html"), "special": F.get(F.filter(ranked, lambda o: F.size(o) > 0), F.lit(0))},
    )
    whole = F.coalesce("special", "everything")
    chosen = F.when(F.col("site").isin("central_bank", "industry_portal"), F.slice(whole, 1, 1)).otherwise(whole)
    return labelled_table_values(listed, chosen)


# -- lists and blocks --------------------------------------------------------------------------


def list_items_array(limit: int | None = None, as_of_year: int = R.DEFAULT_YEAR, items="items") -> Column:
    """``name: value``, ``name - value`` and ``name = value`` items of the first lists. The first form
    with a valid name and a number wins."""
    url = F.col("url")

    def in_item(raw: Column, li: Column, ii: Column) -> Column:
        forms_found = F.array(
            *[
                F.struct(
                    strip(F.regexp_extract(raw, regex(p), 1)).alias("name"),
                    strip(F.regexp_extract(raw, regex(p), 2)).alias("value_text"),
                )
                for p in R.LIST_PATTERNS
            ]
        )
        parsed = F.transform(forms_found, lambda f: f.withField("value", numbers.parse_clean(f["value_text"])))
        accepted = F.filter(parsed, lambda f: f["value"].isNotNull() & predicates.is_clean_indicator(f["name"]))
        return F.transform(
            F.slice(accepted, 1, 1),
            lambda f: _observation(
                "clean_list", "list", 0.8, [li, ii], f["name"], f["value"], units.from_text_or_name(f["value_text"], f["name"]),
                cut(raw, 200), years.from_snippet(raw, url, as_of_year),
            ),
        )

    return _flat(first_of(items, limit), lambda x, li: _flat(F.transform(x, html.cell_text), lambda raw, ii: in_item(raw, li, ii)))


def list_items(pages: DataFrame, as_of_year: int = R.DEFAULT_YEAR) -> DataFrame:
    return explode_observations(with_items(_cleaned(pages), "cleaned"), list_items_array(as_of_year=as_of_year))


# A separator followed by a number: without it the pattern cannot match.
_GUARDS = {
    R.BLOCK_PATTERNS[0][0]: r"[:=]\s*[0-9,.]",
    R.BLOCK_PATTERNS[1][0]: r":\s*[0-9,.]",
    R.BLOCK_PATTERNS[2][0]: r"-\s*[0-9,.]",
    R.GENERIC_PATTERNS[2][0]: r"[:=\-]\s*[0-9]",
}

#: Words in lower case of which each match holds at least one. Looking for them costs far less than running the pattern.
_TEXT_WORDS = (("pib", "gdp", "produit intérieur brut"), ("chômage", "unemployment rate"), ("inflation",), ("population",), ("export", "import"))
_BANK_WORDS = (("taux directeur", "refinancement", "intérêt"), ("réserve", "masse monétaire", "liquidité"), ("change", "euro", "dollar"))
_FINANCE_WORDS = (("budget", "recettes", "dépenses", "déficit"), ("dette", "pib"), ("investissement", "transfert"))
_GOV_WORDS = (
    ("taux", "rate", "pour cent"), ("usd", "eur", "dollar"), ("million", "milliard", "md"), ("pib", "gdp"), ("population", "habitant"),
    ("inflation", "déflation"), ("chômage", "unemployment"), ("export", "import"), ("budget", "recettes", "dépenses"),
    ("déficit", "excédent"), ("",), ("%",), (">",), ('"',),
)
_GENERIC_WORDS = (('"value":',), ('"date":',), ("",), ('":',), ("<t",))
_WORDS = {
    p: words
    for patterns, listed in (
        ([p for p, _ in R.TEXT_PATTERNS], _TEXT_WORDS), ([p for p, _ in R.BANK_PATTERNS], _BANK_WORDS),
        ([p for p, _ in R.FINANCE_PATTERNS], _FINANCE_WORDS), ([p.lower() for p in R.GOV_PATTERNS], _GOV_WORDS),
        ([p for p, _ in R.GENERIC_PATTERNS], _GENERIC_WORDS),
    )
    for p, words in zip(patterns, listed, strict=True)
}
#: Letters that a pattern takes for ``i``, ``s`` and ``k`` when case is ignored, though their lower case is another one.
_ODD_LETTERS = ("ı", "İ", "ſ", "\u212a")


def _matches(
    text, patterns: Sequence[tuple[str, int]], parse: Callable[[Column], Column], cap: int | None = None, ignore_case: bool = True
) -> Column:
    """All matches of all patterns in order, as structs of position, raw match, name, value text,
    unit hint and parsed value. The text is scanned once per pattern; groups are read from the short
    matches. Patterns are given with their number of groups; with one group there is no name.

    A name of bounded length is tried at every position of a text, so patterns that start with one are
    only run on texts that pass a cheap necessary test (see ``_GUARDS``), others only on texts with a word of theirs (see
    ``_WORDS``)."""

    def of(i: int, pattern: str, groups: int, read: Column) -> Column:
        p = regex(pattern, ignore_case)
        found = all_matches(text, pattern, ignore_case=ignore_case)
        if pattern in _GUARDS:
            found = F.when(col(text).rlike(_GUARDS[pattern]), found).otherwise(F.array().cast("array<string>"))
        if any(_WORDS.get(pattern, ())):
            spoken = any_in(read["low"], _WORDS[pattern]) | read["odd"]
            found = F.when(spoken, found).otherwise(F.array().cast("array<string>"))
        return F.transform(
            first_of(found, cap),
            lambda m, j: F.struct(
                F.lit(i).alias("pattern_idx"),
                j.alias("match_idx"),
                m.alias("raw"),
                (strip(F.regexp_extract(m, p, 1)) if groups > 1 else F.lit("")).alias("name"),
                strip(F.regexp_extract(m, p, min(groups, 2))).alias("value_text"),
                (strip(F.regexp_extract(m, p, 3)) if groups > 2 else F.lit("")).alias("hint"),
            ),
        )

    low, odd = (F.lower(col(text)), any_in(text, _ODD_LETTERS)) if ignore_case else (col(text), F.lit(False))
    listed = let(F.struct(low.alias("low"), odd.alias("odd")), lambda read: F.concat(*[of(i, p, g, read) for i, (p, g) in patterns]))
    return F.transform(listed, lambda m: m.withField("value", parse(m["value_text"])))


def _numbered(patterns) -> list:
    """Patterns with a flag for a unit group, numbered."""
    return [(i, (p, 3 if has_unit else 2)) for i, (p, has_unit) in enumerate(patterns)]


def with_blocks(pages: DataFrame, shown=None) -> DataFrame:
    """Adds the inner markup of blocks whose class speaks of data. ``shown``: the page without its hidden parts."""

    def speaks(m: Column) -> Column:
        return F.coalesce(html.attribute(m["head"], "class").rlike("(?i)data|stat|info|metric"), F.lit(False))

    hint = markup.attribute_hint("class", "data|stat|info|metric")
    return staged(pages, {"blocks": markup.bodies(html.without_hidden("html") if shown is None else shown, ("ul", "ol", "dl", "div"), speaks, hint, search=True)})


def data_blocks_array(blocks_per_page: int | None = None, values_per_block: int | None = None) -> Column:
    """Values of blocks whose class speaks of data."""
    blocks = first_of("blocks", blocks_per_page)

    def in_block(body: Column, bi: Column) -> Column:
        accepted = F.filter(
            _matches(body, _numbered(R.BLOCK_PATTERNS), numbers.parse_european),
            lambda m: m["value"].isNotNull() & predicates.is_general_indicator(m["name"]),
        )
        return F.transform(
            first_of(accepted, values_per_block),
            lambda m: _observation(
                "html_structured", "struct", 0.75, [bi, m["pattern_idx"], m["match_idx"]], cut(m["name"], 60), m["value"],
                F.when(m["hint"] != "", m["hint"]).otherwise(units.default_context(m["name"], m["value"])), m["raw"],
            ),
        )

    return _plausible(_flat(F.transform(blocks, html.cell_text), in_block))


def data_blocks(pages: DataFrame) -> DataFrame:
    return records.enrich(explode_observations(with_blocks(pages), data_blocks_array()))


# -- text patterns -----------------------------------------------------------------------------


def text_patterns_array(as_of_year: int = R.DEFAULT_YEAR, text: Column | None = None) -> Column:
    """Economic patterns over the text of a page without noise."""
    url = F.col("url")

    def in_text(body: Column) -> Column:
        numeric = F.filter(
            _matches(body, _numbered(R.TEXT_PATTERNS), numbers.parse_clean), lambda m: m["value"].isNotNull()
        )
        return F.transform(
            F.when(F.length(body) >= 10, numeric),
            lambda m: _observation(
                "clean_text", "text", 0.8, [m["pattern_idx"], m["match_idx"]], m["name"], m["value"],
                F.when(m["hint"] != "", m["hint"]).otherwise(units.from_text_or_name(m["value_text"], m["name"])),
                cut(m["raw"], 200), years.from_snippet(m["raw"], url, as_of_year),
            ),
        )

    found = let(text if text is not None else html.text_of(F.col("cleaned")), in_text)
    return F.coalesce(found, _none())


def text_patterns(pages: DataFrame, text: Column | None = None, as_of_year: int = R.DEFAULT_YEAR) -> DataFrame:
    return explode_observations(pages if text is not None else _cleaned(pages), text_patterns_array(as_of_year, text))


def government_patterns_array() -> Column:
    """Aggressive patterns over the raw content of government pages; positive values only. Only numbers
    leave this method, so the content is lower-cased once and matched with case, which is cheaper than
    folding case in fourteen patterns."""
    patterns = [(i, (p.lower(), 1)) for i, p in enumerate(R.GOV_PATTERNS)]
    lowered = let(F.lower("html"), lambda low: _matches(low, patterns, numbers.parse_clean, ignore_case=False))
    positive = F.filter(lowered, lambda m: m["value"] > 0)

    def percent(m: Column) -> Column:
        return F.contains(m["raw"], F.lit("percent")) | F.contains(m["raw"], F.lit("%"))

    found = F.transform(
        positive,
        lambda m: _observation(
            "government_specialized", "gov", 0.7, [m["pattern_idx"], m["match_idx"]],
            F.concat(F.lit("Indicateur gouvernemental tunisien "), m["pattern_idx"].cast("string")), m["value"],
            F.when(percent(m), "%").otherwise(""), m["value_text"], F.lit(R.DEFAULT_YEAR),
        ),
    )
    return F.when(urls.is_gov_site("url"), found).otherwise(_none())


def government_patterns(pages: DataFrame) -> DataFrame:
    return explode_observations(pages.filter(urls.is_gov_site("url")), government_patterns_array())


def _site_array(site: str, patterns, cap: int | None, to_observation: Callable[[Column], Column], visible: Column | None) -> Column:
    """Matches with a number over the visible text of the pages of one site."""

    def in_text(body: Column) -> Column:
        numeric = F.filter(_matches(body, _numbered(patterns), numbers.parse_european), lambda m: m["value"].isNotNull())
        return _plausible(F.transform(first_of(numeric, cap), to_observation))

    body = visible if visible is not None else html.page_text("html")
    return F.when(F.contains(F.lower("url"), F.lit(site)), let(body, in_text)).otherwise(_none())


def bank_patterns_array(visible: Column | None = None, cap: int | None = None) -> Column:
    def to_observation(m: Column) -> Column:
        return _observation(
            "bct_specialized", "bct", 0.9, [m["pattern_idx"], m["match_idx"]], F.concat(F.lit("BCT "), m["name"]), m["value"],
            units.default_bank(m["name"], m["hint"], m["value"]), m["raw"],
        )

    return _site_array("bct.gov.tn", R.BANK_PATTERNS, cap, to_observation, visible)


def bank_patterns(pages: DataFrame) -> DataFrame:
    return records.enrich(explode_observations(pages, bank_patterns_array()))


def finance_patterns_array(visible: Column | None = None, cap: int | None = None) -> Column:
    def to_observation(m: Column) -> Column:
        unit = F.when(m["hint"] != "", m["hint"]).when(m["value"] > 1000, "MD").otherwise("MDT")
        return _observation(
            "finance_specialized", "finance", 0.88, [m["pattern_idx"], m["match_idx"]], F.concat(F.lit("Finance "), m["name"]),
            m["value"], unit, m["raw"],
        )

    return _site_array("finances.gov.tn", R.FINANCE_PATTERNS, cap, to_observation, visible)


def finance_patterns(pages: DataFrame) -> DataFrame:
    return records.enrich(explode_observations(pages, finance_patterns_array()))


def piped_lines_array(visible: Column | None = None) -> Column:
    """Statistics-office lines of the form ``name | value | value``."""

    def in_line(line: Column, li: Column) -> Column:
        def values(parts: Column) -> Column:
            name = F.get(parts, F.lit(0))
            parsed = F.transform(parts, lambda p, i: F.struct(i.alias("val_idx"), numbers.parse_european(p).alias("value")))
            numeric = F.filter(parsed, lambda v: (v["val_idx"] > 0) & v["value"].isNotNull() & predicates.is_office_indicator(name))
            return F.transform(
                numeric,
                lambda v: _observation(
                    "ins_specialized", "ins", 0.85, [li, v["val_idx"]], F.concat(F.lit("INS "), name), v["value"],
                    units.default_office(name, v["value"]), line,
                ),
            )

        piped = F.contains(line, F.lit("|")) & (F.length(line) > 15)
        return F.when(piped, let(F.transform(F.split(line, r"\|"), strip), values)).otherwise(_none())

    body = visible if visible is not None else html.page_text("html")
    found = _plausible(_flat(F.split(body, "\n"), in_line))
    return F.when(F.contains(F.lower("url"), F.lit("ins.tn")), found).otherwise(_none())


def piped_lines(pages: DataFrame) -> DataFrame:
    return records.enrich(explode_observations(pages, piped_lines_array()))


def generic_patterns_array(cap: int | None = None) -> Column:
    """Generic patterns over the raw content, first 15 matches of each. Patterns with one group have
    no name and yield nothing."""
    patterns = [(i, (p, g)) for i, (p, g) in enumerate(R.GENERIC_PATTERNS) if g >= 2]
    quick = F.filter(
        _matches("html", patterns, numbers.parse_european, cap), lambda m: numbers.is_quick_value(m["value"])
    )
    return _plausible(
        F.transform(
            quick,
            lambda m: _observation(
                "pattern_modern", "pattern", 0.7, [m["pattern_idx"], m["match_idx"]], cut(m["name"], 60), m["value"],
                cut(m["hint"], 10), m["raw"],
            ),
        )
    )


def generic_patterns(pages: DataFrame) -> DataFrame:
    return records.enrich(explode_observations(pages, generic_patterns_array()))


def json_array() -> Column:
    """Values of an API payload: the items of a pair from the item API, else the numbers of an object."""
    paired = F.contains(F.lower("url"), F.lit("worldbank.org")) & F.startswith(F.ltrim("html"), F.lit("["))
    return _plausible(F.when(paired, payloads.api_items_array("html")).otherwise(payloads.flat_numbers_array("html")))


def all_methods(pages: DataFrame, as_of_year: int = R.DEFAULT_YEAR) -> DataFrame:
    """Every method in one pass: the page is read once, its visible text and its noise-free form are
    made once, from the page whose hidden parts are dropped once, and all values leave in one array. The content type chooses the base methods of each row: API
    payloads give the values of their JSON, other pages those of their HTML. The clean methods and the generic patterns
    read both; the clean ones come under prefixed keys, so keys are unique per page without an anti-join."""
    shown = staged(pages.select(*_PAGE, "html"), {"shown": html.without_hidden("html")})
    prepared = staged(shown, {"visible": html.text_of("shown"), "cleaned": html.without_noise("shown", hidden_gone=True)})
    prepared = with_cells(with_blocks(prepared, "shown"), "shown", hidden_gone=True)
    prepared = with_items(with_cells(prepared, "cleaned", "clean_cells"), "cleaned")
    visible, cleaned = F.col("visible"), F.col("cleaned")
    in_html = [
        adjacent_pairs_array(), data_blocks_array(), bank_patterns_array(visible), piped_lines_array(visible), finance_patterns_array(visible),
    ]
    is_api = urls.source_analysis("url")["content_type"] == "api_data"
    base = F.when(is_api, json_array()).otherwise(F.concat(*in_html))
    clean = [
        header_tables_array(as_of_year=as_of_year, cells="clean_cells"), list_items_array(as_of_year=as_of_year),
        text_patterns_array(as_of_year, html.text_of(cleaned)), government_patterns_array(),
    ]
    prefixed = F.transform(
        F.concat(*clean), lambda m: m.withField("obs_key", F.concat(F.lit("clean_"), m["obs_key"]))
    )
    found = explode_observations(prepared, base, generic_patterns_array(), prefixed)
    year = F.coalesce("year", years.from_record("raw_text", "indicator_name"), F.lit(as_of_year))
    return staged(found, {"year": year.cast("int")})


def _by_site(rules: dict, of: Callable) -> Column:
    """Rule set of the page's own site type; only that one is evaluated."""
    (first, own), *rest = rules.items()
    out = F.when(F.col("site") == first, of(own))
    for name, more in rest:
        out = out.when(F.col("site") == name, of(more))
    return out


def _first_numbers(pages: DataFrame, rules: dict, of: Callable, prefix: str, method: str, prepared: dict | None = None) -> DataFrame:
    """First number of each text of the site's rule set. ``prepared`` holds columns that the rules share."""
    sites = pages.select("page_id", "url", "html", urls.site_type("url").alias("site")).filter(F.col("site").isin(list(rules)))
    sites = staged(sites, prepared) if prepared else sites
    valued = F.transform(_by_site(rules, of), lambda m: m.withField("value", numbers.first_number(m["raw"])))
    numeric = F.filter(valued, lambda m: m["value"].isNotNull())
    listed = F.transform(
        numeric,
        lambda m, place: _observation(
            method, prefix.lower(), 0.7, [m["rule_idx"], place],
            F.concat(F.lit(f"{prefix}_"), m["rule_idx"].cast("string")), m["value"], F.lit(""), m["raw"],
        ),
    )
    return explode_observations(sites, listed)


def site_patterns(pages: DataFrame, rules=R.SITE_PATTERNS) -> DataFrame:
    """First number of each match of the patterns of the page's site type. Site types without
    patterns yield nothing."""

    def of(patterns: Sequence[str]) -> Column:
        def texts(i: int, pattern: str) -> Column:
            return F.transform(all_matches("html", pattern), lambda m: F.struct(F.lit(i).alias("rule_idx"), m.alias("raw")))

        return F.concat(*[texts(i, p) for i, p in enumerate(patterns)])

    return _first_numbers(pages, rules, of, "Pattern", "pattern_regex")


def class_values(pages: DataFrame, rules=R.SITE_SELECTORS, cap: int | None = None) -> DataFrame:
    """First number of elements picked by tag and class tokens."""

    def elements(tag: str, token: str, inner: str) -> Column:
        def classed(m: Column) -> Column:
            return F.coalesce(html.attribute(m["head"], "class").rlike(rf"(?is)(?:^|\s){token}(?:\s|$)"), F.lit(False))

        hint = markup.attribute_hint("class", token) if token else None
        outer = markup.bodies("shown", (tag or markup.ANY,), classed if token else None, hint)
        return F.flatten(F.transform(outer, lambda x: markup.bodies(x, (inner,)))) if inner else outer

    def of(selectors) -> Column:
        def texts(i: int, selector) -> Column:
            return F.transform(
                first_of(elements(*selector), cap),
                lambda x: F.struct(F.lit(i).alias("rule_idx"), html.inner_text(x).alias("raw")),
            )

        listed = F.concat(*[texts(i, s) for i, s in enumerate(selectors)])
        return F.filter(listed, lambda m: F.length(m["raw"]) > 3)

    return _first_numbers(pages, rules, of, "Selector", "css_selector", {"shown": html.without_hidden("html")})


# -- links, scripts, forms, inventory ----------------------------------------------------------


def page_link_array(html_col, url_col) -> Column:
    """Distinct absolute link targets of a page, sorted."""
    url = F.col(url_col)
    return F.array_sort(F.array_distinct(F.transform(html.links(html_col), lambda h: urls.resolve(h, url))))


def page_links(pages: DataFrame) -> DataFrame:
    return each(pages, ("page_id", "url"), page_link_array("html", "url"), "link")


def crawl_links(pages: DataFrame, excluded=R.LINK_EXCLUDED) -> DataFrame:
    """Links worth following: page_id, url, dst_url."""
    resolved = F.transform(
        F.array_distinct(html.links("html")),
        lambda h: F.struct(h.alias("href"), urls.resolve(h, F.col("url")).alias("dst_url")),
    )
    hosted = pages.select("page_id", "url", urls.authority("url").alias("host"), resolved.alias("links"))
    kept = F.filter("links", lambda x: urls.is_crawlable(x["href"], x["dst_url"], "host", excluded))
    return each(hosted, ("page_id", "url"), F.array_distinct(F.transform(kept, lambda x: x["dst_url"])), "dst_url")


def script_urls(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Data URLs named in scripts and attributes, resolved, distinct."""
    found = F.concat(*[all_matches("html", p, 1) for p in R.SCRIPT_URL_PATTERNS])
    root = F.regexp_extract("url", r"^([^/]*//[^/]*)", 1)
    resolved = F.transform(
        found,
        lambda m: F.when(F.startswith(m, F.lit("http")), m)
        .when(F.startswith(m, F.lit("/")), F.concat(root, m))
        .otherwise(F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), m)),
    )
    return each(pages, ("page_id",), first_of(F.array_distinct(resolved), cap), "data_url")


def forms(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Forms with named inputs: action, method, input map and submit URL."""
    found = first_of(markup.elements(html.without_hidden("html"), ("form",)), limit)
    listed = each(pages, ("page_id", "url"), found, "form", "form_idx")
    head = F.col("form.head")
    tags = F.regexp_extract_all("form.body", F.lit(r"(?is)<(?:input|select|textarea)\b[^<>]*>"), F.lit(0))
    pairs = F.transform(
        tags,
        lambda x: F.struct(
            html.attribute(x, "name").alias("key"),
            F.when(
                F.coalesce(html.attribute(x, "type"), F.lit("text")).isin("text", "hidden", "number"),
                F.coalesce(html.attribute(x, "value"), F.lit("")),
            )
            .when(html.attribute(x, "type") == "submit", F.coalesce(html.attribute(x, "value"), F.lit("Submit")))
            .alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["key"] != "") & p["value"].isNotNull())
    last = let(
        kept,
        lambda k: F.filter(
            k, lambda p, i: ~F.exists(F.slice(k, i + 2, F.greatest(F.size(k), F.lit(1))), lambda q: q["key"] == p["key"])
        ),
    )
    action = F.coalesce(html.attribute(head, "action"), F.lit(""))
    root = F.regexp_extract("url", r"^([^/]*//[^/]*)", 1)
    submit = (
        F.when(F.startswith(action, F.lit("http")), action)
        .when(F.startswith(action, F.lit("/")), F.concat(root, action))
        .otherwise(F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), action))
    )
    return listed.select(
        "page_id", "form_idx", action.alias("action"),
        F.lower(F.coalesce(html.attribute(head, "method"), F.lit("get"))).alias("method"),
        F.map_from_entries(last).alias("inputs"), submit.alias("submit_url"),
    ).filter(F.size("inputs") > 0)


def inventory(pages: DataFrame, anchors: int | None = None, listed: int | None = None, counted: int | None = None) -> DataFrame:
    """Title, tables, distinct numbers with unit, indicator words, years, row counts, data links."""
    h = F.col("html")
    found_tables = html.tables("html")
    anchor_hrefs = first_of(html.links("html"), anchors)
    words = r"\b(?:" + "|".join(R.INVENTORY_WORDS) + r")\b"
    return pages.select(
        "page_id", "url", html.title("html").alias("title"), F.size(found_tables).alias("n_tables"),
        first_of(F.array_sort(F.array_distinct(all_matches(h, R.INVENTORY_NUMBER))), listed).alias("numbers"),
        F.array_sort(F.array_distinct(all_matches(h, words))).alias("indicator_words"),
        F.array_sort(F.array_distinct(all_matches(h, r"\b(20[0-2]\d)\b", 1))).alias("years"),
        F.transform(first_of(found_tables, counted), lambda x: F.size(html.rows(x))).alias("table_rows"),
        F.filter(
            anchor_hrefs,
            lambda x: F.exists(F.array(*[F.lit(w) for w in R.DATA_LINK_WORDS]), lambda w: F.contains(F.lower(x), w)),
        ).alias("data_links"),
    )


# -- profiles ----------------------------------------------------------------------------------


def second_methods(pages: DataFrame) -> DataFrame:
    """The other route: first two cells of tables, patterns and elements of known sites, numbers of JSON at any depth."""
    objects = pages.filter(F.startswith(F.ltrim("html"), F.lit("{")) | F.startswith(F.ltrim("html"), F.lit("[")))
    numbers_in = payloads.nested_numbers(objects.select(*_PAGE, "html"), "html").withColumns(
        {"method": F.lit("json_nested"), "unit": F.lit(""), "raw_text": F.concat_ws(": ", "obs_key", F.col("value").cast("string")), "confidence_score": F.lit(0.7)}
    )
    found = [first_two_cells(pages), site_patterns(pages), class_values(pages), numbers_in]
    return merging.union_all(found)


def pattern_profile(texts: DataFrame, patterns=R.PROFILE_PATTERNS, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Match count and first five matches per named pattern with at least one match."""
    found = F.array(
        *[
            F.struct(F.lit(name).alias("pattern"), all_matches("text", p, 1).alias("matches"))
            for name, p in patterns
        ]
    )
    hits = each(texts, keys, F.filter(found, lambda p: F.size(p["matches"]) > 0), "p")
    return hits.select(
        *keys, "p.pattern", F.size("p.matches").alias("n"), F.slice("p.matches", 1, 5).alias("samples")
    )


def text_pairs(texts: DataFrame, cap: int = 10) -> DataFrame:
    """``name value`` pairs among the first ten matches; a text without pairs yields its summary."""
    p = regex(R.TEXT_PAIR_PATTERN, ignore_case=False)
    # A match can only start where a run of letters and spaces starts. Saying so spares a retry at
    # every position of a long run without numbers.
    at_run_start = r"(?<![A-Za-zÀ-ÿ\s])" + R.TEXT_PAIR_PATTERN
    pairs = F.transform(
        F.slice(all_matches("text", at_run_start, ignore_case=False), 1, cap),
        lambda m: F.struct(
            strip(F.regexp_extract(m, p, 1)).alias("name"),
            numbers.parse_table_value(F.regexp_extract(m, p, 2)).alias("value"),
            F.regexp_extract(m, p, 2).alias("raw"),
        ),
    )
    valid = F.filter(pairs, lambda x: (F.length(x["name"]) > 3) & x["value"].isNotNull())
    last = let(
        valid,
        lambda v: F.filter(v, lambda x, i: ~F.exists(F.slice(v, i + 2, F.lit(cap)), lambda y: y["name"] == x["name"])),
    )
    summary = F.when(F.length("text") > 500, F.concat(cut("text", 500), F.lit("..."))).otherwise(F.col("text"))
    fallback = F.array(
        F.struct(F.lit("content_summary").alias("name"), F.lit(None).cast("double").alias("value"), summary.alias("raw"))
    )
    scanned = texts.select("doc_id", last.alias("pairs"), fallback.alias("fallback"))
    listed = F.when(F.size("pairs") > 0, F.col("pairs")).otherwise(F.col("fallback"))
    return scanned.select("doc_id", F.inline(listed))
