"""HTML of pages: visible text, noise, tables, lists, links. Elements come from :mod:`statloom.functions.markup`, so
nested, unclosed and unquoted markup counts; entities are limited to the basic ones. Everything stays in Spark's own
functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import markup
from statloom.functions import rules as R
from statloom.functions.common import col, first_of, let
from statloom.functions.text import clean_cell, strip

LINK = r"""(?is)<a\b[^<>]*?\bhref\s*=\s*["']([^"']*)["']"""
#: One tag, with ``>`` inside quoted values.
_TAG = r"""<(?:[^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+>|[^>]*>)"""
_BLOCK_TAGS = ("div", "ul", "ol", "dl", "table", "section", "p", "span", "li", "td")

# Basic entities.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _where(sign: str, c, change: Callable[[Column], Column]) -> Column:
    """The changed text where it holds a sign without which nothing changes; looking for the sign costs little."""

    def changed(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(sign)), change(text)).otherwise(text)

    return changed(F.col(c)) if isinstance(c, str) else let(c, changed)


def decode(c) -> Column:
    def decoded(out: Column) -> Column:
        for entity, char in ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        return out

    return _where("&", c, decoded)


def without_hidden(html) -> Column:
    return _where("<", html, lambda page: F.regexp_replace(page, markup.HIDDEN, ""))


def _without_tags(c, separator: str = "") -> Column:
    return _where("<", c, lambda text: F.regexp_replace(text, _TAG, separator))


def page_text(html, separator: str = "") -> Column:
    """Visible text; adjacent elements are joined by the separator."""
    return decode(_without_tags(without_hidden(html), separator))


def inner_text(fragment) -> Column:
    """Trimmed text of a fragment without separators."""
    return strip(decode(_without_tags(fragment)))


def cell_text(fragment) -> Column:
    """Cleaned text of a cell, nested elements separated by a space."""
    return clean_cell(strip(decode(_without_tags(fragment, " "))))


def without_noise(html, hidden_gone: bool = False) -> Column:
    """The page without noise tags and without blocks whose class or id contains a noise word, each with all it holds.
    ``hidden_gone``: the page is given without its hidden parts."""
    tags = [t for t in R.NOISE_TAGS if t not in ("script", "style")]

    def noisy(m: Column) -> Column:
        def says(name: str, words) -> Column:
            return F.coalesce(markup.attribute(m["head"], name).rlike("(?i)" + "|".join(words)), F.lit(False))

        marked = says("class", R.NOISE_CLASS_WORDS) | says("id", R.NOISE_ID_WORDS)
        return m["name"].isin(*tags) | marked

    words = "|".join(dict.fromkeys((*R.NOISE_CLASS_WORDS, *R.NOISE_ID_WORDS)))
    hint = rf"""(?i)<(?:{"|".join(tags)})(?=[\s/>])|(?:class|id)\s*=\s*["']?[^"'<>]*(?:{words})"""

    def kept(page: Column) -> Column:
        marked = F.contains(page, F.lit("<")) & page.rlike(hint)
        return F.when(marked, markup.without(page, (*tags, *_BLOCK_TAGS), noisy)).otherwise(page)

    return let(col(html) if hidden_gone else without_hidden(html), kept)


def clean_page_text(html) -> Column:
    """Text of a page without navigation, scripts and other noise."""
    return text_of(without_noise(html))


def text_of(fragment) -> Column:
    """Text of a fragment, tags dropped."""
    return decode(_without_tags(fragment))


def all_inner(html, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(html), F.lit(pattern), F.lit(group))


def tables(html, limit: int | None = None, hidden_gone: bool = False) -> Column:
    """Inner markup of the tables, nested ones too. ``hidden_gone``: the page is given without its hidden parts."""
    return first_of(markup.bodies(col(html) if hidden_gone else without_hidden(html), ("table",)), limit)


def rows(table) -> Column:
    return markup.bodies(table, ("tr",))


def cells(row) -> Column:
    return markup.bodies(row, ("td", "th"))


def lists(html, limit: int | None = None) -> Column:
    return first_of(markup.bodies(html, ("ul", "ol", "dl")), limit)


def items(body) -> Column:
    return markup.bodies(body, ("li", "dt", "dd"))


def links(html) -> Column:
    return F.transform(all_inner(without_hidden(html), LINK), decode)


def title(html) -> Column:
    found = F.regexp_extract(col(html), r"(?is)<title\b[^<>]*>(.*?)(?:</title>|$)", 1)
    return F.when(found == "", "No title").otherwise(strip(decode(found)))


attribute = markup.attribute
