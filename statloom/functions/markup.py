"""Elements of HTML as found: nested, unclosed and unquoted markup, by Spark's array functions.

A page is cut into tokens in one pass: structural tags, and everything between them. Opening and closing tags are folded
with a stack of open elements. A closing tag closes the nearest open element of its name and all that were opened in
it; a closing tag without an open element is ignored; what stays open ends with the page. So an element is a span of
tokens, and its body is their text.

The cut never looks beyond the next ``<``, and what is not closed (comments, scripts) ends with the page, so a hostile page
costs no more than its length. The fold works in portions: finished elements are collected per portion, not one by one;
the stack is bounded by ``DEPTH``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions.common import col, let

#: Tags whose nesting is followed. Others neither hold nor close them.
STRUCTURE = (
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "li", "dt", "dd", "form", "div", "section", "article",
    "nav", "header", "footer", "aside", "main",
)
#: Tags that never hold anything.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Any tag, as a name for the functions below.
ANY = "[a-z][a-z0-9]*"
#: Open elements at a time. As in browsers, an element that would lie deeper stands beside the innermost one.
DEPTH = 256
#: Tags that are folded at a time.
PORTION = 256
HIDDEN = r"(?is)<(?:!--(?:.*?-->|.*)|script\b[^<>]*>(?:.*?</script\s*>|.*)|style\b[^<>]*>(?:.*?</style\s*>|.*))"

_STACK = "array<struct<name:string,at:int,kept:boolean>>"
_ELEMENTS = "array<struct<head:string,body:string,name:string>>"
_DONE = "array<struct<from:int,to:int,name:string,next:int>>"


#: Attributes and end of an opening tag.
_REST = r"""(?=[\s/>])[^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+(?<!/)>"""


def _whole(tags: Sequence[str], inner: str = "", name: str = "t") -> str:
    """A complete element of these tags that holds text and complete ``inner`` elements only."""
    followed = "|".join(dict.fromkeys((*tags, *STRUCTURE)))
    text = rf"[^<]++|<(?!/?(?:{followed})(?=[\s/>]))"
    return rf"<(?<{name}>{'|'.join(tags)}){_REST}(?<{name}b>(?:{text}{'|' + inner if inner else ''})*+)</\k<{name}>\s*+>"


_CELL = _whole(("td", "th"), name="c")
_ROW = _whole(("tr",), _CELL, "r")
_TABLE = _whole(("table",), rf"{_ROW}|{_whole(('thead', 'tbody', 'tfoot'), _ROW.replace('<r', '<q').replace('<c', '<d'), 's')}", "t")
_ITEM = _whole(("li", "dt", "dd"), name="i")
_LIST = _whole(("ul", "ol", "dl"), _ITEM, "l")
#: Elements that a plain search finds as the fold does, if all their tags belong to such elements.
_PLAIN = {("td", "th"): _CELL, ("tr",): _ROW, ("table",): _TABLE, ("li", "dt", "dd"): _ITEM, ("ul", "ol", "dl"): _LIST}
#: A complete element with complete elements inside, four levels in all.
_BALANCED = reduce(lambda inner, name: _whole(STRUCTURE, inner, name), "jklm", "")


def _token(tags: Sequence[str]) -> str:
    """One token: a tag of these names, with its quoted values, or the longest run without one."""
    name = rf"/?(?:{'|'.join(tags)})(?=[\s/>])"
    quoted = r"""(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+"""
    return rf"""(?is)<{name}[^<>"']*+{quoted}>|<{name}[^<>]*+>?|(?:[^<]++|<(?!{name}))++"""


def _marks(tokens: Column, tags: Sequence[str], keep: Callable[[Column], Column]) -> Column:
    """The tags among the tokens: place, name, kind (open, close, or empty) and whether the element is wanted."""

    def mark(token: Column, at: Column) -> Column:
        named = F.regexp_extract(token, rf"(?is)^</?({'|'.join(tags)})(?=[\s/>])", 1)
        name = F.when(F.startswith(token, F.lit("<")), F.lower(named)).otherwise("")
        kind = F.when(F.startswith(token, F.lit("</")), "close").when(F.endswith(token, F.lit("/>")), "empty").otherwise("open")
        return F.struct(at.alias("at"), name.alias("name"), kind.alias("kind"), token.alias("head"))

    def placed(m: Column) -> Column:
        kind = F.when((m["kind"] == "open") & m["name"].isin(*VOID), "empty").otherwise(m["kind"])
        return F.struct(m["at"], m["name"], kind.alias("kind"), ((m["kind"] != "close") & keep(m)).alias("kept"))

    return F.transform(F.filter(F.transform(tokens, mark), lambda m: m["name"] != ""), placed)


def _closed(opened: Column, to: Column, after: Column) -> Column:
    """Spans of wanted elements that end before the token ``to``; the page goes on at ``after``."""
    span = lambda s: F.struct(s["at"].alias("from"), to.alias("to"), s["name"].alias("name"), after.alias("next"))
    return F.transform(F.filter(opened, lambda s: s["kept"]), span)


def _step(state: Column, m: Column) -> Column:
    """Stack (innermost first) and finished elements after one tag. Each tag is tested for the common cases first: the stack
    has room, a closing tag belongs to the innermost element, an element isn't wanted."""
    stack, done = state["stack"], state["done"]
    entry = F.struct(m["name"].alias("name"), m["at"].alias("at"), m["kept"].alias("kept"))
    top = F.get(stack, F.lit(0))

    def after(stack: Column, done: Column) -> Column:
        return F.struct(stack.alias("stack"), done.alias("done"))

    def closed(place: Column) -> Column:
        """``place``: where the nearest open element of this name is, from 1; 0 without one."""
        inside, own = F.slice(stack, 1, place - 1), F.slice(stack, place, F.lit(1))
        ended = F.concat(done, _closed(inside, m["at"], m["at"]), _closed(own, m["at"], m["at"] + 1))
        return F.when(place > 0, after(F.slice(stack, place + 1, F.size(stack)), ended)).otherwise(state)

    own = F.when(top["kept"], F.concat(done, _closed(F.array(top), m["at"], m["at"] + 1))).otherwise(done)
    beside = F.concat(done, _closed(F.array(top), m["at"], m["at"]))
    empty = F.when(m["kept"], after(stack, F.concat(done, _closed(F.array(entry), m["at"], m["at"] + 1)))).otherwise(state)
    return (
        F.when((m["kind"] == "open") & (F.size(stack) < DEPTH), after(F.concat(F.array(entry), stack), done))
        .when(m["kind"] == "open", after(F.concat(F.array(entry), F.slice(stack, 2, DEPTH)), beside))
        .when(m["kind"] == "empty", empty)
        .when(top["name"] == m["name"], after(F.slice(stack, 2, DEPTH), own))
        .otherwise(let(F.array_position(stack["name"], m["name"]).cast("int"), closed))
    )


def _spans(marks: Column, end: Column) -> Column:
    """``from, to, name`` of the wanted elements by place; ``to`` is the token that closes them. Without a wanted tag there
    is nothing to fold."""
    nothing = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(_DONE).alias("done"))

    def portion(state: Column, k: Column) -> Column:
        start = F.struct(state["stack"].alias("stack"), F.array().cast(_DONE).alias("done"))
        joined = lambda f: F.struct(f["stack"].alias("stack"), F.concat(state["done"], f["done"]).alias("done"))
        return F.reduce(F.slice(marks, k * PORTION + 1, F.lit(PORTION)), start, _step, joined)

    portions = F.sequence(F.lit(0), F.floor(F.size(marks) / PORTION).cast("int"))
    folded = F.reduce(portions, nothing, portion, lambda s: F.sort_array(F.concat(s["done"], _closed(s["stack"], end, end))))
    return F.when(F.exists(marks, lambda m: m["kept"]), folded).otherwise(F.array().cast(_DONE))


def elements(html, tags: Sequence[str], keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of ``head`` (the opening tag), ``body`` (its inner markup) and ``name`` of all elements of these tags, in the
    order of the page, nested ones too. ``keep`` tests a struct of name and head.

    Where the tags all belong to complete elements that hold complete elements of other names only, a search gives the same
    as the fold and is taken. A page with more tags than the stack may hold is always folded."""
    if not set(tags) <= set(STRUCTURE):
        return _folded(html, tags, keep)
    opening = rf"(?is)<(?:{'|'.join(tags)}){_REST}"
    whole = rf"{opening}((?:[^<]++|<(?!/?(?:{'|'.join(STRUCTURE)})(?=[\s/>]))|{_BALANCED})*+)</(?:{'|'.join(tags)})\s*+>"

    def searched(page: Column) -> Column:
        def one(text: Column) -> Column:
            head, body = F.regexp_extract(text, opening, 0), F.regexp_extract(text, whole, 1)
            name = F.lower(F.regexp_extract(text, r"^<([A-Za-z0-9]+)", 1))
            return F.struct(head.alias("head"), body.alias("body"), name.alias("name"))

        def chosen(texts: Column) -> Column:
            # The search takes the closing tag of any of these names.
            matched = F.forall(texts, lambda x: x.rlike(rf"(?is)^<({'|'.join(tags)})(?=[\s/>]).*</\1\s*>$"))
            complete = F.regexp_count(page, F.lit(rf"(?i)</?(?:{'|'.join(tags)})(?=[\s/>])")) == 2 * F.size(texts)
            found = F.transform(texts, one)
            wanted = found if keep is None else F.filter(found, lambda e: keep(F.struct(e["name"], e["head"])))
            return F.when(complete & matched, wanted).otherwise(_folded(page, tags, keep))

        opened = F.regexp_count(page, F.lit(rf"(?i)<(?:{'|'.join(STRUCTURE)})(?=[\s/>])"))
        plain = let(F.regexp_extract_all(page, F.lit(whole), F.lit(0)), chosen)
        return F.when(opened <= DEPTH, plain).otherwise(_folded(page, tags, keep))

    return F.coalesce(let(col(html), searched), F.array().cast(_ELEMENTS))


def _folded(html, tags: Sequence[str], keep: Callable[[Column], Column] | None = None) -> Column:
    """As :func:`elements`, by the fold."""
    followed = (ANY,) if ANY in tags else tuple(dict.fromkeys((*tags, *STRUCTURE)))

    def wanted(m: Column) -> Column:
        ours = F.lit(True) if ANY in tags else m["name"].isin(*tags)
        return ours & keep(m) if keep is not None else ours

    def cut(tokens: Column) -> Column:
        def one(e: Column) -> Column:
            inner = F.slice(tokens, e["from"] + 2, F.greatest(e["to"] - e["from"] - 1, F.lit(0)))
            return F.struct(F.get(tokens, e["from"]).alias("head"), F.array_join(inner, "").alias("body"), e["name"].alias("name"))

        return F.transform(let(_marks(tokens, followed, wanted), lambda m: _spans(m, F.size(tokens))), one)

    return F.coalesce(let(F.regexp_extract_all(col(html), F.lit(_token(followed)), F.lit(0)), cut), F.array().cast(_ELEMENTS))


def attribute(tag, name: str) -> Column:
    """Value of an attribute of an opening tag, quoted or not; null when absent."""
    value = r"""(?:"|'|(?=[^\s"'<>]))((?<=")[^"]*(?=")|(?<=')[^']*(?=')|(?<!["'])[^\s"'<>]+)"""
    pattern = rf"(?is)(?<![\w-]){name}\s*=\s*{value}"
    return F.when(col(tag).rlike(pattern), F.regexp_extract(col(tag), pattern, 1))


def bodies(
    html, tags: Sequence[str], keep: Callable[[Column], Column] | None = None, hint: str | None = None, search: bool = False
) -> Column:
    """Inner markup of the elements. Where every tag of these names belongs to a complete element with nothing but
    complete cells, rows or items inside, a search gives the same as the fold and is taken. ``hint`` is a pattern that a
    page with a wanted element must match: other pages are not cut into tokens. ``search`` asks for the search of
    :func:`elements` too, which makes the plan larger."""
    found_by = elements if search else _folded
    nothing = F.array().cast("array<string>")

    def folded(page: Column) -> Column:
        found = F.transform(found_by(page, tags, keep), lambda e: e["body"])
        may = has_tag(page, tags) if hint is None else has_tag(page, tags) & page.rlike(hint)
        return F.when(may, found).otherwise(nothing)

    if keep is not None or tuple(tags) not in _PLAIN:
        return F.coalesce(let(col(html), folded), nothing)

    def searched(page: Column) -> Column:
        def chosen(plain: Column) -> Column:
            complete = F.regexp_count(page, F.lit(rf"(?i)</?(?:{'|'.join(tags)})(?=[\s/>])")) == 2 * F.size(plain)
            return F.when(complete, plain).otherwise(F.transform(_folded(page, tags), lambda e: e["body"]))

        found = let(F.regexp_extract_all(page, F.lit("(?is)" + _PLAIN[tuple(tags)]), F.lit(2)), chosen)
        return F.when(has_tag(page, tags), found).otherwise(nothing)

    return F.coalesce(let(col(html), searched), nothing)


def attribute_hint(name: str, pattern: str) -> str:
    """A pattern for pages: some attribute of this name has a value in which the pattern (without anchors) is found."""
    return rf"(?is){name}\s*=[^<]*?(?:{pattern})"


def has_tag(html, tags: Sequence[str]) -> Column:
    return F.coalesce(col(html).rlike(rf"(?i)<(?:{'|'.join(tags)})(?=[\s/>])"), F.lit(False))


def without(html, tags: Sequence[str], keep: Callable[[Column], Column]) -> Column:
    """The page without the elements that ``keep`` picks."""
    followed = tuple(dict.fromkeys((*tags, *STRUCTURE)))

    def outermost(spans: Column) -> Column:
        """Spans that no earlier span holds: spans are nested or apart."""
        last = F.lit(0)
        grown = lambda acc, s: F.when(s["from"] >= acc["end"], F.struct(s["next"].alias("end"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)
        start = F.struct(last.alias("end"), F.array().cast(_DONE).alias("out"))
        return F.reduce(spans, start, grown, lambda acc: acc["out"])

    def cut(tokens: Column) -> Column:
        def rest(spans: Column) -> Column:
            begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["next"]))
            ends = F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.size(tokens)))
            pieces = F.zip_with(begins, ends, lambda a, b: F.array_join(F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0))), ""))
            return F.array_join(pieces, "")

        found = let(_marks(tokens, followed, lambda m: m["name"].isin(*tags) & keep(m)), lambda m: _spans(m, F.size(tokens)))
        return let(let(found, outermost), rest)

    return F.coalesce(let(F.regexp_extract_all(col(html), F.lit(_token(followed)), F.lit(0)), cut), F.lit(""))
