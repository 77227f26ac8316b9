"""Small SQL text helpers for the checking queries."""

from __future__ import annotations

import re

from statloom.functions import rules as R
from statloom.sources.views import VIEWS, view_dependencies


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(terms) -> str:
    return "[" + ", ".join(text(t) for t in terms) + "]"


def has(expr: str, terms) -> str:
    """Alternation search, a different formulation from the chain of contains in the library."""
    return f"regexp_matches({expr}, {text('|'.join(re.escape(t) for t in terms))})"


def n_has(expr: str, terms) -> str:
    return f"len(list_filter({words(terms)}, lambda w: contains({expr}, w)))"


def hits(expr: str, terms, limit: int | None = None, fold: bool = False) -> str:
    probe = "lower(w)" if fold else "w"
    found = f"list_filter({words(terms)}, lambda w: contains({expr}, {probe}))"
    return f"{found}[1:{limit}]" if limit else found


def labels(expr: str, groups, default: str) -> str:
    arms = " ".join(f"WHEN {has(expr, terms)} THEN {text(label)}" for terms, label in groups)
    return f"CASE {arms} ELSE {text(default)} END"


def rx(pattern: str, ignore_case: bool = True) -> str:
    return text(("(?i)" if ignore_case else "") + pattern)


def starts(expr: str, patterns) -> str:
    return f"regexp_matches({expr}, {rx('^(?:' + '|'.join(patterns) + ')')})"


def let(expr: str, name: str, body: str) -> str:
    return f"(list_transform([{expr}], lambda {name}: {body})[1])"


def number(expr: str, signs: str = "") -> str:
    """European number: the last of comma and point is the decimal separator."""
    strip = text(r"[^0-9\s,.\-" + signs + "]")
    body = (
        "TRY_CAST(CASE WHEN NOT contains(s, ',') THEN s "
        "WHEN NOT contains(s, '.') THEN replace(s, ',', '.') "
        "WHEN instr(reverse(s), ',') < instr(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') "
        "ELSE replace(s, ',', '') END AS DOUBLE)"
    )
    kept = f"replace(regexp_replace({expr}, {strip}, '', 'g'), ' ', '')"
    return let(f"regexp_replace(regexp_replace({kept}, '^[+-][+-].*$', 'x'), '^[+]', '')", "s", body)


def clean_number(expr: str) -> str:
    return let(
        number(expr, "+"), "v",
        "CASE WHEN abs(v) > 1e12 OR v BETWEEN 1900 AND 2030 THEN NULL ELSE v END",
    )


def with_views(*names: str) -> str:
    """WITH clause holding the named derived views and those they are built on."""
    ordered: list[str] = []
    for name in names:
        for dep in (*view_dependencies(name), name):
            if dep not in ordered:
                ordered.append(dep)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)


def word_count(expr: str) -> str:
    return f"len(list_filter(string_split_regex({expr}, '[\\s]+'), lambda w: w <> ''))"


def national_context(expr: str) -> dict[str, str]:
    """Pieces of the national-context score of a text."""
    low = f"lower({expr})"
    score = f"({n_has(low, R.NATIONAL_INSTITUTIONS)} + {n_has(low, R.NATIONAL_PLACES)} + {n_has(low, R.NATIONAL_TERMS)})"
    numbers = f"len(regexp_extract_all({expr}, '\\b[0-9]+[.,]?[0-9]*\\b'))"
    per_1000 = f"({numbers} * 1000.0 / greatest({word_count(expr)}, 1))"
    return {
        "is_national": f"({score} > 0)",
        "score": score,
        "strength": f"(CASE WHEN {score} >= 3 THEN 'high' WHEN {score} = 2 THEN 'medium' WHEN {score} = 1 THEN 'low' ELSE 'none' END)",
        "numeric_density": per_1000,
        "richness": f"(CASE WHEN {per_1000} > 50 THEN 'high' WHEN {per_1000} > 20 THEN 'medium' ELSE 'low' END)",
        "recent_years": f"len(regexp_extract_all({expr}, '\\b(202[0-9])\\b', 1))",
    }


def page_text(expr: str, hidden: str | None = None, separator: str = "") -> str:
    """Visible text of a page in the checking engine."""
    hidden = hidden or text(r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>")
    out = f"regexp_replace(regexp_replace({expr}, {hidden}, '', 'g'), '<[^>]*>', '{separator}', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {text(entity)}, {text(char)})"
    return out


def noise_pattern() -> str:
    """Blocks of noise tags, and blocks whose class or id contains a noise word, where none holds another of its name."""
    parts = ["<!--.*?-->"]
    parts += [rf"<{t}\b[^>]*>.*?</{t}>" for t in R.NOISE_TAGS]
    classes, ids = "|".join(R.NOISE_CLASS_WORDS), "|".join(R.NOISE_ID_WORDS)
    marked = (
        rf"""[^>]*\b(?:class\s*=\s*["'][^"'>]*(?:{classes})[^"'>]*["']|id\s*=\s*["'][^"'>]*(?:{ids})[^"'>]*["'])[^>]*"""
    )
    parts += [rf"<{t}\b{marked}>.*?</{t}>" for t in ("div", "ul", "ol", "dl", "table", "section", "p", "span", "li", "td")]
    return "(?is)" + "|".join(parts)
