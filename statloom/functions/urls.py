"""URL projections and routing rules. All functions map columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import any_in, chain, col, ends_with_any, is_true

_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"


def authority(url) -> Column:
    """Host with port and user part, empty when the URL has none."""
    return F.regexp_extract(F.trim(col(url)), _AUTHORITY, 1)


def is_valid(url) -> Column:
    return is_true(F.trim(col(url)).rlike(r"^https?://[^/?#]"))


def is_present(url) -> Column:
    return is_true(F.trim(col(url)) != "")


def domain(url, lower: bool = False) -> Column:
    host = authority(url)
    host = F.lower(host) if lower else host
    return F.when(host != "", host).otherwise("unknown_domain")


def normalise(url) -> Column:
    """Drop query and fragment."""
    return F.regexp_replace(F.trim(col(url)), r"(?s)[?#].*$", "")


def is_requestable(url) -> Column:
    """Request form: only the scheme is checked."""
    return is_true(F.trim(col(url)).rlike(r"^https?://"))


def url_type(url) -> Column:
    low = F.lower(col(url))
    host = F.lower(domain(url))
    return chain(
        [
            (any_in(low, R.URL_API), F.lit("api")),
            (any_in(host, R.DOMAIN_NATIONAL), F.lit("government_tunisian")),
            (ends_with_any(low, R.URL_DOCUMENT_ENDINGS), F.lit("document")),
            (any_in(host, R.DOMAIN_COMMERCIAL), F.lit("commercial")),
        ],
        F.lit("general_web"),
    )


def site_type(url) -> Column:
    low = F.lower(col(url))
    return chain([(F.contains(low, F.lit(t)), F.lit(v)) for t, v in R.SITE_TYPES], F.lit("complex_site"))


def is_gov_site(url) -> Column:
    return any_in(F.lower(col(url)), R.DOMAIN_GOV)


def source_analysis(url, content_type=None) -> dict[str, Column]:
    """Government and trust flags, content type and language of a source."""
    host = F.lower(domain(url))
    header = F.lower(F.coalesce(col(content_type), F.lit(""))) if content_type is not None else F.lit("")
    national = any_in(host, R.DOMAIN_NATIONAL)
    international = any_in(host, R.DOMAIN_INTERNATIONAL)
    return {
        "domain": domain(url),
        "is_government": any_in(host, [".gov.", ".gouv."]),
        "is_trusted": national | international,
        "content_type": chain(
            [
                (F.contains(header, F.lit("json")) | (url_type(url) == "api"), F.lit("api_data")),
                (F.contains(header, F.lit("application/pdf")), F.lit("pdf_document")),
                (any_in(header, ["excel", "spreadsheet"]), F.lit("excel_document")),
            ],
            F.lit("web_page"),
        ),
        "language": F.when(national, "french_arabic").when(international, "english").otherwise("mixed"),
    }


def decisive_type(url) -> Column:
    """Type that settles a URL list, null when the scan goes on."""
    low = F.lower(col(url))
    return F.when(any_in(low, ["bct.gov.tn", "ins.tn", ".gov."]), "government_official").when(
        any_in(low, ["api.", ".json"]), "api_data"
    )


def domain_policy(host, policy=R.DOMAIN_POLICY, default: int = R.DOMAIN_POLICY_DEFAULT) -> Column:
    """Time limit of a domain: exact entry, else first contained entry, else the default."""
    h = col(host)
    exact = [(h == p, F.lit(v)) for p, v in policy]
    partial = [(F.contains(h, F.lit(p)), F.lit(v)) for p, v in policy]
    return chain(exact + partial, F.lit(default))


def domain_policy_source(host, policy=R.DOMAIN_POLICY) -> Column:
    return F.when(col(host).isin([p for p, _ in policy]), "domain_specific").otherwise("pattern_match")


def route_by_type(url, national_context=None, richness=None) -> dict[str, Column]:
    """Route with confidence, reason and fallback from URL type and optional content features."""
    kind = url_type(url)
    context = is_true(national_context) if national_context is not None else F.lit(False)
    rich = is_true(richness == "high") if richness is not None else F.lit(False)
    # Route, confidence and reason of each case.
    cases = [
        (kind == "api", "traditional", 0.9, "API détectée - méthode traditionnelle optimale"),
        (kind == "government_tunisian", "intelligent", 0.95, "Site gouvernemental tunisien - méthode intelligente nécessaire"),
        (kind == "document", "intelligent", 0.8, "Document détecté - extraction spécialisée requise"),
        (context, "intelligent", 0.8, "Contenu tunisien détecté - optimisation contextuelle"),
        (rich, "traditional", 0.7, "Données structurées détectées - méthode traditionnelle efficace"),
    ]
    route = chain([(c, F.lit(r)) for c, r, _, _ in cases], F.lit("traditional"))
    return {
        "route": route,
        "route_confidence": chain([(c, F.lit(v)) for c, _, v, _ in cases], F.lit(0.6)),
        "route_reason": chain([(c, F.lit(m)) for c, _, _, m in cases], F.lit("Stratégie par défaut optimisée")),
        "route_fallback": other_route(route),
    }


def other_route(route: Column) -> Column:
    return F.when(route == "traditional", "intelligent").otherwise("traditional")


def route_by_domain(url) -> Column:
    low = F.lower(col(url))
    host = F.lower(authority(url))
    return chain(
        [
            (any_in(low, R.ROUTE_COORD_API), F.lit("traditional")),
            (any_in(host, R.DOMAIN_GOV), F.lit("intelligent")),
            (any_in(low, R.ROUTE_COORD_DYNAMIC), F.lit("intelligent")),
        ],
        F.lit("traditional"),
    )


def route_by_graph(url) -> Column:
    """Only structured endpoints take the plain route; every other site takes the other one."""
    return F.when(any_in(F.lower(col(url)), R.ROUTE_GRAPH_API), "traditional").otherwise("intelligent")


def route_by_agent(url) -> Column:
    return F.when(any_in(F.lower(col(url)), R.ROUTE_AGENT_API), "traditional").otherwise("intelligent")


def needs_model_by_url(url, requested=False, available=True) -> Column:
    low = F.lower(col(url))
    return F.lit(requested) | (F.lit(available) & any_in(low, R.MODEL_URL_ON))


def needs_model_by_page(url, strength, n_values, requested=False, available=True) -> Column:
    low = F.lower(col(url))
    wanted = (
        F.lit(requested)
        | is_true(col(strength).isin("high", "medium"))
        | (F.coalesce(col(n_values), F.lit(0)) < 5)
        | any_in(low, R.MODEL_URL_COMPLEX)
    )
    return F.lit(available) & wanted


def redact(url) -> Column:
    """Hide the password of a connection URL."""
    return F.regexp_replace(col(url), r"://([^:]+):([^@]+)@", "://$1:***@")


def is_crawlable(href, full_url, base_host, excluded=R.LINK_EXCLUDED) -> Column:
    """Same host, no fragment, at most three ampersands, no excluded word, not a binary file."""
    h, low = col(href), F.lower(col(full_url))
    complex_query = F.contains(h, F.lit("?")) & (F.regexp_count(h, F.lit("&")) > 3)
    return (
        (authority(full_url) == col(base_host))
        & ~F.contains(h, F.lit("#"))
        & ~complex_query
        & ~any_in(low, excluded)
        & ~ends_with_any(low, R.LINK_BINARY_ENDINGS)
    )


def is_priority_link(url, priority=R.LINK_PRIORITY) -> Column:
    return any_in(F.lower(col(url)), priority)


def resolve(href, base) -> Column:
    """Absolute form of a link: absolute, protocol-relative, rooted, query-only, fragment-only or
    relative to the folder of the base page."""
    h, b = F.trim(col(href)), F.trim(col(base))
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    root = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(b, r"(?s)[?#].*$", "")
    folder = F.when(
        bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*/"), F.regexp_replace(bare, r"[^/]*$", "")
    ).otherwise(F.concat(bare, F.lit("/")))
    joined = chain(
        [
            (h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h),
            (F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h)),
            (F.startswith(h, F.lit("/")), F.concat(root, h)),
            (F.startswith(h, F.lit("?")), F.concat(bare, h)),
            (F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(b, r"(?s)#.*$", ""), h)),
            (h == "", F.regexp_replace(b, r"(?s)#.*$", "")),
        ],
        F.concat(folder, F.regexp_replace(h, r"^\./", "")),
    )
    return joined
