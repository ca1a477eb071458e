"""DuckDB text for the oracle queries: the same rules as the Column code in
``vitrine.functions``, written once here so every oracle uses one version."""

from __future__ import annotations

from vitrine.functions.price import PRICE_PAIR

_BLANKS = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def strip_blanks(e: str) -> str:
    return f"regexp_replace(CAST({e} AS VARCHAR), '{_BLANKS}', '', 'g')"


def normalize_price(e: str) -> str:
    """X1 in DuckDB."""
    t = strip_blanks(e)
    a = f"regexp_extract_all({t}, '{PRICE_PAIR}', 1)"
    k = f"regexp_extract_all({t}, '{PRICE_PAIR}', 2)"
    pairs = (f"list_transform(list_zip({a}, {k}), lambda z: "
             f"regexp_replace(replace(z[1], ',', '.'), '\\.00$', '', 'g') || upper(z[2]))")
    return (f"(CASE WHEN {t} IS NULL OR {t} = '' THEN NULL "
            f"WHEN len({a}) > 0 THEN array_to_string({pairs}, ',') ELSE {t} END)")


def row_id(source: str, url: str) -> str:
    return f"sha256({source} || ':' || {url})"


def blank_to_null(e: str) -> str:
    t = strip_blanks(e)
    return f"(CASE WHEN {t} <> '' THEN {t} END)"


def reject_reason(title: str = "title", source: str = "source", url: str = "product_url",
                  image: str = "image_url") -> str:
    def missing(c: str) -> str:
        return f"coalesce(trim(CAST({c} AS VARCHAR)), '') = ''"
    return (f"(CASE WHEN {missing(title)} THEN 'no_title' WHEN {missing(source)} THEN 'no_source' "
            f"WHEN {missing(url)} THEN 'no_product_url' WHEN {missing(image)} THEN 'no_image_url' END)")


def same_text(a: str, b: str) -> str:
    return f"(coalesce(CAST({a} AS VARCHAR), '') = coalesce(CAST({b} AS VARCHAR), ''))"


def initcap(e: str) -> str:
    """Spark ``initcap``: first letter of each blank-separated word upper, rest lower."""
    return (f"array_to_string(list_transform(string_split({e}, ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")
