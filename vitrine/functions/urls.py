"""URL, link, id and handle scalars (X5-X8, E19, E20, F1-F3) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(arr, i: int):
    """1-based array access that yields null when out of range (ANSI-safe)."""
    return F.try_element_at(arr, F.lit(i))


# Fixed values that must equal the reference's for right results.
PRODUCT_PATH = "/products/"
GIFT_CARD_TOKENS = ("giftcard", "gift-card", "card")   # bare-substring parity mode
QUICK_VIEW = "quick-view"
# Build default for Q9: gift cards and the whole word "card" only, so that
# "cardigan" stays.
GIFT_CARD_WORD = r"gift-?card|(^|[^a-z])card([^a-z]|$)"


def product_link(href: Column) -> Column:
    """the href points at a product page."""
    return F.coalesce(href.contains(PRODUCT_PATH), F.lit(False))


def gift_card(href: Column, mode: str = "word") -> Column:
    """gift-card link. ``substring`` mode keeps the reference's token test."""
    h = F.lower(href)
    if mode == "substring":
        return F.coalesce(F.exists(F.array(*[F.lit(t) for t in GIFT_CARD_TOKENS]), lambda t: F.instr(h, t) > 0),
                          F.lit(False))
    return F.coalesce(h.rlike(GIFT_CARD_WORD), F.lit(False))


def quick_view(href: Column) -> Column:
    """quick-view link (third link rule only)."""
    return F.coalesce(F.lower(href).contains(QUICK_VIEW), F.lit(False))


def fix_protocol(url: Column) -> Column:
    """``//host/x`` -> ``https://host/x``."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def site_root(page_url: Column) -> Column:
    """``scheme://host`` of a page URL."""
    return F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def absolutize(href: Column, page_url: Column) -> Column:
    """X5 + X6: protocol-relative and root-relative links made absolute."""
    return (F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
            .when(href.startswith("/"), F.concat(site_root(page_url), href))
            .otherwise(href))


def row_id(source: Column, product_url: Column) -> Column:
    """sha256 hex of ``source:product_url``."""
    return F.sha2(F.concat(source, F.lit(":"), product_url), 256)


def url_path(url: Column) -> Column:
    """Path part of a URL without query or fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def product_handle(url: Column, json_handle: Column | None = None) -> Column:
    """JSON handle, else ``/products/([^/?#]+)``, else last path segment."""
    from_path = F.regexp_extract(url, r"/products/([^/?#]+)", 1)
    last = F.regexp_extract(_at(F.split(url, "/"), -1), r"^([^?]*)", 1)
    parts = [F.nullif(from_path, F.lit("")), last]
    if json_handle is not None:
        parts.insert(0, F.nullif(json_handle, F.lit("")))
    return F.coalesce(*parts)


def external_id(url: Column) -> Column:
    """First digit run of the product handle, else the handle; path
    fallback (slashes -> dashes) when there is no ``products`` segment."""
    path = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    handle = F.regexp_extract(F.concat(F.lit("/"), path), r"/products/([^/]+)", 1)
    digits = F.regexp_extract(handle, r"(\d+)", 1)
    return (F.when(handle != "", F.when(digits != "", digits).otherwise(handle))
            .otherwise(F.regexp_replace(path, "/", "-")))


def slug_title(url: Column) -> Column:
    """Title from the segment after ``products``; dashes become blanks."""
    seg = F.regexp_extract(url, r"/products/([^/]*)", 1)
    return F.when(seg != "", F.initcap(F.regexp_replace(seg, "-", " ")))
