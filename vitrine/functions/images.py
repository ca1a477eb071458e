"""Image URL filters (F5 strict file-name filter, F6 soft element filter)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.classify import has_any


def _at(arr, i: int):
    """1-based array access that yields null when out of range (ANSI-safe)."""
    return F.try_element_at(arr, F.lit(i))


# ---- Fixed values that must equal the reference's for right results. ----
MEANINGFUL_TERMS = ["pants", "knit", "zipper", "jacket", "shirt", "coat", "dress", "skirt", "jeans", "short",
                    "sweater", "top", "boot", "shoe", "sneaker", "hat", "cap", "bag", "belt", "wallet", "scarf",
                    "jewelry", "accessory", "blue", "red", "black", "white", "green", "dark", "light"]
HEX_RUN = r"[a-f0-9]{32,}"
NUMERIC_PREFIX = r"^\d+_"
REJECT_PREFIXES = ["DROP_", "CO"]
CODE_NAME = r"^[A-Z]{2,}\d+\.jpg$"
VARIANT_SUFFIX = r"_(\d+)\.jpg$"
MAX_VARIANT = 2
SRC_SKIP = ["logo", "icon", "social", "flag", "placeholder"]
ALT_SKIP = ["logo", "icon", "flag"]
CLASS_SKIP = ["logo", "icon"]
IMAGE_EXTS = ["jpg", "jpeg", "png", "webp"]
MIN_SRC_LEN = 30
# ---- end of fixed values ----


def file_name(url: Column) -> Column:
    """Text after the last ``/`` and before the first ``?``."""
    return F.split(_at(F.split(url, "/"), -1), r"\?").getItem(0)


def desired_image(url: Column) -> Column:
    """the strict file-name filter; null or empty URL -> False."""
    name = file_name(url)
    rejected = (name.rlike(HEX_RUN) | name.rlike(NUMERIC_PREFIX)
                | name.startswith(REJECT_PREFIXES[0]) | name.startswith(REJECT_PREFIXES[1])
                | name.rlike(CODE_NAME)
                | F.coalesce(F.regexp_extract(name, VARIANT_SUFFIX, 1).try_cast("decimal(38,0)") > MAX_VARIANT,
                             F.lit(False)))
    meaningful = has_any(name, MEANINGFUL_TERMS, "substring")
    multi_part = F.instr(F.regexp_replace(name, r"\.jpg", ""), "_") > 0
    ok = ~rejected & meaningful & multi_part
    return F.coalesce(F.when(F.coalesce(url, F.lit("")) != "", ok), F.lit(False))


def product_image(src: Column, alt: Column, classes: Column, brand: str) -> Column:
    """the soft filter over an ``img`` element's src, alt and class text."""
    s = F.lower(src)
    bad = (has_any(s, SRC_SKIP, "substring")
           | has_any(F.coalesce(alt, F.lit("")), ALT_SKIP + ([brand.lower()] if brand else []), "substring")
           | has_any(F.coalesce(classes, F.lit("")), CLASS_SKIP, "substring"))
    return F.coalesce(~bad & has_any(s, IMAGE_EXTS, "substring") & (F.length(src) >= MIN_SRC_LEN), F.lit(False))
