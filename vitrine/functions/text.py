"""Text scalars (X9-X11, E26, E27) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.price import strip_blanks


def blank_to_null(c: Column) -> Column:
    """Optional field kept only if non-empty after trimming."""
    t = strip_blanks(c.cast("string"))
    return F.when(t != "", t)


def tags_array(c: Column) -> Column:
    """``'a, b,,c'`` -> ``['a','b','c']``."""
    return F.filter(F.transform(F.split(c, ","), strip_blanks), lambda t: t != "")


def same_text(a: Column, b: Column) -> Column:
    """Null and empty string compare equal; values compared as text."""
    return F.coalesce(a.cast("string"), F.lit("")) == F.coalesce(b.cast("string"), F.lit(""))


def strip_tags(c: Column) -> Column:
    """Remove ``<...>`` tags, then trim."""
    return strip_blanks(F.regexp_replace(c, r"<[^>]+>", ""))


def labelled_search_text(df_cols: dict[str, Column]) -> Column:
    """``'Title: x | Brand: y | ...'`` for the fields that are set."""
    labels = [("title", "Title"), ("brand", "Brand"), ("description", "Description"),
              ("category", "Category"), ("gender", "Gender"), ("price", "Price"),
              ("size", "Sizes"), ("metadata", "Details")]
    parts = []
    for key, label in labels:
        c = df_cols.get(key)
        if c is None:
            continue
        parts.append(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c)))
    return F.concat_ws(" | ", *parts)


def plain_search_text(df_cols: dict[str, Column], metadata_map: Column | None = None) -> Column:
    """Trimmed fields blank-joined, then tags, ``k: v`` metadata pairs and country."""
    parts = []
    for key in ("title", "brand", "description", "category", "gender", "price", "sale", "size",
                "other", "merchant_name"):
        c = df_cols.get(key)
        if c is not None:
            parts.append(blank_to_null(c))
    tags = df_cols.get("tags")
    if tags is not None:
        parts.append(F.when(F.size(tags) > 0, F.array_join(tags, " ")))
    if metadata_map is not None:
        pairs = F.transform(F.filter(F.map_entries(metadata_map),
                                     lambda e: F.coalesce(e["value"], F.lit("")) != ""),
                            lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
        parts.append(F.when(F.size(pairs) > 0, F.array_join(pairs, " ")))
    country = df_cols.get("country")
    if country is not None:
        parts.append(F.when(F.coalesce(country, F.lit("")) != "", F.concat(F.lit("country: "), country)))
    return F.concat_ws(" ", *parts)
