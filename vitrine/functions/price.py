"""Price scalars (X1-X4) as Column expressions; they stay inside codegen.

Money is decimal(18,2); doubles are never formatted to text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
# Amount + currency pair, case-insensitive; U+00A0 is written out because Java
# and RE2 do not count it as \s.
PRICE_PAIR = r"(?i)(\d+(?:[.,]\d+)?)[\s\x{00A0}]*([A-Z]{2,3})\b"
CZK_TO_EUR = "0.042"
CZK_PATTERN = r"([\d\s.,]+)\s*CZK"
EUR_PATTERN = r"(\d+(?:[.,]\d+)?)\s*EUR"
# Thousands grouping such as 1.234,50 loses its leading group in X1 (Q7).
THOUSANDS_PATTERN = r"\d{1,3}([.,]\d{3})+([.,]\d+)?"

_EDGE_BLANKS = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def strip_blanks(c: Column) -> Column:
    """Trim whitespace including U+00A0 at both ends."""
    return F.regexp_replace(c, _EDGE_BLANKS, "")


def normalize_price(c: Column) -> Column:
    """``'20 USD, 450 CZK'`` -> ``'20USD,450CZK'``; ``'139,00 EUR'`` -> ``'139EUR'``.

    Null or blank -> null; text without a pair -> trimmed text unchanged.
    """
    text = strip_blanks(c.cast("string"))
    amounts = F.regexp_extract_all(text, F.lit(PRICE_PAIR), 1)
    codes = F.regexp_extract_all(text, F.lit(PRICE_PAIR), 2)
    pairs = F.zip_with(
        amounts, codes,
        lambda a, k: F.concat(F.regexp_replace(F.regexp_replace(a, ",", "."), r"\.00$", ""), F.upper(k)),
    )
    return (F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
            .when(F.size(pairs) > 0, F.array_join(pairs, ","))
            .otherwise(text))


def normalize_price_list(c: Column) -> Column:
    """X1 over a list of price texts: each item normalised, then flattened."""
    parts = F.flatten(F.transform(
        F.filter(F.transform(c, normalize_price), lambda p: p.isNotNull()),
        lambda p: F.split(p, ","),
    ))
    parts = F.filter(F.transform(parts, strip_blanks), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, ","))


def price_pairs(c: Column) -> Column:
    """Normalised text -> ``array<struct<amount decimal(18,2), currency string>>``."""
    items = F.split(c, ",")
    return F.filter(
        F.transform(items, lambda s: F.struct(
            F.regexp_extract(s, r"^([0-9.]+)", 1).try_cast("decimal(18,2)").alias("amount"),
            F.regexp_extract(s, r"([A-Z]+)$", 1).alias("currency"))),
        lambda p: p["amount"].isNotNull())


def price_suspect(c: Column) -> Column:
    """Q7 flag: the text holds a thousands grouping that X1 truncates."""
    return F.coalesce(c.rlike(THOUSANDS_PATTERN), F.lit(False))


def money_text(amount: Column, currency: str = "EUR") -> Column:
    """decimal -> ``'12.50EUR'``."""
    return F.concat(amount.cast("decimal(18,2)").cast("string"), F.lit(currency))


def czk_to_eur(text: Column) -> Column:
    """``'1 234,50 CZK'`` -> amount * 0.042 as ``'51.85EUR'``; null if absent."""
    raw = F.regexp_extract(text, CZK_PATTERN, 1)
    num = F.regexp_replace(F.regexp_replace(raw, r"[\s.]", ""), ",", ".")
    amount = num.try_cast("decimal(28,10)") * F.lit(CZK_TO_EUR).cast("decimal(4,3)")
    return F.when(num != "", money_text(F.round(amount, 2)))


def eur_text(text: Column) -> Column:
    """X3 with dot decimals accepted (Q8): ``'139.00 EUR'`` -> ``'139.00EUR'``."""
    raw = F.regexp_extract(text, EUR_PATTERN, 1)
    amount = F.regexp_replace(raw, ",", ".").try_cast("decimal(18,2)")
    return F.when(raw != "", money_text(amount))


def minor_units_eur(units: Column) -> Column:
    """Integer minor units -> ``'12.50EUR'``."""
    amount = units.cast("string").try_cast("decimal(20,0)") / F.lit(100)
    return F.when(amount.isNotNull() & (amount != 0), money_text(amount))


def html_price(text: Column) -> Column:
    """P1 price chain on one element text: CZK first, then EUR."""
    return F.coalesce(czk_to_eur(text), eur_text(text))
