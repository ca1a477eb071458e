"""Gender and category rules (E12-E17, Q10, Q11) as Column expressions.

Two match modes: ``substring`` keeps the reference's bare ``in`` tests (so
``men`` hits ``garment``); ``word`` matches whole tokens: the term's
letter/digit tokens must appear consecutively in the text's tokens. Women
terms are always tested before men terms (Q10). Each text is prepared once
(lower-cased, or tokenised) and every term test is then an ``instr``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values that must equal the reference's for right results. ----
# Keyword category table, in priority order (first match wins).
CATEGORY_KEYWORDS = [
    ("footwear", ["sneaker", "sneakers", "footwear", "mule", "radiant", "suede", "camo", "braided",
                  "iconic sneaker"]),
    ("accessories", ["beanie", "beanies", "cap", "caps", "belt", "belts", "bag", "bags", "duffle", "scarf",
                     "scarves", "wallet", "wallets", "jewelry", "bandana", "bandanas", "socks", "underwear",
                     "patch", "ff merch"]),
    ("hoodies", ["hoodie", "hoodies", "zipper hoodie", "raw hoodie"]),
    ("knitwear", ["knit", "knitwear", "sweater", "pullover", "cardigan"]),
    ("crewnecks", ["crewneck", "crewnecks"]),
    ("longsleeves", ["longsleeve", "long sleeve", "longsleeves", "long sleeves"]),
    ("t-shirts", ["t-shirt", "t shirt", "tee "]),
    ("polos", ["polo", "polos"]),
    ("shirts", ["shirt", "shirts", "blouse"]),
    ("pants", ["pants", "trousers", "sweatpants", "joggers", "chinos"]),
    ("shorts", ["shorts", "short pants"]),
    ("outerwear", ["jacket", "jackets", "bomber", "coat", "puffer", "windbreaker", "outerwear", "vest"]),
    ("dresses", ["dress", "dresses", "skirt", "skirts"]),
    ("swimwear", ["swimwear", "swim wear", "bikini", "trunks"]),
    ("tank tops", ["tank top", "tank tops", "tank "]),
    ("basics", ["basic", "basics"]),
]
# Coarse category terms, tested in this order at each text source.
COARSE_TERMS = [
    ("accessory", ["accessory", "accessories", "bag", "bags", "jewelry", "hat", "cap", "scarf", "belt", "wallet"]),
    ("footwear", ["shoe", "shoes", "boot", "boots", "sneaker", "sneakers", "footwear", "sandal", "sandals"]),
    ("clothing", ["jacket", "coat", "shirt", "top", "dress", "skirt", "pants", "trousers", "jeans", "short",
                  "sweater"]),
]
# Coarse category from a listing page URL path.
COARSE_PATHS = [
    ("accessory", ["/accessories", "/bags", "/jewelry", "/hats", "/scarves", "/belts", "/wallets"]),
    ("footwear", ["/shoes", "/boots", "/sneakers", "/footwear", "/sandals"]),
    ("clothing", ["/clothing", "/tops", "/bottoms", "/dresses", "/jackets"]),
]
WOMEN_TERMS = ["women", "woman", "female"]
MEN_TERMS = ["men", "man", "male"]
TITLE_WOMEN = ["women", "woman"]          # page <title> and product-page gender element
TITLE_MEN = ["men", "man"]
META_WOMEN = ["(woman)", "(female)", "woman wearing"]
META_MEN = ["(man)", "(male)", "man wearing"]
DESC_WOMEN = ["women's", "woman's", "female"]
DESC_MEN = ["men's", "man's", "male"]
TYPE_WOMEN = ["woman", "donna", "dam", "women", "lady", "female", "she"]
TYPE_MEN = ["man", "herr", "men", "uomo", "male", "he"]
TYPE_DROP = ["man", "woman", "standard"]
URL_WOMEN = ["/woman", "/women"]
URL_MEN = ["/man", "/men"]
UNISEX = "unisex"
# ---- end of fixed values ----

_SPLIT = r"[^\p{L}\p{N}]+"


def word_form(text: Column) -> Column:
    """Lower-cased text as its letter/digit tokens joined by single blanks,
    with a blank at each end (the string form of ``word`` mode)."""
    toks = F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def word_key(term: str) -> str:
    """A term as blank-joined tokens: ``'t-shirt'`` -> ``'t shirt'``."""
    import regex
    return " ".join(t for t in regex.split(_SPLIT, term.lower()) if t)


def _vocab_grams(text: Column, vocab: list[str]) -> Column:
    """The distinct vocabulary terms present as consecutive tokens: one pass
    over the text's uni/bi-grams with a hash-set membership test."""
    keys = sorted({word_key(t) for t in vocab})
    width = max(len(k.split(" ")) for k in keys)
    toks = F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")
    grams = toks
    for k in range(2, width + 1):
        parts = [F.slice(toks, i, 1 << 30) for i in range(1, k + 1)]
        kg = F.transform(F.arrays_zip(*parts), lambda z: F.concat_ws(" ", *[z[str(i)] for i in range(k)]))
        grams = F.concat(grams, kg)
    return F.array_distinct(F.filter(grams, lambda g: g.isin(keys)))


def _minimal(terms: list[str]) -> list[str]:
    """Drop terms that contain another term of the same list: for an OR of
    substring tests they can never decide the result."""
    out = []
    for t in terms:
        if not any(o != t and o in t for o in terms):
            out.append(t)
    return out


def prepare(text: Column, mode: str, vocab: list[str] | None = None) -> Column:
    """The form ``hits`` expects: the lower-cased text (substring mode), or
    the vocabulary terms found as whole tokens (word mode)."""
    if mode == "substring":
        return F.lower(text)
    return _vocab_grams(text, vocab or [])


def hits(prepared: Column, terms: list[str], mode: str) -> Column:
    """Any term in an already prepared text (null -> False)."""
    if mode == "substring":
        hit = F.lit(False)
        for term in _minimal(terms):
            hit = hit | prepared.contains(term)
        return F.coalesce(hit, F.lit(False))
    keys = sorted({word_key(t) for t in terms})
    return F.coalesce(F.arrays_overlap(prepared, F.array(*[F.lit(k) for k in keys])), F.lit(False))


def has_any(text: Column, terms: list[str], mode: str = "word") -> Column:
    """True when ``text`` holds any term (null text -> False)."""
    return hits(prepare(text, mode, terms), terms, mode)


def vocabulary(*groups) -> list[str]:
    """All terms of the given term lists / (name, terms) tables."""
    out = []
    for g in groups:
        for item in g:
            out.extend(item[1] if isinstance(item, tuple) else [item])
    return out


def keyword_category(title: Column, description: Column | None = None, mode: str = "substring",
                     prepared: Column | None = None) -> Column:
    """First category whose keyword occurs in ``title + ' ' + description``.
    ``prepared`` may carry ``prepare(text, mode)`` computed once upstream."""
    parts = [F.nullif(title, F.lit(""))]
    if description is not None:
        parts.append(F.nullif(description, F.lit("")))
    text = F.concat_ws(" ", *parts)
    p = prepared if prepared is not None else prepare(text, mode, vocabulary(CATEGORY_KEYWORDS))
    out = None
    for cat, kws in CATEGORY_KEYWORDS:
        cond = hits(p, kws, mode)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return F.when(F.trim(text) != "", out)


def coarse_category(text: Column, mode: str = "substring", prepared: Column | None = None) -> Column:
    """E15 on one text source: accessory, footwear or clothing, else null."""
    p = prepared if prepared is not None else prepare(text, mode, vocabulary(COARSE_TERMS))
    out = None
    for cat, terms in COARSE_TERMS:
        cond = hits(p, terms, mode)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out


def coarse_category_from_path(page_url: Column) -> Column:
    u = F.lower(page_url)
    out = None
    for cat, paths in COARSE_PATHS:
        cond = has_any(u, paths, "substring")
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out


def gender_generic(text: Column, mode: str = "substring", prepared: Column | None = None) -> Column:
    """URL / breadcrumb / title / selector test: women terms, then men terms."""
    p = prepared if prepared is not None else prepare(text, mode, WOMEN_TERMS + MEN_TERMS)
    return (F.when(hits(p, WOMEN_TERMS, mode), F.lit("women"))
            .when(hits(p, MEN_TERMS, mode), F.lit("men")))


def gender_title(text: Column, mode: str = "substring", prepared: Column | None = None) -> Column:
    """Page-title test: women / woman, then men / man (no female / male)."""
    p = prepared if prepared is not None else prepare(text, mode, TITLE_WOMEN + TITLE_MEN)
    return (F.when(hits(p, TITLE_WOMEN, mode), F.lit("women"))
            .when(hits(p, TITLE_MEN, mode), F.lit("men")))


def gender_meta(text: Column, mode: str = "substring") -> Column:
    """Meta-description test: ``(woman)``, ``woman wearing`` ... then the men forms."""
    m = "substring"  # the terms carry their own delimiters
    return (F.when(has_any(text, META_WOMEN, m), F.lit("women"))
            .when(has_any(text, META_MEN, m), F.lit("men")))


def gender_description(text: Column, mode: str = "substring", prepared: Column | None = None) -> Column:
    """Description test: ``unisex`` -> null, then women's / men's forms."""
    p = prepared if prepared is not None else prepare(text, mode, [UNISEX] + DESC_WOMEN + DESC_MEN)
    return (F.when(hits(p, [UNISEX], mode), F.lit(None).cast("string"))
            .when(hits(p, DESC_WOMEN, mode), F.lit("women"))
            .when(hits(p, DESC_MEN, mode), F.lit("men")))


def gender_from_type(product_type: Column, url: Column, mode: str = "substring",
                     prepared: Column | None = None) -> Column:
    """Product type vocabulary, then URL path; emits men/women."""
    u = F.lower(url)
    p = prepared if prepared is not None else prepare(product_type, mode, TYPE_WOMEN + TYPE_MEN)
    return (F.when(hits(p, TYPE_WOMEN, mode), F.lit("women"))
            .when(hits(p, TYPE_MEN, mode), F.lit("men"))
            .when(has_any(u, URL_WOMEN, "substring"), F.lit("women"))
            .when(has_any(u, URL_MEN, "substring"), F.lit("men")))


def category_from_type(product_type: Column) -> Column:
    """Drop the tokens man / woman / standard; the type itself if nothing is left."""
    toks = F.filter(F.split(F.trim(product_type), r"\s+"),
                    lambda t: (t != "") & ~F.lower(t).isin(*TYPE_DROP))
    return F.when(F.size(toks) > 0, F.array_join(toks, " ")).otherwise(product_type)
