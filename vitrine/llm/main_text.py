"""Operator 2: main text of web pages from flat text blocks.

A page is cut into flat blocks: the text between two block-level tags. A block
is described by its number of words and link density, those of its two
neighbours, and by what it stands in. A decision tree, trained (Gini, depth
bounded) on the small labelled table below, says which blocks are main text.

Text outside every block rule (scripts, styles, comments, markup) never becomes
a block. Pages are independent: no shuffle, and memory is bounded by one page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices

# HTML's element classes, as far as they matter here.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "canvas", "math"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main",
         "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "col", "base", "area", "embed", "source", "track", "param"}
CLOSED_BY_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                  "th": {"td", "th"}}
WHOLE = {"body", "html", "article", "main"}
ASIDE = {"nav", "aside", "footer", "form", "dialog", "fieldset"}
# A class, id or role names an aside if the whole token does (every part is a
# name or a neutral word), or if a name that is clear by itself stands at either end
# of it (reader-comments, sidebar-left); has-sidebar and entry-header do not.
_NAME = (r"(?:ads?|advert\w*|sponsor\w*|promo\w*|side-?bar|widgets?|menus?|nav\w*|breadcrumbs?|footer|masthead|header|cookies?"
         r"|consent|gdpr|banner|notices?|alert|pop-?up|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related"
         r"|recommend\w*|comments?|discussion|repl(?:y|ies)|disqus|search|pagination|pager|toolbar|skip|comment[-_]\w+)")
_NEUTRAL = r"(?:site|main|top|bottom|primary|secondary|bar|box|area|block|buttons?|container|wrapper|form|items?|links?|lists?|posts|section)"
_CLEAR = (r"(?:ads?|advert\w*|sponsor\w*|promo\w*|side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|gdpr|pop-?up"
          r"|modal|newsletter|subscribe|related|recommend\w*|comments?|pagination|social|sharing|disqus)")
HINTS = re.compile(rf"(?:{_NEUTRAL}[_-]+)*{_NAME}(?:[_-]+(?:{_NAME}|{_NEUTRAL}))*"
                   rf"|(?!(?:has|no|not|with|without|is|hide)[_-]){_CLEAR}[_-]+[\w-]*|(?!(?:has|no|not|with|without|is|hide)[_-])[\w-]*[_-]{_CLEAR}", re.I)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?)""")
_HINTED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool     # in a menu, footer, form, or something so named
    article: bool   # in article or main
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _is_aside(tag: str, in_article: bool) -> bool:
    """By its tag; a header inside an article is the article's own."""
    return tag in ASIDE or tag == "header" and not in_article


def _is_hidden(attributes: str) -> bool:
    """By the attribute ``hidden``, by ``aria-hidden="true"``, or by its style; not
    by words in the values of other attributes."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, *values in _ATTRIBUTE.findall(low):
        value = "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


def _is_hinted(tag: str, attributes: str, in_article: bool) -> bool:
    """By its names, or because it is hidden."""
    if len(attributes) < 4 or tag in WHOLE:
        return False
    return _is_hidden(attributes) or any(HINTS.fullmatch(token) and not (in_article and token.lower().endswith("header"))
               for found in _HINTED.findall(attributes) for token in "".join(found).split())


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page in order; those without a word are left out.

    A named or hidden element makes its blocks asides unless it is a wrapper: one that
    stands outside article and main and holds most of the words in them, or most
    of all words on a page without either.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # tag, aside, article, named element
    named: list[tuple[int, bool]] = [(0, False)]  # next named element above, stands in an article; the first is none
    within: list[int] = []  # named element of each block
    pieces: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag, aside, article, name = stack[-1]
                within.append(name)
                out.append(Block(text, text.count(" ") + 1, len(" ".join(linked).split()), aside, article,
                                 len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()))
            pieces.clear()
        linked.clear()

    def add(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked.append(text)

    at, end = 0, len(page)
    while at < end:
        tag_at = page.find("<", at)
        if tag_at < 0:
            add(page[at:])
            break
        if tag_at > at:
            add(page[at:tag_at])
        if page.startswith("<!--", tag_at):
            close = page.find("-->", tag_at + 4)
            at = end if close < 0 else close + 3
            continue
        m = _TAG.match(page, tag_at)
        if m is None:
            if page.startswith(("<!", "<?", "</"), tag_at):  # doctype, instruction, stray end: no text
                close = page.find(">", tag_at)
                at = end if close < 0 else close + 1
            else:
                add("<")
                at = tag_at + 1
            continue
        at = m.end()
        ends, tag, attributes = m.group(1) == "/", m.group(2).lower(), m.group(3)
        if tag == "a":
            links = max(0, links - 1) if ends else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in RAW and not ends:
            if not attributes.endswith("/>"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end if close is None else close.end()
        elif tag in BLOCK:
            flush()
            links = 0
            if tag in VOID:
                continue
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY_SAME.get(tag, ()):
                    stack.pop()
                _, aside, article, name = stack[-1]
                if _is_hinted(tag, attributes, article):
                    named.append((name, article))
                    name = len(named) - 1
                stack.append((tag, aside or _is_aside(tag, article), article or tag in ("article", "main"), name))
    flush()
    if len(named) > 1:
        any_article = any(b.article for b in out)
        held = [0] * len(named)
        for b, name in zip(out, within, strict=True):
            held[name] += b.words if b.article or not any_article else 0
        total = sum(held)
        for name in range(len(named) - 1, 0, -1):  # inner elements come after outer ones
            held[named[name][0]] += held[name]
        marks = [False] * len(named)
        for name in range(1, len(named)):
            above, in_article = named[name]
            marks[name] = marks[above] or in_article or 2 * held[name] <= total
        for b, name in zip(out, within, strict=True):
            b.aside = b.aside or marks[name]
    return out


FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "aside", "article", "heading"]


def features(found: list[Block]) -> list[list[float]]:
    """One row of FEATURES for each block; a missing neighbour has no words."""
    nothing = Block("", 0, 0, False, False, False)
    out = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else nothing, found[i + 1] if i + 1 < len(found) else nothing
        out.append([b.words, b.density, before.words, before.density, after.words, after.density, b.aside, b.article, b.heading])
    return out


# The labelled table: FEATURES, then 1 for main text. Fixed values, labelled by
# hand from pages of the usual kinds (news, blog, shop, forum; with and without
# an article element).
LABELLED = [
    # menus, link lists, breadcrumbs
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 2, 1.0, 6, 0.0, 1, 0, 0, 0),
    (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (4, 0.75, 1, 1.0, 9, 0.0, 0, 0, 0, 0), (12, 1.0, 3, 1.0, 30, 0.0, 0, 0, 0, 0),
    (9, 0.9, 4, 1.0, 4, 1.0, 0, 0, 0, 0), (8, 1.0, 80, 0.0, 7, 1.0, 0, 1, 0, 0), (7, 1.0, 8, 1.0, 9, 1.0, 0, 1, 0, 0),
    # adverts, notices, page headers, forms, sidebars
    (8, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 0), (25, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (60, 0.1, 3, 0.0, 70, 0.0, 1, 0, 0, 0),
    (14, 0.0, 90, 0.0, 50, 0.0, 1, 1, 0, 0), (35, 0.0, 120, 0.0, 0, 0.0, 1, 1, 0, 0), (5, 0.0, 0, 0.0, 4, 1.0, 1, 0, 1, 0),
    (3, 0.0, 40, 0.0, 6, 1.0, 1, 0, 1, 0), (6, 0.0, 30, 0.0, 45, 0.0, 1, 1, 1, 0), (110, 0.0, 60, 0.0, 80, 0.0, 1, 0, 0, 0),
    # footers
    (6, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (9, 0.0, 45, 0.0, 0, 0.0, 1, 0, 0, 0), (5, 0.0, 8, 1.0, 0, 0.0, 0, 0, 0, 0),
    (7, 0.3, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0),
    (2, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 45, 0.0, 0, 0.0, 0, 0, 0, 0), (7, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0),
    # reader comments
    (40, 0.0, 3, 0.3, 4, 0.5, 1, 0, 0, 0), (22, 0.0, 2, 0.5, 35, 0.0, 1, 0, 0, 0), (75, 0.05, 4, 0.5, 3, 0.3, 1, 1, 0, 0),
    # paragraphs of an article element, long and short
    (70, 0.0, 10, 0.0, 55, 0.0, 0, 1, 0, 1), (120, 0.02, 70, 0.0, 60, 0.0, 0, 1, 0, 1), (30, 0.1, 60, 0.0, 45, 0.0, 0, 1, 0, 1),
    (6, 0.0, 80, 0.0, 90, 0.0, 0, 1, 0, 1), (1, 0.0, 50, 0.0, 40, 0.0, 0, 1, 0, 1), (2, 0.0, 60, 0.0, 6, 0.0, 0, 1, 0, 1),
    (3, 0.0, 4, 0.0, 0, 0.0, 0, 1, 0, 1), (15, 0.3, 40, 0.0, 70, 0.0, 0, 1, 0, 1), (5, 0.4, 45, 0.0, 60, 0.0, 0, 1, 0, 1),
    (4, 0.0, 8, 0.0, 9, 0.0, 0, 1, 0, 1), (40, 0.0, 12, 0.0, 7, 0.0, 0, 1, 0, 1), (9, 0.0, 1, 1.0, 3, 0.0, 0, 1, 0, 1),
    # its headings
    (9, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1, 1), (1, 0.0, 5, 1.0, 7, 0.0, 0, 1, 1, 1), (6, 0.0, 90, 0.0, 30, 0.0, 0, 1, 1, 1),
    (12, 0.0, 1, 1.0, 2, 0.0, 0, 1, 1, 1),
    # in wrappers with names such as has-sidebar, or a header of the article's own
    (8, 0.0, 0, 0.0, 4, 0.0, 0, 1, 1, 1), (4, 0.0, 8, 0.0, 60, 0.0, 0, 1, 0, 1), (65, 0.0, 4, 0.0, 50, 0.0, 0, 1, 0, 1),
    (8, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1, 1), (60, 0.0, 8, 0.0, 55, 0.0, 0, 0, 0, 1),
    # paragraphs and headings where the page has no article element
    (60, 0.0, 8, 0.0, 45, 0.0, 0, 0, 0, 1), (45, 0.05, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (110, 0.0, 9, 0.0, 30, 0.0, 0, 0, 0, 1),
    (20, 0.1, 50, 0.0, 60, 0.0, 0, 0, 0, 1), (14, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1), (35, 0.0, 55, 0.0, 6, 0.5, 0, 0, 0, 1),
    (60, 0.0, 60, 0.0, 2, 0.0, 0, 0, 0, 1), (50, 0.05, 70, 0.0, 5, 0.5, 0, 0, 0, 1), (40, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1),
    (4, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1), (6, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 1), (3, 0.0, 70, 0.0, 55, 0.0, 0, 0, 1, 1),
    (9, 0.0, 4, 1.0, 60, 0.0, 0, 0, 1, 1), (7, 0.0, 50, 0.0, 45, 0.0, 0, 0, 1, 1),
]

MAX_DEPTH = 6


def train_tree(rows: list[tuple] = LABELLED, depth: int = MAX_DEPTH):
    """A leaf is a bool, an inner node (feature, threshold, low, high): low
    where the feature is at most the threshold. Ties go to the first split."""
    positives = sum(r[-1] for r in rows)
    if positives in (0, len(rows)) or depth == 0:
        return 2 * positives > len(rows)

    def gini(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * 2 * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            low = [r for r in rows if r[f] <= (a + b) / 2]
            high = [r for r in rows if r[f] > (a + b) / 2]
            score = gini(low) + gini(high)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, (a + b) / 2, low, high)
    if best is None:
        return 2 * positives > len(rows)
    _, f, threshold, low, high = best
    return f, threshold, train_tree(low, depth - 1), train_tree(high, depth - 1)


def is_main(tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        f, threshold, low, high = tree
        tree = low if row[f] <= threshold else high
    return tree


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """(text, blocks, blocks kept)."""
    found = blocks(page)
    kept = [b.text for b, row in zip(found, features(found), strict=True) if is_main(tree, row)]
    return "\n".join(kept), len(found), len(kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars, n_blocks, n_kept``.

    Null or empty html gives an empty text; a page without main text, too. Null
    ids and urls pass through, repeated rows get equal results, an empty table
    gives an empty one.
    """
    tree = train_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [main_text(x, tree) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([t for t, _, _ in got], pa.string()),
                 pa.array([len(t) for t, _, _ in got], pa.int64()), pa.array([n for _, n, _ in got], pa.int64()),
                 pa.array([k for _, _, k in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                     F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
