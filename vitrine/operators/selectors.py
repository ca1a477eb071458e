"""The selector subset the site specs use, turned into Column predicates over
``elements`` rows: tag, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``,
``[attr*=v]``, ``[attr^=v]``, ``[attr$=v]``, ``:not(...)``, descendant
combinator and comma lists. Ancestor steps test the ``ancestors`` array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""
    (?P<tag>^[a-zA-Z][a-zA-Z0-9-]*|^\*)
  | \#(?P<id>[\w-]+)
  | \.(?P<cls>[\w-]+)
  | \[(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$]?=)\s*(?P<q>['"]?)(?P<val>.*?)(?P=q))?\s*\]
  | :not\((?P<neg>[^)]*)\)
""", re.X)


def _split_top(s: str, sep: str) -> list[str]:
    """Split on ``sep`` outside brackets, parentheses and quotes."""
    out, buf, depth, quote = [], [], 0, None
    for ch in s:
        if quote:
            quote = None if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "[(":
            depth += 1
        elif ch in "])":
            depth -= 1
        elif depth == 0 and (ch == sep or (sep == " " and ch.isspace())):
            out.append("".join(buf))
            buf = []
            continue
        buf.append(ch)
    out.append("".join(buf))
    return [x.strip() for x in out if x.strip()]


def _compound(sel: str, tag: Column, eid: Column, classes: Column, attrs: Column | None) -> Column:
    pos, pred = 0, F.lit(True)
    class_text = F.array_join(classes, " ")
    while pos < len(sel):
        m = _TOKEN.match(sel, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported selector: {sel!r}")
        pos = m.end()
        if m.group("tag"):
            if m.group("tag") != "*":
                pred = pred & (tag == m.group("tag").lower())
        elif m.group("id"):
            pred = pred & F.coalesce(eid == m.group("id"), F.lit(False))
        elif m.group("cls"):
            pred = pred & F.coalesce(F.array_contains(classes, m.group("cls")), F.lit(False))
        elif m.group("attr"):
            name, op, val = m.group("attr").lower(), m.group("op"), m.group("val")
            if attrs is None:
                if name != "class":
                    raise ValueError(f"ancestor step supports only class attributes: {sel!r}")
                v = class_text
                present = F.size(classes) > 0
            else:
                v = attrs[name]
                present = v.isNotNull()
            if op is None:
                cond = present
            elif op == "=":
                cond = v == val
            elif op == "*=":
                cond = v.contains(val)
            elif op == "^=":
                cond = v.startswith(val)
            else:
                cond = v.endswith(val)
            pred = pred & F.coalesce(cond, F.lit(False))
        else:
            pred = pred & ~_compound(m.group("neg").strip(), tag, eid, classes, attrs)
    return pred


def _ancestor_test(sel: str):
    def test(a):
        return _compound(sel, a["tag"], a["elem_id"], a["classes"], None)
    return test


_CACHE: dict = {}


def context_key() -> tuple:
    """Identity of the running SparkContext for Column memo caches (Columns
    hold references into that context's JVM)."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    return (sc.applicationId, sc.startTime) if sc is not None else (None, None)


def _ancestor_pos(sel: str):
    def pos(a, i):
        return F.when(_compound(sel, a["tag"], a["elem_id"], a["classes"], None), i)
    return pos


def _after(prev: Column):
    def test(i):
        return i > prev
    return test


def matches(selector: str) -> Column:
    """Predicate: the element matches any member of the comma list.

    Built Columns are memoised per SparkContext: a selector is compiled once
    and reused by every plan (each Column call is a round trip to the JVM)."""
    key = (context_key(), selector)
    hit = _CACHE.get(key)
    if hit is None:
        hit = _CACHE[key] = _matches(selector)
    return hit


def _matches(selector: str) -> Column:
    out = F.lit(False)
    for member in _split_top(selector, ","):
        steps = _split_top(member, " ")
        last = steps[-1]
        pred = _compound(last, F.col("tag"), F.col("elem_id"), F.col("classes"), F.col("attrs"))
        if len(steps) == 2:
            pred = pred & F.exists(F.col("ancestors"), _ancestor_test(steps[0]))
        elif len(steps) > 2:
            # the ancestor steps must match ancestors in top-down order: take
            # the highest match of each step below the previous step's match
            pos = F.lit(-1)
            for anc_sel in steps[:-1]:
                hits = F.filter(F.transform(F.col("ancestors"), _ancestor_pos(anc_sel)),
                                lambda i: i.isNotNull())
                pos = F.array_min(F.filter(hits, _after(pos)))
            pred = pred & pos.isNotNull()
        out = out | pred
    return out


# Text kinds a rule may ask for; resolved from the page's text nodes.
TEXT = "text"          # stripped text nodes joined without blanks (get_text(strip=True))
TEXT_SP = "text_sp"    # stripped text nodes joined with a blank
RAW = "raw_text"       # text nodes as they are (get_text())
_TEXT_KINDS = {TEXT: "", TEXT_SP: " ", RAW: None}
_RAW_TAGS = ["script", "style"]


def text_of(nodes: Column, ref: Column, kind: str) -> Column:
    """Text of an element from the page's ``nodes`` and the element's
    ``ref = struct(t0, t1, own_raw)``; nodes inside script/style count only
    for a script/style element itself."""
    part = F.filter(F.slice(nodes, ref["t0"] + 1, ref["t1"] - ref["t0"]), lambda n: ref["own_raw"] | ~n["skip"])
    sep = _TEXT_KINDS[kind]
    if sep is None:
        return F.array_join(F.transform(part, lambda n: n["raw"]), "")
    return F.array_join(F.filter(F.transform(part, lambda n: n["strip"]), lambda t: t != ""), sep)


def _text_ref() -> Column:
    return F.struct(F.col("t0").alias("t0"), F.col("t1").alias("t1"),
                    F.col("tag").isin(*_RAW_TAGS).alias("own_raw"))


def _resolver(kind: str):
    def resolve(ref):
        return text_of(F.col("_nodes"), ref, kind)
    return resolve


def page_nodes(els):
    """``(page_id, _nodes)``: each page's single copy of its text nodes."""
    return els.where(F.col("nodes").isNotNull()).select("page_id", F.col("nodes").alias("_nodes"))


_RULES_CACHE: dict = {}


def apply_rules(els, keys: list[str], rules: list[tuple], nodes_from=None, cache_key=None, with_nodes=False):
    """Evaluate every rule once per element, then aggregate per ``keys``.

    ``rules``: ``(name, predicate, value, kind)`` with kind ``first`` (value of
    the first matching element in document order) or ``all`` (values of every
    match, in order). ``value`` is a Column, or one of the text kinds
    ``TEXT`` / ``TEXT_SP`` / ``RAW``: those are carried as node ranges and
    resolved after the aggregate from the page's single copy of its text.
    Each rule is projected as ``when(pred, struct(idx, value))`` so predicates
    run once in generated code; elements no rule hits are dropped (except the
    row carrying the page's nodes), and the aggregate keeps only minima/lists.

    When ``keys`` are finer than the page (e.g. one listing card), pass the
    page's element rows as ``nodes_from``: the nodes are then joined back by
    ``page_id`` (one row per page) before the text is resolved.

    ``cache_key``: rules built once per spec can pass a key so the projected,
    aggregate and resolving Columns are also built only once. ``with_nodes``
    keeps the page's text nodes as ``_nodes`` in the result.
    """
    ck = None
    if cache_key is not None:
        ck = (context_key(), cache_key, tuple(keys), nodes_from is None)
    parts = _RULES_CACHE.get(ck) if ck is not None else None
    if parts is None:
        parts = _rule_columns(rules, nodes_from is None)
        if ck is not None:
            _RULES_CACHE[ck] = parts
    cols, hit, aggs, out, texty, inline = parts
    if with_nodes and not inline:
        hit = hit | F.col("nodes").isNotNull()
        aggs = aggs + [F.first("nodes", ignorenulls=True).alias("_nodes")]
        inline = True
    proj = els.select(*keys, *cols, *(["nodes"] if inline else []))
    g = proj.where(hit).groupBy(*keys).agg(*aggs)
    if not texty:
        return g
    if not inline:
        g = g.join(page_nodes(nodes_from), "page_id", "left")
    return g.select(*keys, *out, *(["_nodes"] if with_nodes else []))


def _rule_columns(rules: list[tuple], nodes_inline: bool):
    def val(v):
        return _text_ref() if isinstance(v, str) else v

    cols = [F.when(pred, F.struct(F.col("idx").alias("i"), val(value).alias("v"))).alias(name)
            for name, pred, value, _ in rules]
    texty = any(isinstance(v, str) for _, _, v, _ in rules)
    inline = texty and nodes_inline
    hit = F.col("nodes").isNotNull() if inline else F.lit(False)
    for name, *_ in rules:
        hit = hit | F.col(name).isNotNull()
    aggs = []
    for name, _, _, kind in rules:
        if kind == "first":
            aggs.append(F.min(name)["v"].alias(name))
        else:
            aggs.append(F.transform(F.array_sort(F.collect_list(name)), lambda s: s["v"]).alias(name))
    if inline:
        aggs.append(F.first("nodes", ignorenulls=True).alias("_nodes"))
    out = []
    for name, _, value, kind in rules:
        if not isinstance(value, str):
            out.append(F.col(name))
        elif kind == "first":
            out.append(F.when(F.col(name).isNotNull(), text_of(F.col("_nodes"), F.col(name), value)).alias(name))
        else:
            out.append(F.transform(F.col(name), _resolver(value)).alias(name))
    return cols, hit, aggs, out, texty, inline


def _in_group(grp: Column):
    def test(h):
        return h["g"] == grp
    return test


def _hit_value(h):
    return h["v"]


def aggregate_grouped_rules(els, keys: list[str], group: Column, rules: list[tuple], group_name: str = "grp",
                            page_rules: list[tuple] = ()):
    """One aggregate per page for rules on groups below the page (e.g.
    listing cards). Returns one row per page with ``_groups`` (array of one
    struct per group: the group key and its rule values), the page-level
    ``page_rules`` values and the page's text nodes ``_nodes``.

    Every rule collects its hits tagged with the element's group (``group``,
    null = no group); each group then takes its first / all hits from those
    small per-page arrays. Text kinds are resolved from the page's single copy
    of its text; no join and no second pass over the elements."""
    def val(v):
        return _text_ref() if isinstance(v, str) else v

    cols = [F.when(pred & group.isNotNull(),
                   F.struct(group.alias("g"), F.col("idx").alias("i"), val(value).alias("v"))).alias(name)
            for name, pred, value, _ in rules]
    pcols = [F.when(pred, F.struct(F.col("idx").alias("i"), val(value).alias("v"))).alias(name)
             for name, pred, value, _ in page_rules]
    proj = els.select(*keys, *cols, *pcols, "nodes")
    hit = F.col("nodes").isNotNull()
    for name, *_ in list(rules) + list(page_rules):
        hit = hit | F.col(name).isNotNull()
    aggs = [F.collect_list(name).alias(name) for name, *_ in rules]
    for name, _, _, kind in page_rules:
        aggs.append(F.min(name)["v"].alias(name) if kind == "first"
                    else F.transform(F.array_sort(F.collect_list(name)), _hit_value).alias(name))
    aggs.append(F.first("nodes", ignorenulls=True).alias("_nodes"))
    g = proj.where(hit).groupBy(*keys).agg(*aggs)

    page_out = []
    for name, _, value, kind in page_rules:
        if not isinstance(value, str):
            page_out.append(F.col(name))
        elif kind == "first":
            page_out.append(F.when(F.col(name).isNotNull(), text_of(F.col("_nodes"), F.col(name), value)).alias(name))
        else:
            page_out.append(F.transform(F.col(name), _resolver(value)).alias(name))
    groups = F.array_sort(F.array_distinct(F.flatten(F.array(
        *[F.transform(F.col(name), lambda h: h["g"]) for name, *_ in rules]))))

    def one(grp):
        fields = [grp.alias(group_name)]
        for name, _, value, kind in rules:
            mine = F.array_sort(F.filter(F.col(name), _in_group(grp)))
            if kind == "first":
                ref = _at_first(mine)["v"]
                v = (F.when(ref.isNotNull(), text_of(F.col("_nodes"), ref, value))
                     if isinstance(value, str) else ref)
            else:
                vals = F.transform(mine, _hit_value)
                v = F.transform(vals, _resolver(value)) if isinstance(value, str) else vals
            fields.append(v.alias(name))
        return F.struct(*fields)

    return g.select(*keys, *page_out, F.transform(groups, one).alias("_groups"), "_nodes")


def explode_groups(agg, keys: list[str], page_names: list[str] = ()):
    """One row per group from ``aggregate_grouped_rules`` output."""
    return (agg.select(*keys, *page_names, F.explode("_groups").alias("_r"))
            .select(*keys, *page_names, "_r.*"))


def apply_grouped_rules(els, keys: list[str], group: Column, rules: list[tuple], group_name: str = "grp",
                        page_rules: list[tuple] = ()):
    """``aggregate_grouped_rules`` exploded to one row per group; page-level
    values are repeated on every group's row."""
    agg = aggregate_grouped_rules(els, keys, group, rules, group_name, page_rules)
    return explode_groups(agg, keys, [n for n, *_ in page_rules])


def _at_first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))
