"""The ``elements`` job: pages -> one row per HTML element.

The only per-row Python in page extraction: ``mapInArrow`` runs the standard
library HTML tokenizer over each page of an Arrow batch and emits element rows.
Everything after it (selectors, rule chains, choosing the first match) is
Column code. A page's elements are produced in the task that read the page, so
the per-page aggregation downstream combines map-side before any shuffle.

Text is shipped once per page: the page's text nodes (raw and stripped) ride
on the page's first element row (``nodes``); every element carries only the
range ``[t0, t1)`` of nodes inside it (and its parent's range), and rules
resolve the text of the elements they keep (``text_of``) after aggregating.
Script and style bodies are also kept on their own rows (``raw_text``) since
rules test them directly.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

ELEMENT_SCHEMA = (
    "page_id bigint, url string, idx int, parent_idx int, depth int, tag string, elem_id string, "
    "classes array<string>, attrs map<string,string>, t0 int, t1 int, p_t0 int, p_t1 int, raw_text string, "
    "ancestors array<struct<idx:int,tag:string,elem_id:string,classes:array<string>>>, "
    "nodes array<struct<raw:string,strip:string,skip:boolean>>"
)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
RAW = {"script", "style"}
# HTML's implied end tags (tree-building rules of the HTML standard), so that
# e.g. "<p>a<p>b" gives two sibling paragraphs as browsers and lxml build it.
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption",
            "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav",
            "ol", "p", "pre", "section", "table", "ul"}
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "option": ({"option"}, {"select", "datalist", "optgroup"}),
           "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SCOPE = {"table", "td", "th", "button", "html", "template", "caption", "marquee", "object", "applet"}


class _Collector(HTMLParser):
    """Records elements with the range of text nodes inside each one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elems = []       # [tag, id, classes, attrs, parent, depth, t0, t1, ancestors]
        self.stack = []       # indices of open elements
        self.line = []        # (index, tag, id, classes) of the same elements
        self.texts = []       # (text, inside_raw_element)

    def _open(self, tag, attrs):
        d = {}
        for k, v in attrs:
            if k not in d:
                d[k] = "" if v is None else v
        classes = d.get("class", "").split()
        anc = self.line[:]
        parent = self.stack[-1] if self.stack else -1
        self.elems.append([tag, d.get("id"), classes, d, parent, len(self.stack), len(self.texts), None, anc])
        return len(self.elems) - 1

    def _close_to(self, pos):
        while len(self.stack) > pos:
            self.elems[self.stack.pop()][7] = len(self.texts)
        del self.line[pos:]

    def _implied_end(self, tag):
        if tag in CLOSES_P:
            for pos in range(len(self.stack) - 1, -1, -1):
                t = self.elems[self.stack[pos]][0]
                if t == "p":
                    self._close_to(pos)
                    break
                if t in SCOPE:
                    break
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            for pos in range(len(self.stack) - 1, -1, -1):
                t = self.elems[self.stack[pos]][0]
                if t in closes:
                    self._close_to(pos)
                    break
                if t in stops or t in SCOPE:
                    break

    def handle_starttag(self, tag, attrs):
        self._implied_end(tag)
        i = self._open(tag, attrs)
        if tag in VOID:
            self.elems[i][7] = len(self.texts)
        else:
            self.stack.append(i)
            self.line.append((i, *self.elems[i][:3]))

    def handle_startendtag(self, tag, attrs):
        self._implied_end(tag)
        i = self._open(tag, attrs)
        self.elems[i][7] = len(self.texts)

    def handle_endtag(self, tag):
        for pos in range(len(self.stack) - 1, -1, -1):
            if self.elems[self.stack[pos]][0] == tag:
                self._close_to(pos)
                return

    def handle_data(self, data):
        inside_raw = bool(self.stack) and self.elems[self.stack[-1]][0] in RAW
        self.texts.append((data, inside_raw))

    def finish(self):
        self.close()
        while self.stack:
            self.elems[self.stack.pop()][7] = len(self.texts)


def parse_page(html: str):
    """``(elements, nodes)``: elements as ``(idx, parent, depth, tag, id,
    classes, attrs, t0, t1, p_t0, p_t1, raw_text, ancestors)``; nodes as
    ``(raw, stripped, inside_script_or_style)``."""
    c = _Collector()
    try:
        c.feed(html or "")
        c.finish()
    except Exception:  # noqa: BLE001 - a broken page yields what was parsed
        while c.stack:
            c.elems[c.stack.pop()][7] = len(c.texts)
    elems = []
    for idx, (tag, eid, classes, attrs, parent, depth, t0, t1, anc) in enumerate(c.elems):
        t1 = t0 if t1 is None else t1
        if parent >= 0:
            pt0, pt1 = c.elems[parent][6], c.elems[parent][7]
            pt1 = pt0 if pt1 is None else pt1
        else:
            pt0 = pt1 = None
        raw = "".join(t for t, _ in c.texts[t0:t1]) if tag in RAW else None
        elems.append((idx, parent, depth, tag, eid, classes, attrs, t0, t1, pt0, pt1, raw, anc))
    nodes = [(t, t.strip(), inside) for t, inside in c.texts]
    return elems, nodes


def element_text(nodes, t0: int, t1: int, tag: str, sep: str = "") -> str:
    """Python twin of ``text_of`` (used by tests): stripped nodes joined."""
    keep = [n for n in nodes[t0:t1] if tag in RAW or not n[2]]
    return sep.join(n[1] for n in keep if n[1])


def _element_batches(batches):
    rows = _Rows()
    for batch in batches:
        ids = batch.column("page_id").to_pylist()
        urls = batch.column("url").to_pylist()
        htmls = batch.column("html").to_pylist()
        for pid, url, html in zip(ids, urls, htmls):
            elems, nodes = parse_page(html)
            if not elems:
                # keep the page: a placeholder row (no selector matches it)
                # carries its text, so per-page results still have a row
                elems = [(0, -1, 0, "#document", None, [], {}, 0, len(nodes), None, None, None, [])]
            rows.add(pid, url, elems, nodes)
            if len(rows.elems) >= 8192:
                yield rows.batch()
                rows = _Rows()
        if rows.elems:
            yield rows.batch()
            rows = _Rows()


class _Rows:
    """Element rows on their way to one Arrow batch; nested columns are built
    from flat lists and offsets, no Python object per nested value."""

    def __init__(self):
        self.page_ids, self.urls, self.elems, self.nodes = [], [], [], []
        self.first = []       # row of each page's first element

    def add(self, page_id, url, elems, nodes):
        self.first.append(len(self.elems))
        self.page_ids += [page_id] * len(elems)
        self.urls += [url] * len(elems)
        self.elems += elems
        self.nodes.append(nodes)

    def batch(self):
        import pyarrow as pa

        schema = _arrow_schema()
        (idx, parent, depth, tag, eid, classes, attrs, t0, t1, pt0, pt1, raw, ancestors) = zip(*self.elems)
        anc = [a for own in ancestors for a in own]
        a_idx, a_tag, a_id, a_classes = zip(*anc) if anc else ((), (), (), ())
        anc_type = schema.field("ancestors").type.value_type
        anc_values = pa.StructArray.from_arrays(
            [pa.array(a_idx, pa.int32()), pa.array(a_tag, pa.string()), pa.array(a_id, pa.string()), _lists(a_classes)],
            fields=list(anc_type))
        node = [n for own in self.nodes for n in own]
        raws, strips, skips = zip(*node) if node else ((), (), ())
        node_type = schema.field("nodes").type.value_type
        node_values = pa.StructArray.from_arrays(
            [pa.array(raws, pa.string()), pa.array(strips, pa.string()), pa.array(skips, pa.bool_())], fields=list(node_type))
        # nodes ride on a page's first row, the others have none (null offsets)
        node_at = [None] * len(idx) + [len(node)]
        for row, at in zip(self.first, _offsets(self.nodes)):
            node_at[row] = at
        attr_keys = [k for own in attrs for k in own]
        attr_values = [v for own in attrs for v in own.values()]
        return pa.RecordBatch.from_arrays([
            pa.array(self.page_ids, pa.int64()), pa.array(self.urls, pa.string()),
            *(pa.array(c, pa.int32()) for c in (idx, parent, depth)), pa.array(tag, pa.string()), pa.array(eid, pa.string()),
            _lists(classes),
            pa.MapArray.from_arrays(pa.array(_offsets(attrs), pa.int32()), pa.array(attr_keys, pa.string()), pa.array(attr_values, pa.string())),
            *(pa.array(c, pa.int32()) for c in (t0, t1, pt0, pt1)), pa.array(raw, pa.string()),
            pa.ListArray.from_arrays(pa.array(_offsets(ancestors), pa.int32()), anc_values),
            pa.ListArray.from_arrays(pa.array(node_at, pa.int32()), node_values)], schema=schema)


def _offsets(lists) -> list[int]:
    out, total = [0], 0
    for own in lists:
        total += len(own)
        out.append(total)
    return out


def _lists(lists):
    """Arrow array of lists of strings."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(_offsets(lists), pa.int32()), pa.array([x for own in lists for x in own], pa.string()))


def _arrow_schema():
    import pyarrow as pa
    anc = pa.struct([("idx", pa.int32()), ("tag", pa.string()), ("elem_id", pa.string()),
                     ("classes", pa.list_(pa.string()))])
    node = pa.struct([("raw", pa.string()), ("strip", pa.string()), ("skip", pa.bool_())])
    return pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("idx", pa.int32()), ("parent_idx", pa.int32()),
        ("depth", pa.int32()), ("tag", pa.string()), ("elem_id", pa.string()),
        ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        ("t0", pa.int32()), ("t1", pa.int32()), ("p_t0", pa.int32()), ("p_t1", pa.int32()),
        ("raw_text", pa.string()), ("ancestors", pa.list_(anc)), ("nodes", pa.list_(node)),
    ])


def elements(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> element rows (see ``ELEMENT_SCHEMA``)."""
    return pages.select("page_id", "url", "html").mapInArrow(_element_batches, ELEMENT_SCHEMA)


def elements_once(pages: DataFrame) -> DataFrame:
    """Element rows for plans that read them more than once: persisted
    (memory, spilling to disk) so the Python step runs once per page."""
    from pyspark import StorageLevel

    return elements(pages).persist(StorageLevel.MEMORY_AND_DISK)
