"""The single Python stage. One ``mapInPandas`` pass turns raw HTML
into a narrow nested record (main-content rule and text, title candidates,
hrefs, code-block candidates); every later step is native Column work and
the ``html`` column never travels past this stage.

The tree is built with the standard-library ``html.parser`` tokenizer and
the usual lenient rules: void elements close at once, an end tag closes the
nearest open element of that name (none open: ignored), nothing is closed
implicitly. The builder and every walk are iterative, so deeply nested or
unclosed markup cannot exhaust the stack, and open elements are counted by
name, so neither text nor end tags search the open ones: parsing is linear.
Elements are listed as they open, which is document order; an element's
descendants are the next ones up to its ``end``. Trees have no upward links, so
they are freed page by page. Records leave the worker after every
``CHUNK_CHARS`` of HTML, whatever the size of an Arrow batch; ``materialised``
bounds the bytes of the batches that enter it.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import fixed
from pagewright.functions import text as T
from pagewright.session import BATCH_BYTES, checkpoint, ship_package, small_batches

VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source "
    "track wbr basefont bgsound command frame image isindex nextid spacer".split())
# text inside these elements is not visible text
HIDDEN = frozenset(["script", "style", "template"])
PRESERVE_WS = frozenset(["pre", "textarea"])
ASCII_WS = " \n\t\x0c\r"
CHUNK_CHARS = 1 << 20

# kinds of text node
TEXT, HIDDEN_TEXT = 0, 1

EXTRACT_SCHEMA = (
    "site string, page_id bigint, url string, error string, has_html boolean, "
    "lang_attr string, main_rule int, main_text string, "
    "title_candidates array<string>, hrefs array<string>, "
    "code array<struct<sel_ord:int,doc_ord:int,classes:array<string>,code:string>>"
)


class Node:
    __slots__ = ("name", "attrs", "children", "ord", "end", "classes", "in_pre")

    def __init__(self, name, attrs, parent, ord_):
        self.name = name
        self.attrs = attrs
        self.children = []
        self.ord = ord_
        self.end = None              # ``ord`` of the last descendant, once closed
        cls = attrs.get("class")
        self.classes = cls.split() if cls else []
        self.in_pre = parent is not None and (parent.in_pre or parent.name == "pre")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None, 0)
        self.stack = [self.root]
        self.elements = []           # in document order: ``ord`` is the place + 1
        self.open = {}               # open elements by name
        self.hidden = self.preserved = 0
        self.buf = []
        self.n = 0

    # text ------------------------------------------------------------
    def _flush(self):
        if not self.buf:
            return
        s = "".join(self.buf)
        self.buf = []
        if not self.preserved and not s.strip(ASCII_WS):
            s = "\n" if "\n" in s else " "
        self.stack[-1].children.append((HIDDEN_TEXT if self.hidden else TEXT, s))

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def updatepos(self, i, j):
        return j                     # nobody asks for line numbers

    # elements -------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._flush()
        d = {}
        for k, v in attrs:
            d[k] = "" if v is None else v
        self.n += 1
        node = Node(tag, d, self.stack[-1], self.n)
        self.stack[-1].children.append(node)
        self.elements.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1
            self.hidden += tag in HIDDEN
            self.preserved += tag in PRESERVE_WS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        while self.open.get(tag):
            node = self.stack.pop()
            node.end = self.n
            self.open[node.name] -= 1
            self.hidden -= node.name in HIDDEN
            self.preserved -= node.name in PRESERVE_WS
            if node.name == tag:
                break

    def finish(self):
        self.close()
        self._flush()
        for node in self.stack:
            node.end = self.n
        return self.elements


def parse_elements(html: str) -> list[Node]:
    """The elements of a page in document order."""
    b = _Builder()
    b.feed(html)
    return b.finish()


def iter_strings(node: Node):
    """Visible text nodes under ``node`` in document order (iterative)."""
    stack = [iter(node.children)]
    while stack:
        for ch in stack[-1]:
            if isinstance(ch, Node):
                stack.append(iter(ch.children))
                break
            if ch[0] == TEXT:
                yield ch[1]
        else:
            stack.pop()


def get_text(node: Node) -> str:
    return "".join(iter_strings(node))


def get_text_stripped(node: Node) -> str:
    """Each string stripped, empties dropped, joined by one space."""
    return " ".join(s for s in (x.strip() for x in iter_strings(node)) if s)


def _class_str(el: Node) -> str:
    return " ".join(el.classes)


def _class_any(el: Node, fn) -> bool:
    """A class test as applied per class token and then on the joined value."""
    if not el.classes:
        return False
    return any(fn(c) for c in el.classes) or fn(_class_str(el))


# Main-content cascade (B2): element name and test; rule numbers are 1-based
# and emitted.
def _main_rules():
    return [
        ("main", lambda e: True),
        ("article", lambda e: True),
        ("div", lambda e: _class_any(e, lambda c: c == "content")),
        ("div", lambda e: _class_any(e, lambda c: "docs" in c.lower() or "documentation" in c.lower())),
        ("div", lambda e: _class_any(e, lambda c: "main" in c.lower())),
        ("div", lambda e: _class_any(e, lambda c: "content" in c.lower())),
    ]


MAIN_RULES = _main_rules()


def _selector_preds():
    tok = lambda t: (lambda e: t in e.classes)
    sub = lambda t: (lambda e: t in _class_str(e))
    preds = {
        "pre code": lambda e: e.name == "code" and e.in_pre,
        ".highlight": tok("highlight"),
        ".prism-code": tok("prism-code"),
        ".hljs": tok("hljs"),
        '[class*="language-"]': sub("language-"),
        ".code-block": tok("code-block"),
        'div[class*="codeBlock"]': lambda e: e.name == "div" and "codeBlock" in _class_str(e),
        ".code": tok("code"),
        '[class*="code"]': sub("code"),
    }
    return [preds[s] for s in fixed.CODE_SELECTORS]


SELECTOR_PREDS = _selector_preds()


def extract_one(html):
    """Parse one page into the extraction record (without the key columns)."""
    if html is None or html == "":
        return dict(has_html=False, lang_attr=None, main_rule=None, main_text=None,
                    title_candidates=None, hrefs=None, code=None)
    elements = parse_elements(html)
    by_name = {}
    for e in elements:
        by_name.setdefault(e.name, []).append(e)

    html_el = by_name.get("html", [None])[0]
    lang_attr = html_el.attrs.get("lang") if html_el is not None else None

    main_rule, main_el = None, None
    for i, (name, rule) in enumerate(MAIN_RULES, start=1):
        main_el = next((e for e in by_name.get(name, ()) if rule(e)), None)
        if main_el is not None:
            main_rule = i
            break

    h1 = by_name.get("h1", [None])[0]
    title = by_name.get("title", [None])[0]
    cls_title = min((e for name in ("h1", "h2") for e in by_name.get(name, ())
                     if any("title" in c.lower() for c in e.classes)), key=lambda e: e.ord, default=None)
    meta = by_name.get("meta", ())
    og = next((e for e in meta if e.attrs.get("property") == "og:title"), None)
    mt = next((e for e in meta if e.attrs.get("name") == "title"), None)
    cands = [
        get_text(h1).strip() if h1 is not None else None,
        get_text(title).strip() if title is not None else None,
        get_text(cls_title).strip() if cls_title is not None else None,
        og.attrs.get("content", "").strip() if og is not None else None,
        mt.attrs.get("content", "").strip() if mt is not None else None,
    ]

    hrefs = [e.attrs["href"] for e in by_name.get("a", ()) if "href" in e.attrs]

    code = []
    main_text = None
    if main_el is not None:
        main_text = get_text_stripped(main_el)
        # no selector names an element without classes, but code in pre
        inside = [e for e in elements[main_el.ord:main_el.end or main_el.ord] if e.classes or (e.name == "code" and e.in_pre)]
        for s_ord, pred in enumerate(SELECTOR_PREDS, start=1):
            for e in inside:
                if pred(e):
                    code.append({"sel_ord": s_ord, "doc_ord": e.ord,
                                 "classes": list(e.classes), "code": get_text(e).strip()})
    return dict(has_html=True, lang_attr=lang_attr, main_rule=main_rule, main_text=main_text,
                title_candidates=cands, hrefs=hrefs, code=code)


RECORD = ["site", "page_id", "url", "error", "has_html", "lang_attr", "main_rule", "main_text", "title_candidates", "hrefs", "code"]


def _parse_batches(batches):
    for pdf in batches:
        out, chars = [], 0
        for site, pid, url, html in zip(pdf["site"], pdf["page_id"], pdf["url"], pdf["html"]):
            try:
                rec = extract_one(html)
                rec["error"] = None
            except Exception as exc:  # A6: a failing page is quarantined, the job goes on
                rec = dict(has_html=html is not None and html != "", lang_attr=None,
                           main_rule=None, main_text=None, title_candidates=None,
                           hrefs=None, code=None, error=f"{type(exc).__name__}: {exc}")
            rec.update(site=site, page_id=pid, url=url)
            out.append(rec)
            chars += len(html or "")
            if chars >= CHUNK_CHARS:
                yield pd.DataFrame(out, columns=RECORD)
                out, chars = [], 0
        if out:
            yield pd.DataFrame(out, columns=RECORD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """B1: ``pages(site, page_id, url, html)`` -> extraction records.

    Only the four input columns enter the Python worker; the output is
    narrow (no html). Parsing is per row, so partitions of ``pages`` are
    processed independently with no shuffle."""
    ship_package(pages.sparkSession)
    src = pages.select("site", F.col("page_id").cast("bigint"), "url", "html")
    return src.mapInPandas(_parse_batches, EXTRACT_SCHEMA)


def materialised(pages: DataFrame) -> DataFrame:
    """``extract_pages``, written once. A batch of the default 10,000 rows
    holds as many whole pages in every worker; here batches end at
    ``BATCH_BYTES``, so a worker's memory does not grow with the table."""
    with small_batches(pages.sparkSession, BATCH_BYTES):
        return checkpoint(extract_pages(pages))


# ---------------------------------------------------------------------------
# Native steps over the extraction record
# ---------------------------------------------------------------------------

def choose_title(candidates: Column, url: Column) -> Column:
    """B4 + C13: first candidate longer than one character, else the slug."""
    picked = F.get(F.filter(candidates, lambda c: F.length(c) > 1), 0)
    return F.coalesce(picked, T.slug_title(url))


def code_blocks(extracted: DataFrame) -> DataFrame:
    """One row per code-block candidate inside main, >= 10 characters."""
    return (extracted
            .select("site", "page_id", "url", F.posexplode("code").alias("pos", "b"))
            .select("site", "page_id", "url", "pos", "b.sel_ord", "b.doc_ord", "b.classes", "b.code")
            .where(F.length("code") >= fixed.MIN_CODE_CHARS))
