"""Facts of a product page: titles, price text and flags, from one parse of its markup.

An element's text is that of its whole subtree: every text node trimmed, empty ones left
out, joined without a separator; script and style bodies and comments are no text. A void
element has no text. The parser decodes every HTML5 entity and takes any quoting. An end tag
closes the innermost open element of its name; without one it is ignored.
"""
from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed

FACTS = ("title string, price_text string, price_match string, has_h1 boolean, has_price boolean, "
         "has_cart boolean, page_text string")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style"}
_SELECTOR = re.compile(r"([\w-]*)(?:\.([\w-]+))?(?:\[([\w-]+)(?:='([^']*)')?\])?")
_PRICE = re.compile(fixed.PRICE_PATTERN)
_CART = re.compile(fixed.ADD_TO_CART_PATTERN, re.IGNORECASE)


class PageParser(HTMLParser):
    """First element of each selector with its text, and the text of the page."""

    def __init__(self, selectors: list[str]):
        super().__init__(convert_charrefs=True)
        self.wanted = {s: _SELECTOR.fullmatch(s).groups() for s in selectors}
        self.found: dict[str, list[str]] = {}
        self.open: list[tuple[str, list[str]]] = []  # tag and the selectors whose first element it is
        self.depth = Counter()                       # open elements by tag
        self.taking = Counter()                      # selectors whose element is open
        self.page: list[str] = []
        self.node: list[str] = []                    # pieces of the text node being read
        self.cart = False

    def end_node(self):
        text, self.node = "".join(self.node), []
        if not text:
            return
        self.cart = self.cart or bool(_CART.search(text))
        if not self.open or self.open[-1][0] not in HIDDEN:
            self.page.append(text)
            for s in self.taking:
                self.found[s].append(text.strip())

    def handle_starttag(self, tag, attrs):
        self.end_node()
        have = {k: v or "" for k, v in reversed(attrs)}
        classes = have.get("class", "").split()
        mine = [s for s, (name, cls, attr, value) in self.wanted.items()
                if s not in self.found and name in ("", tag) and (cls is None or cls in classes)
                and (attr is None or (attr in have and value in (None, have[attr])))]
        for s in mine:
            self.found[s] = []
        if tag not in VOID:
            self.open.append((tag, mine))
            self.depth[tag] += 1
            self.taking.update(mine)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_node()
        while self.depth[tag]:
            name, mine = self.open.pop()
            self.depth[name] -= 1
            for s in mine:
                del self.taking[s]
            if name == tag:
                break

    def handle_data(self, data):
        self.node.append(data)

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def first(self, selectors: list[str]) -> str | None:
        """Text of the first selector that has an element, in selector order."""
        return next(("".join(self.found[s]) for s in selectors if s in self.found), None)


def parse_page(html: str) -> tuple:
    """Values of ``FACTS`` for one page."""
    selectors = list(dict.fromkeys(fixed.TITLE_SELECTORS + fixed.PRICE_SELECTORS + fixed.PRICE_ELEMENT_SELECTORS))
    try:
        page = PageParser(selectors)
        page.feed(html)
        page.close()
    except AssertionError:  # a marked section the parser does not know: read its opening as text
        page = PageParser(selectors)
        page.feed(html.replace("<![", "&lt;!["))
        page.close()
    page.end_node()
    text = "".join(page.page)
    price = page.first(fixed.PRICE_SELECTORS)
    match = _PRICE.search(price or "") or _PRICE.search(text)
    return (page.first(fixed.TITLE_SELECTORS) or page.first(["title"]) or None, price, match.group() if match else None,
            "h1" in page.found, any(s in page.found for s in fixed.PRICE_ELEMENT_SELECTORS), page.cart, text)


def _facts(pages: pd.Series) -> pd.DataFrame:
    rows = [parse_page(x) if isinstance(x, str) else (None, None, None, False, False, False, None) for x in pages]
    return pd.DataFrame(rows, columns=[f.split()[0] for f in FACTS.split(", ")])


_UDF = None


def page_facts(html: Column) -> Column:
    """Struct ``FACTS`` of a page (Arrow-batched pandas UDF).

    title: first title selector that has an element, else the page title, null when empty.
    price_text: first price selector that has an element (possibly ''), else null.
    price_match: first price in price_text, else in the page text, else null.
    A null page has null texts and false flags. Declared non-deterministic, so that the
    optimizer parses a page once however many of its facts are used.
    """
    global _UDF
    if _UDF is None:  # created on first use, when a session exists
        _UDF = F.pandas_udf(_facts, FACTS).asNondeterministic()
    return _UDF(html)
