"""Fields of captured HTML pages.

HTML cannot be read with built-in functions, so two Arrow-batched UDFs turn a page into its
card fields or its detail fields. Only the board name and the page text go to Python; links,
defaults, tests and dedupe stay Column expressions outside.
"""

from __future__ import annotations

import html
import logging
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from stellwerk import vocab
from stellwerk.session import bound_page_batches, release_memory

log = logging.getLogger("stellwerk")

CARD_FIELDS = ["title", "company", "location", "href", "posted"]
CARDS_TYPE = "array<struct<{}>>".format(",".join(f"{name}:string" for name in CARD_FIELDS))
DETAIL_TYPE = "struct<description:string,experience:string>"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_HIDDEN = {"script", "style", "noscript", "template", "head"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre",
    "section", "table", "td", "th", "tr", "ul",
}
_SELF_CLOSING_SIBLINGS = {"li", "option", "dt", "dd", "tr", "td", "th"}


class _Page(list):
    """A page's elements in document order, and what selectors found out about all of them at once.

    Elements and their page hold each other; as a context it lets go of them, so that a page's memory is free as soon
    as the page is read and not when the collector comes round.
    """

    def __init__(self):
        super().__init__()
        self.known, self.spans, self.words = {}, None, ""

    def __enter__(self):
        return self[0]

    def __exit__(self, *_):
        for element in self:
            element.parent = element.page = element.children = None
        self.known = {}
        self.clear()

    def once(self, key, compute):
        if key not in self.known:
            self.known[key] = compute()
        return self.known[key]

    def places(self, test) -> list[int]:
        """Places of the elements that pass a test."""
        return self.once(("places", test), lambda: [e.place for e in self[1:] if test(e)])

    def below(self, outer) -> list[bool]:
        """For every element, whether one that passes ``outer`` stands anywhere above it."""

        def compute():
            flags = [False] * len(self)
            for element in self[1:]:
                above = element.parent
                flags[element.place] = flags[above.place] or bool(outer(above))
            return flags

        return self.once(("below", outer), compute)

    def above(self, inner) -> set[int]:
        """Places of all elements that hold one that passes ``inner``."""

        def compute():
            marked = set()
            for place in self.places(inner):
                element = self[place].parent
                while element is not None and element.place not in marked:
                    marked.add(element.place)
                    element = element.parent
            return marked

        return self.once(("above", inner), compute)

    def with_words(self, words: str) -> list[int]:
        """Where the page's running text has these words."""

        def compute():
            if self.spans is None:
                self._run_text()
            return [m.start() for m in re.finditer(f"(?={re.escape(words)})", self.words)]

        return self.once(("words", words), compute)

    def _run_text(self):
        """The page's visible text in one line, lower-cased, and each element's part of it."""
        self.spans, out, length, gap = [(0, 0)] * len(self), [], 0, False
        starts, stack = {}, [self[0]]
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):
                element = item[0]
                self.spans[element.place] = (starts[element.place], length)
                gap = gap or element.tag in _BLOCK
            elif isinstance(item, str):
                parts = item.lower().split()
                gap = gap or item[:1].isspace()
                if parts:
                    text = (" " if gap and length else "") + " ".join(parts)
                    out.append(text)
                    length += len(text)
                    gap = item[-1:].isspace()
                elif item:
                    gap = True
            elif item.tag not in _HIDDEN:
                gap = gap or item.tag in _BLOCK
                starts[item.place] = length
                stack.append((item,))
                stack.extend(item.children[::-1])
        self.words = "".join(out)


class _Element:
    __slots__ = ("tag", "attrs", "parent", "children", "place", "end", "page", "lines")

    def __init__(self, tag, attrs, parent, page):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.page, self.place, self.lines = page, len(page), None
        page.append(self)

    def text(self) -> str:
        """Visible text: runs of whitespace become one space, block tags break the line."""
        if self.lines is None:
            self.lines = self._text()
        return self.lines

    def has_words(self, words: str) -> bool:
        """Whether the text, in one line, has these words."""
        found = self.page.with_words(words)
        start, end = self.page.spans[self.place]
        at = bisect_left(found, start)
        return at < len(found) and found[at] + len(words) <= end

    def _text(self) -> str:
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in _HIDDEN:
                edge = ["\x00"] if item.tag in _BLOCK else []
                stack.extend(edge + item.children[::-1] + edge)
        lines = (" ".join(line.split()) for line in "".join(out).split("\x00"))
        return "\n".join(line for line in lines if line)


class _PageTree(HTMLParser):
    """A page's elements in document order; a subtree is a slice of them."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.elements = _Page()
        self.root = self.open = _Element("", {}, None, self.elements)
        self.feed(page)
        self.close()
        for element in self.elements:
            element.end = element.place + 1
        for element in reversed(self.elements[1:]):
            element.parent.end = max(element.parent.end, element.end)

    def parse_html_declaration(self, i):
        """Broken declarations are comments; the parser itself would give up on the page."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        same = tag in _SELF_CLOSING_SIBLINGS and self.open.tag == tag
        if same or (self.open.tag == "p" and tag in _BLOCK and tag != "br"):
            self.open = self.open.parent
        element = _Element(tag, dict(attrs), self.open, self.elements)
        self.open.children.append(element)
        if tag not in _VOID:
            self.open = element

    def handle_endtag(self, tag):
        element = self.open
        while element.parent and element.tag != tag:
            element = element.parent
        if element.parent:
            self.open = element.parent

    def handle_data(self, data):
        self.open.children.append(data)


# --- selectors: tag, .class, #id, [attr], [attr='v'], [attr*='v'], :has(), :has-text(),
# --- descendant and child steps, comma lists

_SIMPLE = re.compile(
    r"(?P<tag>^[\w-]+)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)'(?P<value>[^']*)')?\]"
    r"|:has-text\('(?P<words>[^']*)'\)|:has\((?P<inner>(?:[^()]|\([^()]*\))*)\)"
)
_STEP = re.compile(r"\s*(>)?\s*((?:[^\s>,(]|\((?:[^()]|\([^()]*\))*\))+)")


def _test(match: re.Match):
    part = match.groupdict()
    if part["tag"]:
        return lambda e: e.tag == part["tag"]
    if part["cls"]:
        return lambda e: part["cls"] in (e.attrs.get("class") or "").split()
    if part["id"]:
        return lambda e: e.attrs.get("id") == part["id"]
    if part["words"] is not None:
        words = " ".join(part["words"].split()).lower()
        return lambda e: e.has_words(words)
    if part["inner"]:
        inner = _compiled(part["inner"])
        return lambda e: e.place in e.page.above(inner)
    name, op, value = part["attr"], part["op"], part["value"]
    if op == "*=":
        return lambda e: value in (e.attrs.get(name) or "")
    if op == "=":
        return lambda e: e.attrs.get(name) == value
    return lambda e: name in e.attrs


def _step_test(step: str):
    tests = [_test(match) for match in _SIMPLE.finditer(step)]
    if len(tests) == 1:
        return tests[0]
    first, *others = tests
    return lambda e: first(e) and all(test(e) for test in others)


def _inside(outer, is_child: bool, inner):
    """Test for ``inner`` elements under (or directly under) an ``outer`` one."""

    def test(element):
        above = element.parent
        if above is None or not inner(element):
            return False
        return bool(outer(above)) if is_child else element.page.below(outer)[element.place]

    return test


@lru_cache(maxsize=None)
def _compiled(selector: str):
    alternatives = []
    for alternative in re.split(r",(?![^()\[]*[\])])", selector):
        test = None
        for child, step in _STEP.findall(alternative):
            test = _step_test(step) if test is None else _inside(test, bool(child), _step_test(step))
        alternatives.append(test)
    if len(alternatives) == 1:
        return alternatives[0]
    return lambda e: any(test(e) for test in alternatives)


def select(scope: _Element, selector: str):
    """Matching descendants in document order. A page is searched once per selector."""
    page = scope.page
    places = page.places(_compiled(selector))
    for at in range(bisect_right(places, scope.place), bisect_left(places, scope.end)):
        yield page[places[at]]


def _field(card: _Element, rules) -> str:
    for selector, attribute in rules:
        element = next(select(card, selector), None)
        if element is not None:
            value = ((element.attrs.get(attribute) or "") if attribute else element.text()).strip()
            if value:
                return value
    return ""


def _card(card: _Element, board: dict) -> dict | None:
    """A card's fields; None for one that can't be read."""
    try:
        return {name: _field(card, board[name]) for name in CARD_FIELDS}
    except Exception:
        log.exception("a card can't be read")
        return None


def page_cards(page: str | None, board: dict) -> list[dict]:
    with _PageTree(page or "").elements as tree:
        for selector in board["card"]:
            cards = list(select(tree, selector))
            if cards:
                return [fields for fields in (_card(card, board) for card in cards) if fields]
        return []


def page_detail(page: str | None, board: dict) -> dict:
    description = experience = ""
    with _PageTree(page or "").elements as tree:
        for selector in board["description"]:
            element = next(select(tree, selector), None)
            if element is not None:
                description = element.text().strip()
                if description or board["stop"] == "exists":
                    break
        for selector in board["experience"]:
            element = next(select(tree, selector), None)
            if element is not None:
                experience = element.text().strip()
                break
    return {"description": description, "experience": experience}


def _guarded(read, text, board, otherwise):
    """A page that can't be read gives ``otherwise`` and doesn't stop the others."""
    try:
        return read(text, board)
    except Exception:
        log.exception("a page can't be read")
        return otherwise


def _costly(udf):
    """Marked as non-deterministic, so that the planner never runs it a second time for a
    filter it derives or moves below it. Its batches are bounded."""
    bound_page_batches(SparkSession.getActiveSession())
    return udf.asNondeterministic()


def _batch_of(rows: Iterator, columns: list[str] | None = None) -> pd.Series | pd.DataFrame:
    """A batch's results; what reading its pages took is given back."""
    found = list(rows)
    release_memory()
    return pd.Series(found, dtype=object) if columns is None else pd.DataFrame(found, columns=columns)


def cards_of(platform: Column, page: Column, boards: dict = vocab.CARD_SELECTORS) -> Column:
    """All cards of a search page as an array; boards without selectors give an empty one.

    Null for a page that can't be read.
    """

    @F.pandas_udf(CARDS_TYPE)
    def extract(platforms: pd.Series, pages: pd.Series) -> pd.Series:
        return _batch_of(
            _guarded(page_cards, text, boards[name], None) if name in boards else []
            for name, text in zip(platforms, pages)
        )

    return _costly(extract)(platform, page)


def detail_of(platform: Column, page: Column, boards: dict = vocab.DETAIL_SELECTORS) -> Column:
    """Description and experience of a detail page; both empty for one that can't be read."""
    nothing = {"description": "", "experience": ""}

    @F.pandas_udf(DETAIL_TYPE)
    def extract(platforms: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = (
            _guarded(page_detail, text, boards[name], nothing) if name in boards else nothing
            for name, text in zip(platforms, pages)
        )
        return _batch_of(rows, ["description", "experience"])

    return _costly(extract)(platform, page)


def unescape_html(text: Column) -> Column:
    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return _batch_of(None if text is None else html.unescape(text) for text in texts)

    return _costly(unescape)(text)
