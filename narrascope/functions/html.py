"""Plain text of markup, by the tree that a lenient HTML parser builds.

A scanner goes over the tags with a stack of open elements.  A start tag first ends the open elements that it may not stand
in, from the innermost on; an end tag ends the innermost open element of its name and all inside it, unless one of a
higher rank stands between.  Tags of html, head and body are passed over, so what they hold stands at the top.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, tags that are passed over, and what stands before a heading's text.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PASSED = frozenset(("html", "head", "body"))
MARKS = {"h2": "# ", "h3": "## "}
TEXTS = ("p", "dl", "dd")
#: The open elements that a start tag ends.
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LISTINGS = ("pre", "listing", "xmp")
_STYLES = ("tt", "i", "b", "u", "s", "strike", "big", "small")
_CELLS = ("th", "td", "p", "span", "font", "a", "b", "i", "u")
ENDS = {
    **{h: ("p", *(x for x in _HEADINGS if x != h)) for h in _HEADINGS},
    **dict.fromkeys(("div", "blockquote", "hr", "dir", "listing", "xmp"), ("p",)),
    "a": ("a",), "address": ("p", "ul"), "caption": ("p",), "center": ("font", "b", "i", "p"), "col": ("caption", "col", "p"), "colgroup": ("caption", "colgroup", "col", "p"),
    "dd": ("p", "menu", "dir", "address", *_LISTINGS, "dt"), "dl": ("p", "dt", "menu", "dir", "address", *_LISTINGS), "dt": ("p", "menu", "dir", "address", *_LISTINGS, "dd"),
    "form": ("form", "p", "hr", *_HEADINGS, "dl", "ul", "ol", "menu", "dir", "address", "pre", "listing", "blockquote"), "li": ("p", *_HEADINGS, "dl", "address", *_LISTINGS, "li"),
    "menu": ("p", "ul"), "ol": ("p", "ul"), "p": ("p", *_HEADINGS, *_STYLES), "pre": ("p", "ul"), "table": ("p", *_HEADINGS, *_LISTINGS, "a"),
    "tbody": ("th", "td", "tr", "caption", "col", "colgroup", "thead", "tfoot", "tbody", "p"), "td": _CELLS, "tfoot": ("th", "td", "tr", "caption", "col", "colgroup", "thead", "tbody", "p"),
    "th": _CELLS, "thead": ("caption", "col", "colgroup"), "title": ("p",), "tr": ("th", "td", "tr", "caption", "col", "colgroup", "p"), "ul": ("p", "ol", "menu", "dir", "address", *_LISTINGS),
}
#: Ranks of elements; an end tag doesn't reach over one of a higher rank than its own.
RANKS = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190}
_OTHER = 100


class _Scanner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.lines: list[str] = []
        self.text: list[str] = []
        self.inside = False  # whether a child of the element at the top has begun

    def _leave(self) -> None:
        tag = self.open.pop()
        if not self.open:
            text = "".join(self.text).strip()
            if tag in TEXTS:
                self.lines.append(text + "\n")
            elif tag in MARKS and self.text:
                self.lines.append(MARKS[tag] + text + "\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in PASSED:
            return
        while self.open and self.open[-1] in ENDS.get(tag, ()):
            self._leave()
        self.inside = True
        if not self.open:
            self.text, self.inside = [], False
        self.open.append(tag)
        if tag in EMPTY:
            self._leave()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and self.open and self.open[-1] == tag:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        if tag in PASSED or tag not in self.open:
            return
        rank = RANKS.get(tag, _OTHER)
        for other in reversed(self.open):
            if other == tag:
                break
            if RANKS.get(other, _OTHER) > rank:
                return
        while self.open[-1] != tag:
            self._leave()
        self._leave()

    def handle_comment(self, data: str) -> None:
        self.inside = True

    def handle_data(self, data: str) -> None:
        # of a heading only what stands before its first child counts
        if self.open and not (self.inside and self.open[0] in MARKS):
            self.text.append(data)

    def finish(self) -> str:
        self.close()
        while self.open:
            self._leave()
        return "".join(self.lines).strip()


def plain_text(markup: str) -> str:
    """Headings of the second and third order, marked, and paragraphs and lists at the top of the markup, each on a line.

    Of headings the text before the first child counts, and those without one are left out; of the others all text, that of
    comments excepted.  Elements inside others don't stand for themselves.
    """
    scanner = _Scanner()
    scanner.feed(markup)
    return scanner.finish()


@F.arrow_udf(T.StringType())
def _plain(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in parts:
        yield pa.array([None if x is None else plain_text(x) for x in column.to_pylist()], pa.string())


def html_to_plain(c: Column) -> Column:
    """``plain_text`` of a column; null markup has none."""
    return _plain(c)
