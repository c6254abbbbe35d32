"""Visible text of web pages, laid out: blocks apart, list items marked and indented, table cells in columns.

A tree is built from the tags, with end tags implied as HTML does (paragraphs end before blocks, items, cells and rows before their
like), then walked once. What browsers don't show is left out: scripts, styles, head, templates, ``hidden``, ``display:none``,
closed dialogs and details, and in svg all but its texts. White space collapses except in ``pre`` and ``textarea``. Nothing is dropped as boilerplate.

Defined cases: a null or empty page gives an empty text; broken markup never fails, text in it counts as text; nesting may be of any
depth; tables within more than ``TABLES`` tables are laid out as blocks; cells are padded to at most ``CELL`` characters; repeated
rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from jobmeter.llm.common import map_rows

TABLES = 12
CELL = 60

_set = lambda names: frozenset(names.split())
_VOID = _set("area base br col embed hr img input link meta param source track wbr")
_UNSEEN = _set("script style head title template noscript iframe object video audio canvas datalist noembed noframes frameset area annotation annotation-xml")
#: Within svg only these show their text.
_SVG_TEXT = _set("text foreignobject")
_SPACED = _set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr")
_BLOCK = _SPACED | _set("html body div article section nav header footer main aside address form li dt dd tr caption details summary dialog figcaption center legend menu optgroup option thead tbody tfoot td th search hgroup")
#: By tag: open elements that its start ends, and those it doesn't look behind.
_ENDS = {
    "li": (_set("li"), _set("ul ol menu")),
    "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")),
    "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")),
    "tr": (_set("tr"), _set("table")),
    "thead": (_set("thead tbody tfoot caption"), _set("table")), "tbody": (_set("thead tbody tfoot caption"), _set("table")),
    "tfoot": (_set("thead tbody tfoot caption"), _set("table")),
    "body": (_set("head"), frozenset()),
}
_ENDS_PARAGRAPH = _BLOCK - _set("html body tr td th thead tbody tfoot option optgroup caption")
#: What an end tag of a block doesn't reach beyond; those of other elements end at any block.
_CELLS = _set("table td th")
_WHOLE = dict.fromkeys(_set("table div ul ol"), frozenset()) | dict.fromkeys(_set("tr thead tbody tfoot td th"), _set("table"))
_VERBATIM = _set("pre textarea")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def seen(self) -> bool:
        if self.tag in _UNSEEN or "hidden" in self.attrs or _HIDING.search(self.attrs.get("style") or ""):
            return False
        return self.tag != "dialog" or "open" in self.attrs

    def number(self, name: str, default: int) -> int:
        value = (self.attrs.get(name) or "").strip()
        return int(value) if re.fullmatch(r"[0-9]{1,4}", value) else default


class TreeBuilder(HTMLParser):
    """A tree of :class:`Element` and strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]
        self.open_tags: dict[str, int] = {"html": 1}  # how many of each are open

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.open_tags[self.open.pop().tag] -= 1

    def _end_nearest(self, tags: frozenset, stop: frozenset) -> None:
        if any(self.open_tags.get(t) for t in tags):
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag in tags:
                    return self._close(depth)
                if self.open[depth].tag in stop:
                    return

    def parse_marked_section(self, i, report=1):
        """``<![...`` is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in _ENDS:
            self._end_nearest(*_ENDS[tag])
        elif self.open[-1].tag == "head" and tag not in _VOID and tag not in _UNSEEN:
            self._close(len(self.open) - 1)
        if tag in _ENDS_PARAGRAPH:
            self._end_nearest(frozenset(("p",)), _set("table td th li dd blockquote div section article"))
        if tag == "tr" and self.open[-1].tag in ("td", "th"):
            self._close(len(self.open) - 1)
        element = Element(tag, dict(attrs))
        self.open[-1].children.append(element)
        if tag not in _VOID:
            self.open.append(element)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        foreign = tag in ("svg", "math") or (self._foreign() and tag not in _VOID)
        self.handle_starttag(tag, attrs)
        if foreign and len(self.open) > 1 and self.open[-1].tag == tag and len(self.open) <= depth + 1:
            self._close(len(self.open) - 1)

    def _foreign(self) -> bool:
        """Whether the innermost of svg, math and what holds HTML in them is one of the first two."""
        if self.open_tags.get("svg") or self.open_tags.get("math"):
            for element in reversed(self.open):
                if element.tag in ("svg", "math", "foreignobject"):
                    return element.tag != "foreignobject"
        return False

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.open[-1].children.append(Element("br", {}))
        elif self.open_tags.get(tag):
            self._end_nearest(frozenset((tag,)), _BLOCK if tag not in _BLOCK else _WHOLE.get(tag, _CELLS))

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._close(len(self.open) - 1)
        self.open[-1].children.append(data)


class Writer:
    """Lines of text; breaks are asked for and written before the next text."""

    def __init__(self):
        self.lines: list[str] = [""]
        self.breaks = 0
        self.blank = False
        self.indent: list[str] = []
        self.marker = ""

    def block(self, breaks: int) -> None:
        self.breaks = max(self.breaks, breaks)
        self.blank = False

    def line(self) -> None:
        """A forced line break."""
        self.lines.append("".join(self.indent) if self.breaks == 0 else "")
        self.blank = False

    def _begin(self) -> None:
        if self.breaks or self.marker:
            if any(self.lines[-1:]) or len(self.lines) > 1:
                while len(self.lines) > 1 and not self.lines[-1].strip():
                    self.lines.pop()
                if self.lines != [""]:
                    self.lines.extend([""] * max(1, self.breaks))
            self.lines[-1] = ("".join(self.indent[:-1]) if self.marker else "".join(self.indent)) + self.marker
            self.breaks, self.marker, self.blank = 0, "", False

    def text(self, data: str) -> None:
        words = _SPACE.sub(" ", data)
        if not words:
            return
        if words == " ":
            self.blank = True
            return
        self._begin()
        if (self.blank or words[0] == " ") and self.lines[-1].strip() and self.lines[-1][-1] != " ":
            self.lines[-1] += " "
        self.blank = words[-1] == " "
        self.lines[-1] += words.strip(" ")

    def verbatim(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").split("\n")
        if first or not rest:
            self._begin()
            self.lines[-1] += first
        for line in rest:
            if self.breaks and not line:
                continue
            self._begin()
            self.lines.append("".join(self.indent) + line)

    def result(self) -> str:
        return "\n".join(x.rstrip(" \t") for x in self.lines).strip("\n")


def _width(text: str) -> int:
    """Columns a text takes on a terminal."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _rows(table: Element) -> tuple[list[Element], list[Element]]:
    """Captions and rows of a table, not of tables within."""
    captions, rows, stack = [], [], [iter(table.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, Element) and child.seen():
            if child.tag == "tr":
                rows.append(child)
            elif child.tag in ("thead", "tbody", "tfoot", "form", "colgroup"):
                stack.append(iter(child.children))
            elif child.tag != "col":
                captions.append(child)
        elif isinstance(child, str) and child.strip():
            captions.append(Element("div", {}))
            captions[-1].children.append(child)
    return captions, rows


def _table(table: Element, out: Writer, depth: int) -> None:
    captions, rows = _rows(table)
    for caption in captions:
        out.block(1)
        _render(caption, out, depth + 1)
        out.block(1)
    grid: list[list[str]] = []
    taken: dict[int, int] = {}  # column: rows that a cell above still covers
    for row in rows:
        line: list[str] = []

        def skip():
            while taken.get(len(line), 0):
                taken[len(line)] -= 1
                line.append("")

        for cell in row.children:
            if not isinstance(cell, Element):
                if cell.strip():
                    line.append(_SPACE.sub(" ", cell).strip())
                continue
            if not cell.seen():
                continue
            skip()
            inner = Writer()
            _render(cell, inner, depth + 1)
            span = min(cell.number("colspan", 1), 100) or 1
            for k in range(span):
                if cell.number("rowspan", 1) > 1:
                    taken[len(line)] = cell.number("rowspan", 1) - 1
                line.append(" ".join(inner.result().split()) if not k else "")
        skip()
        if any(line):
            grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for k, cell in enumerate(line):
            widths[k] = max(widths.get(k, 0), min(CELL, _width(cell)))
    for line in grid:
        out.block(1)
        while line and not line[-1]:
            line.pop()
        cells = [c + " " * max(0, widths[k] - _width(c)) for k, c in enumerate(line)]
        out.verbatim("  ".join(cells).rstrip())
        out.block(1)


def _render(start: Element, out: Writer, depth: int = 0) -> None:
    """Writes what is seen of ``start``, whose own block is up to the caller; no recursion but for tables in tables."""
    stack: list[tuple[Element, object, int]] = [(start, iter(start.children), 0)]
    drawn = [start.tag == "svg"]  # by element on the stack: whether it's in svg outside of text
    preformatted = int(start.tag in _VERBATIM)
    while stack:
        element, children, count = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            drawn.pop()
            if element is not start:
                preformatted -= element.tag in _VERBATIM
                _leave(element, out)
        elif element.tag == "details" and "open" not in element.attrs and getattr(child, "tag", "") != "summary":
            continue
        elif isinstance(child, str):
            if not drawn[-1]:
                (out.verbatim if preformatted else out.text)(child)
        elif not child.seen():
            continue
        elif child.tag == "br":
            out.line()
        elif child.tag == "table" and depth < TABLES:
            out.block(2)
            _table(child, out, depth)
            out.block(2)
        else:
            if child.tag == "li":
                count += 1
                stack[-1] = (element, children, count)
                first = element.number("start", 1) if element.tag == "ol" else 0
                _enter_item(child, out, f"{first + count - 1}. " if element.tag == "ol" else "- ")
            else:
                _enter(child, out)
            preformatted += child.tag in _VERBATIM
            stack.append((child, iter(child.children), 0))
            drawn.append(child.tag == "svg" or (drawn[-1] and child.tag not in _SVG_TEXT))


def _enter(element: Element, out: Writer) -> None:
    if element.tag in _BLOCK:
        nested = element.tag in ("ul", "ol") and out.indent
        out.block(2 if element.tag in _SPACED and not nested else 1)
    if element.tag in ("dd", "blockquote"):
        out.indent.append("  ")
    elif element.tag in ("td", "th"):
        out.blank = True


def _enter_item(item: Element, out: Writer, marker: str) -> None:
    out.block(1)
    out.indent.append(" " * len(marker))
    out.marker = marker


def _leave(element: Element, out: Writer) -> None:
    if element.tag in ("li", "dd", "blockquote") and out.indent:
        out.indent.pop()
        out.marker = ""
    if element.tag in _BLOCK:
        nested = element.tag in ("ul", "ol") and out.indent
        out.block(2 if element.tag in _SPACED and not nested else 1)


def _ended(html: str) -> str:
    """Markup without the comment or tag that it breaks off in."""
    comment = html.rfind("<!--")
    if comment > html.rfind("-->"):
        html = html[:comment]
    tag = html.rfind("<")
    return html[:tag] if tag > html.rfind(">") and re.match(r"<[/!?a-zA-Z]", html[tag:]) else html


def visible_text(html: str | None) -> str:
    builder = TreeBuilder()
    builder.feed(_ended(html or ""))
    builder.close()
    out = Writer()
    _render(builder.root, out)
    return out.result()


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_chars`` of every page."""

    def make():
        def step(columns):
            for page_id, html in zip(*columns):
                text = visible_text(html)
                yield page_id, text, len(text)

        return step

    return map_rows(pages.select("page_id", "html"), make, "page_id long, text string, n_chars long")
