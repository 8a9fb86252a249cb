"""Layout-aware rendering of web pages to text.

A tokeniser and tree builder turn markup into a tree: end tags that authors may leave out are
implied, text that strays between table cells moves before the table, and nesting deeper than
`DEEPEST` is flattened. Visibility follows from element kinds, the `hidden` attribute, inline styles
and single-selector rules of style sheets. The renderer emits all visible text: white space collapses
except in preformatted text, blocks stand on lines of their own, those with margins between blank
lines, list items get markers and indents, and table cells line up in columns. Scripts do not run,
so `noscript` is shown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.texts import pieces

DEEPEST = 256
#: Columns line up to this width; longer cells stay whole and push what follows.
WIDEST_COLUMN = 60
GAP = "  "

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
NEVER = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist".split())
MARGIN = HEADINGS | frozenset("p ul ol dl dir menu table blockquote pre figure hr xmp listing".split())
BLOCK = MARGIN | frozenset(
    "address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main nav"
    " optgroup option search section summary caption tr thead tbody tfoot".split()
)
ENDS_P = BLOCK - frozenset("body html li dd dt option optgroup caption tr thead tbody tfoot legend".split())
SCOPE = frozenset("html table td th caption template button object marquee".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
#: Start tags that stay among the parts of a table; all others move before it.
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th form script style template".split())
SPECIAL = BLOCK | SCOPE
HEAD_ONLY = frozenset("base link meta script style template title noscript head html".split())
#: Elements that a start tag ends, and where the search for them stops.
IMPLIED = {
    "li": (frozenset(("li",)), SCOPE | {"ul", "ol"}),
    "dt": (frozenset(("dt", "dd")), SCOPE | {"dl"}),
    "dd": (frozenset(("dt", "dd")), SCOPE | {"dl"}),
    "option": (frozenset(("option",)), SCOPE | {"select"}),
    "optgroup": (frozenset(("option", "optgroup")), SCOPE | {"select"}),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr", "template"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr", "template"))),
    "tr": (frozenset(("tr", "caption")), frozenset(("table", "template"))),
    **{t: (frozenset(("tbody", "thead", "tfoot", "caption", "tr")), frozenset(("table", "template"))) for t in ("tbody", "thead", "tfoot", "caption")},
}
NAME = re.compile(r"/?([a-zA-Z][^\s/>\x00]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?")
TAG_END = re.compile(r"[\s/]*>")
SPACE = re.compile(r"[ \t\n\r\f]+")
LATE_COMMENT_END = re.compile(r"--!?>")
#: Elements of other languages, in which self-closed tags are empty, and those that lead back to HTML.
FOREIGN, HOMEWARD = frozenset(("svg", "math")), frozenset(("foreignobject", "annotation-xml"))
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes = tag, attributes or {}
        self.children: list[Node | str] = []


class Tree:
    """Builds the tree of a page; `styles` collects the texts of style sheets."""

    def __init__(self, markup: str):
        self.root = Node("html")
        self.stack = [self.root]
        self.styles: list[str] = []
        self._read(markup)

    def _read(self, m: str) -> None:
        at, n = 0, len(m)
        while at < n:
            open_ = m.find("<", at)
            if open_ < 0:
                self._text(m[at:])
                return
            after = m[open_ + 1 : open_ + 2]
            name = NAME.match(m, open_ + 1) if after == "/" or after.isalpha() else None
            if name is None and after not in ("!", "?", "/"):
                self._text(m[at : open_ + 1])
                at = open_ + 1
                continue
            if open_ > at:
                self._text(m[at:open_])
            if name is None:
                if m.startswith(("<!-->", "<!--->"), open_):
                    at = m.find(">", open_) + 1
                elif m.startswith("<!--", open_):
                    late = LATE_COMMENT_END.search(m, open_ + 4)
                    at = late.end() if late else n
                else:
                    at = m.find(">", open_) + 1 or n
                continue
            tag, attributes, at = name.group(1).lower(), {}, name.end()
            while not (end := TAG_END.match(m, at)):
                a = ATTRIBUTE.match(m, at)
                if a is None or (a.group(2) is None and m[a.end() : a.end() + 1] in ("'", '"')):
                    return  # the page ends inside a tag
                value = a.group(2) or ""
                if value[:1] in ("'", '"'):
                    value = value[1:-1]
                attributes.setdefault(a.group(1).lower(), unescape(value) if "&" in value else value)
                at = a.end()
            at = end.end()
            if m[open_ + 1] == "/":
                self._end(tag)
                continue
            node = self._start(tag, attributes)
            if m[at - 2] == "/" and (tag in FOREIGN or self._foreign()):
                self._pop(node)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(m, at)
                stop = close.start() if close else n
                said = m[at:stop]
                if tag == "style":
                    self.styles.append(said)
                elif tag not in NEVER:
                    node.children.append(unescape(said) if tag == "textarea" else said)
                self._pop(node)
                at = n if close is None else m.find(">", stop) + 1 or n

    def _foreign(self) -> bool:
        """Whether the page is inside an element of another language."""
        for x in reversed(self.stack):
            if x.tag in FOREIGN or x.tag in HOMEWARD:
                return x.tag in FOREIGN
        return False

    def _pop(self, node: Node) -> None:
        if node in self.stack[1:]:
            while self.stack.pop() is not node:
                pass

    def _close(self, tags: frozenset, stops: frozenset) -> None:
        """Ends the innermost open element among `tags`, unless one of `stops` is met before."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                del self.stack[i:]
                return
            if tag in stops:
                return

    def _leave_head(self) -> None:
        if len(self.stack) > 1 and self.stack[1].tag == "head":
            del self.stack[1:]

    def _leave_columns(self, tag: str = "") -> None:
        """Ends an open colgroup, which holds nothing but col."""
        if self.stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.stack.pop()

    def _leave_strays(self) -> None:
        """Ends elements that stray between the parts of the innermost table."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in TABLE_PARTS:
                del self.stack[i + 1 :]
                return
            if self.stack[i].tag in ("td", "th", "caption", "template"):
                return

    def _start(self, tag: str, attributes: dict[str, str]) -> Node:
        if tag in ("html", "body") and any(x.tag == tag for x in self.stack):
            for k, v in attributes.items():
                next(x for x in self.stack if x.tag == tag).attributes.setdefault(k, v)
            return Node(tag)
        if tag not in HEAD_ONLY:
            self._leave_head()
        self._leave_columns(tag)
        if tag in ENDS_P:
            self._close(frozenset(("p",)), SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in IMPLIED:
            if tag in ("tr", "tbody", "thead", "tfoot", "caption"):
                self._close(frozenset(("td", "th")), frozenset(("table", "tr", "template")))
                self._close(frozenset(("tr",)), frozenset(("table", "template")))
            self._close(*IMPLIED[tag])
            if tag in IN_TABLE:
                self._leave_strays()
            if tag in ("td", "th") and self.stack[-1].tag in TABLE_PARTS - {"tr"}:
                self._start("tr", {})
        if tag == "table":
            self._leave_strays()
            if self.stack[-1].tag in TABLE_PARTS:
                self._close(frozenset(("table",)), frozenset())
        node = Node(tag, attributes)
        in_table = self.stack[-1].tag in TABLE_PARTS
        if in_table and tag not in IN_TABLE:
            self._before_table(node)
        else:
            self.stack[-1].children.append(node)
        if in_table and tag == "form":
            return node  # stays empty: rows that follow are the table's
        if tag not in VOID and len(self.stack) < DEEPEST:
            self.stack.append(node)
        return node

    def _before_table(self, child: Node | str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == "table":
                siblings = self.stack[i - 1].children
                place = next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is self.stack[i])
                siblings.insert(place, child)
                return
        self.stack[-1].children.append(child)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._start("br", {})
            return
        if tag in ("html", "body"):
            return
        self._leave_columns(tag)
        if tag == "p" and not any(x.tag == "p" for x in self.stack):
            self.stack[-1].children.append(Node("p"))
            return
        if tag in HEADINGS:
            self._close(HEADINGS, SCOPE)
        elif tag in ("table", "template"):
            self._close(frozenset((tag,)), frozenset())
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self._close(frozenset((tag,)), frozenset(("table", "template")))
        elif tag in SPECIAL or tag in ("head", "select", "ul", "ol"):
            self._close(frozenset((tag,)), SCOPE)
        else:
            self._close(frozenset((tag,)), SPECIAL)

    def _text(self, said: str) -> None:
        if "&" in said:
            said = unescape(said)
        top = self.stack[-1]
        if not said or said.isspace():
            if top.tag not in TABLE_PARTS and said:
                top.children.append(said)
            return
        self._leave_head()
        self._leave_columns()
        if self.stack[-1].tag in TABLE_PARTS:
            self._before_table(said)
        else:
            self.stack[-1].children.append(said)


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, body) of a style sheet's innermost blocks, comments left out, in one pass."""
    parts, at = [], 0
    while (begin := sheet.find("/*", at)) >= 0 and (end := sheet.find("*/", begin + 2)) >= 0:
        parts.append(sheet[at:begin])
        at = end + 2
    parts.append(sheet[at:])
    for block in "".join(parts).split("}")[:-1]:
        head, brace, body = block.rpartition("{")
        selectors = head.rpartition("{")[2]
        if brace and selectors:
            yield selectors, body


class Styles:
    """What single-selector rules (tag, .class or #id) hide or show."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, tuple[bool, str | None]] = {}
        for sheet in sheets:
            for selectors, body in rules(sheet):
                gone, seen = bool(NO_DISPLAY.search(body)), VISIBILITY.search(body)
                if gone or seen:
                    for s in selectors.split(","):
                        if re.fullmatch(r"[.#]?[\w-]+", s.strip()):
                            self.rules[s.strip()] = (gone, seen.group(1).lower() if seen else None)

    def of(self, node: Node) -> tuple[bool, str | None]:
        """Whether the element is not displayed, and its own visibility if it has one."""
        a = node.attributes
        gone = node.tag in NEVER or "hidden" in a or (node.tag == "dialog" and "open" not in a)
        seen: str | None = None
        if self.rules:
            for s in (node.tag, *(f".{c}" for c in a.get("class", "").split()), f"#{a.get('id', '')}"):
                if s in self.rules:
                    rule = self.rules[s]
                    gone, seen = gone or rule[0], rule[1] or seen
        if "style" in a:
            gone = gone or bool(NO_DISPLAY.search(a["style"]))
            own = VISIBILITY.search(a["style"])
            seen = own.group(1).lower() if own else seen
        return gone, seen


class Box:
    """Lines of a block, with the line that is being filled."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is due before the next word
        self.margin = False  # a blank line is due before the next line

    def words(self, said: str) -> None:
        said = SPACE.sub(" ", said)
        if said[0] == " ":
            self.space = True
            said = said[1:]
        if not said:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = said[-1] == " "
        self.line.append(said[:-1] if self.space else said)

    def verbatim(self, said: str) -> None:
        first, *rest = said.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for x in rest:
            self.flush(True)
            self.line.append(x)

    def flush(self, empty: bool = False) -> None:
        """Ends the line; an empty one counts only if `empty`."""
        if self.line or empty:
            said = "".join(self.line).rstrip(" ")
            if said or empty:
                self.add([said])
        self.line, self.space = [], False

    def add(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        self.lines += lines

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        first = next((i for i, x in enumerate(self.lines) if x), 0)
        return self.lines[first:]


def rendered_page(markup: str) -> str:
    """The visible text of a page."""
    tree = Tree(markup)
    styles = Styles(tree.styles)
    box = Box()
    fill(box, tree.root, styles, False, True)
    return "\n".join(box.done())


def fill(box: Box, node: Node, styles: Styles, pre: bool, visible: bool) -> None:
    """Renders the children of an element into a box."""
    number = int(node.attributes["start"]) if re.fullmatch(r"-?[0-9]{1,9}", node.attributes.get("start", "")) else 1
    closed = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if visible and not closed and child:
                box.verbatim(child) if pre else box.words(child)
            continue
        if closed and child.tag != "summary":
            continue
        gone, seen = styles.of(child)
        if gone:
            continue
        shown = visible if seen is None else seen == "visible"
        tag = child.tag
        if tag == "br":
            box.flush(True)
        elif tag == "wbr" or tag in VOID and tag not in ("hr", "input"):
            pass
        elif tag == "input":
            if shown and child.attributes.get("type", "").lower() in ("submit", "button", "reset") and child.attributes.get("value"):
                box.words(f" {child.attributes['value']} ")
        elif tag in BLOCK or tag == "table":
            box.flush()
            margin = tag in MARGIN and not (tag in ("ul", "ol") and node.tag == "li")
            box.margin = box.margin or margin
            if tag == "table":
                box.add(table(child, styles, pre, shown))
            elif tag in ("li", "blockquote", "dd"):
                inner = Box()
                fill(inner, child, styles, pre, shown)
                mark = "    " if tag != "li" else "- "
                if tag == "li" and node.tag == "ol":
                    mark, number = f"{number}. ", number + 1
                indent = " " * len(mark)
                lines = inner.done()
                first = mark if tag == "li" else indent
                box.add([(first if k == 0 else indent if x else "") + x for k, x in enumerate(lines)])
            else:
                fill(box, child, styles, pre or tag in ("pre", "xmp", "listing"), shown)
            box.flush()
            box.margin = box.margin or margin
        else:
            fill(box, child, styles, pre or tag == "textarea", shown)


def width(said: str) -> int:
    return len(said) if said.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in said)


def span(node: Node, name: str, most: int) -> int:
    said = node.attributes.get(name, "")
    return min(most, max(1, int(said))) if re.fullmatch(r"[0-9]{1,9}", said) else 1


def table(node: Node, styles: Styles, pre: bool, visible: bool) -> list[str]:
    """A table's caption and rows; cells line up, and several lines of a cell stay in its column."""
    out: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []
    held: dict[int, int] = {}  # rows that a cell from above still covers, by column
    last: list[Node] = []

    def visit(part: Node, visible: bool) -> None:
        for child in part.children:
            if isinstance(child, str):
                continue
            gone, seen = styles.of(child)
            if gone:
                continue
            shown = visible if seen is None else seen == "visible"
            if child.tag == "caption":
                box = Box()
                fill(box, child, styles, pre, shown)
                out.extend(box.done())
            elif child.tag in ("thead", "tbody"):
                visit(child, shown)
            elif child.tag == "tfoot":
                last.append(child)
            elif child.tag == "tr":
                row(child, shown)
            elif lines := other(child, visible):
                rows.append([(0, 2, lines)])

    def other(child: Node, visible: bool) -> list[str]:
        """What an element that is no part of a table shows."""
        box, around = Box(), Node("td")
        around.children.append(child)
        fill(box, around, styles, pre, visible)
        return box.done()

    def row(part: Node, visible: bool) -> None:
        cells, column = [], 0
        for child in part.children:
            if isinstance(child, str):
                continue
            gone, seen = styles.of(child)
            if gone or child.tag not in ("td", "th") and not other(child, visible):
                continue
            while held.get(column, 0):
                column += 1
            box = Box()
            if child.tag in ("td", "th"):
                fill(box, child, styles, pre, visible if seen is None else seen == "visible")
            else:
                box.add(other(child, visible))
            across, down = span(child, "colspan", 1000), span(child, "rowspan", 65_534)
            cells.append((column, across, box.done()))
            for k in range(column, column + across):
                if down > 1:
                    held[k] = down
            column += across
        for k in [*held]:
            held[k] -= 1
            if not held[k]:
                del held[k]
        rows.append(cells)

    visit(node, visible)
    for foot in last:
        visit(foot, visible)
    widths: dict[int, int] = {}
    for cells in rows:
        for column, across, lines in cells:
            if across == 1:
                widths[column] = max([widths.get(column, 0), *(w for x in lines if (w := width(x)) <= WIDEST_COLUMN)])
    used = sorted({c for cells in rows for c, _, lines in cells if lines})
    place, at = {}, 0
    for c in used:
        place[c] = at
        at += widths.get(c, 0) + len(GAP)
    for cells in rows:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, filled = [], 0
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    pad = max(place[column] - filled, len(GAP) if filled else 0)
                    line.append(" " * pad + lines[k])
                    filled += pad + width(lines[k])
            out.append("".join(line).rstrip(" "))
    while out and not out[-1]:
        out.pop()
    return out


def rendered(df: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text): the visible text of each whole page, laid out.

    A null or empty page has an empty text. Repeated rows are rendered each; an empty table gives an
    empty one. Other columns of `df` are not read.
    """
    narrow = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            said = [rendered_page(m) if m else "" for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["page_id", "text"])

    return narrow.mapInArrow(run, "page_id long, text string")
