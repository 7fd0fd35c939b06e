"""The visible text of web pages, laid out as lines.

Markup is read into a tree as browsers do where tags are left out: a block ends an open
paragraph, an item the item before, a cell the cell before, an end tag all that is open inside
its element. Elements that are not shown (scripts, the head, ``hidden``, ``display:none``,
closed details) are left out. The tree is laid out in lines: blocks start on a line of their
own, paragraphs, headings, lists and tables are set off by an empty line, list items have
bullets or numbers and are indented, the cells of a table are aligned in columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shellsieve.llm.common import col, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head title script style template datalist audio video canvas iframe noembed noframes object svg math area map dialog".split()
)
#: Blocks that an empty line sets off, and other blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center dd details div dt figcaption footer form header hgroup legend li main nav option optgroup search section summary tr td th thead tbody tfoot caption".split()
)
#: What a start tag ends if it is open, and the elements that this does not reach over.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (
        {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"})),
}
SCOPE = frozenset("table td th caption button object template html".split())
HEAD_PARTS = frozenset("base link meta noscript script style template title".split())
#: Elements nested deeper keep text, order, visibility and line breaks, but no layout of their own.
MAX_DEPTH = 200
#: Characters up to which a column of a table is aligned, and up to which all of them are; what is
#: longer moves the rest of its row. Columns over which cells may reach.
MAX_WIDTH, MAX_START, MAX_COLUMNS = 80, 400, 2000

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:(?P<q>[\"'])|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and the place after the tag."""
    found: dict[str, str] = {}
    size = len(page)
    while at < size:
        match = _ATTRIBUTE.match(page, at)
        if not match:
            while at < size and page[at] != ">":
                at += 1
                if _ATTRIBUTE.match(page, at):
                    break
            else:
                return found, min(at + 1, size)
            continue
        at, value = match.end(), match[3] or ""
        if match["q"]:
            end = page.find(match["q"], at)
            if end < 0:
                return found, size
            value, at = page[at:end], end + 1
        found.setdefault(match[1].lower(), html.unescape(value))
        if page.startswith(">", at):
            return found, at + 1
    return found, size


def _events(page: str) -> Iterator[tuple]:
    """(text,), (tag, attributes) and (tag, None) for an end tag, in order."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield (html.unescape(page[at:]),)
            return
        match = _TAG.match(page, lt)
        if match:
            if lt > at:
                yield (html.unescape(page[at:lt]),)
            tag = match[1].lower()
            attributes, at = _attributes(page, match.end())
            if page[lt + 1] == "/":
                yield tag, None
                continue
            yield tag, attributes
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else size
                if tag == "textarea":
                    yield (html.unescape(page[at:stop]),)
                at = stop
            elif tag == "plaintext":
                yield (page[at:],)
                return
        elif page.startswith("<!--", lt):
            if lt > at:
                yield (html.unescape(page[at:lt]),)
            end = page.find("-->", lt + 2)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?", "</"), lt):
            if lt > at:
                yield (html.unescape(page[at:lt]),)
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        else:
            yield (html.unescape(page[at: lt + 1]),)
            at = lt + 1


class Open:
    """An open element: the node that takes its content, and whether that is shown."""

    __slots__ = ("child_shown", "node", "own", "summary", "tag")

    def __init__(self, tag: str, node: Node, own: bool, child_shown: bool, summary: bool = False):
        self.tag, self.node, self.own, self.child_shown, self.summary = tag, node, own, child_shown, summary


class Builder:
    """Builds the tree; elements below ``MAX_DEPTH`` give their content to the node there."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [Open("html", self.root, True, True)]
        # Where elements of each tag are open in the stack.
        self.places: dict[str, list[int]] = {"html": [0]}

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop_to(self, tags, bounds) -> bool:
        """Close up to the innermost of ``tags`` if none of ``bounds`` is open within it."""
        at = self.last(tags)
        if at == 0 or at < self.last(bounds):
            return False
        while len(self.stack) > at:
            self.pop()
        return True

    def pop(self) -> None:
        closed = self.stack.pop()
        self.places[closed.tag].pop()
        if not closed.own and closed.tag in BLOCKS and self.stack[-1].child_shown:
            closed.node.children.append(Node("div", {}))

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if top.child_shown:
            top.node.children.append(text)

    def add(self, node: Node) -> None:
        """A node without content, or the start of an element."""
        top = self.stack[-1]
        deep = len(self.stack) >= MAX_DEPTH
        # Of a closed details element only the first summary is shown; this far down that is told here.
        first_summary = top.summary and node.tag == "summary"
        if first_summary:
            top.summary = False
        visible = (top.child_shown or first_summary) and (not deep or shown(node))
        if node.tag in VOID:
            if visible:
                top.node.children.append(node)
            return
        if not deep:
            top.node.children.append(node)
            self.push(Open(node.tag, node, True, True))
            return
        if visible and node.tag in BLOCKS:
            top.node.children.append(Node("div", {}))
        shut = node.tag == "details" and "open" not in node.attributes
        self.push(Open(node.tag, top.node, False, visible and not shut, visible and shut))

    def push(self, element: Open) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)


def tree(page: str) -> Node:
    """The page as a tree under ``html``; see ``Builder`` for very deep elements."""
    builder = Builder()
    stack, pop_to = builder.stack, builder.pop_to
    for event in _events(page):
        if len(event) == 1:
            if stack[-1].tag == "head" and event[0].strip():
                builder.pop()
            builder.text(event[0])
            continue
        tag, attributes = event
        if attributes is None:
            if tag == "br":
                builder.add(Node("br", {}))
            elif tag == "p":
                if not pop_to({"p"}, SCOPE):
                    builder.add(Node("p", {}))
                    builder.pop()
            elif tag in {"h1", "h2", "h3", "h4", "h5", "h6"}:
                pop_to({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPE)
            elif tag == "li":
                pop_to({"li"}, {"ul", "ol", "menu"} | SCOPE)
            elif tag in {"table", "tr", "thead", "tbody", "tfoot", "td", "th", "caption"}:
                pop_to({tag}, {"table"} - {tag})
            elif tag not in {"body", "html"}:
                pop_to({tag}, SCOPE - {tag})
            continue
        if tag == "html":
            builder.root.attributes = attributes | builder.root.attributes
            continue
        if stack[-1].tag == "head" and tag not in HEAD_PARTS:
            builder.pop()
        if tag in BLOCKS and tag not in {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup"}:
            pop_to({"p"}, SCOPE)
        if tag in CLOSES:
            closed, bounds = CLOSES[tag]
            while pop_to(closed, bounds):
                pass
        builder.add(Node(tag, attributes))
    return builder.root


def shown(node: Node) -> bool:
    if node.tag in HIDDEN:
        return node.tag == "dialog" and "open" in node.attributes
    attributes = node.attributes
    if "hidden" in attributes:
        return False
    return not ("style" in attributes and _NOT_SHOWN.search(attributes["style"]))


class Lines:
    """Collects words into lines; blank lines between blocks never add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap = [], False, 0

    def text(self, text: str) -> None:
        parts = _SPACE.split(text)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                if self.space and self.line:
                    self.line.append(" ")
                self.line.append(part)
                self.space = False

    def end(self) -> None:
        """End a line that has been begun."""
        if self.line:
            self.put(["".join(self.line)])
        self.line, self.space = [], False

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines += lines

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.gap = 1

    def add(self, lines: list[str], spaced: bool) -> None:
        self.block(spaced)
        self.put(lines)
        if spaced:
            self.gap = 1


def _children(node: Node) -> list:
    if node.tag == "details" and "open" not in node.attributes:
        return [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1]
    return node.children


def _fill(node: Node, out: Lines) -> None:
    for child in _children(node):
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if not shown(child):
            continue
        if tag == "br":
            if out.line:
                out.end()
            else:
                out.gap = 1
        elif tag in {"ul", "ol", "menu"}:
            out.add(_list(child), spaced=True)
        elif tag == "table":
            out.add(_table(child), spaced=True)
        elif tag in {"pre", "textarea", "xmp", "plaintext"}:
            out.add(_kept(child), spaced=True)
        elif tag == "blockquote":
            out.add(["  " + x if x else x for x in _layout(child)], spaced=True)
        elif tag == "dd":
            out.add(["  " + x if x else x for x in _layout(child)], spaced=False)
        elif tag in BLOCKS:
            out.block(tag in SPACED)
            _fill(child, out)
            out.block(tag in SPACED)
        else:
            _fill(child, out)


def _layout(node: Node) -> list[str]:
    out = Lines()
    _fill(node, out)
    out.end()
    return out.lines


def _kept(node: Node) -> list[str]:
    """Preformatted text, line by line."""
    parts: list[str] = []

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                parts.append(child)
            elif child.tag == "br":
                parts.append("\n")
            elif shown(child):
                walk(child)

    walk(node)
    lines = [x.rstrip() for x in re.split(r"\r\n|\r|\n", "".join(parts))]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _number(text: str | None, default: int, most: int = 1 << 31) -> int:
    match = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(int(match[1]), most) if match else default


def _list(node: Node) -> list[str]:
    out, number = Lines(), _number(node.attributes.get("start"), 1)
    loose = Node("div", {})
    for child in [*node.children, Node("li", {})]:
        if not (isinstance(child, Node) and child.tag == "li"):
            loose.children.append(child)
            continue
        if loose.children:
            out.put(["  " + x if x else x for x in _layout(loose)])
            loose = Node("div", {})
        if not shown(child):
            continue
        lines = [x for x in _layout(child)]
        number = _number(child.attributes.get("value"), number)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        if lines:
            pad = " " * len(mark)
            out.put([mark + lines[0], *(pad + x if x else x for x in lines[1:])])
    return out.lines


def _table(node: Node) -> list[str]:
    """Rows of cells, each column as wide as its widest cell; cells over several columns or rows.

    Columns are aligned up to ``MAX_WIDTH`` characters each and ``MAX_START`` together, so what is put in
    for alignment is bounded by the number of rows; a longer cell moves the rest of its row.
    """
    captions, rows, loose = [], [], Node("div", {})

    def collect(part: Node) -> None:
        for child in part.children:
            if isinstance(child, str):
                loose.children.append(child)
            elif not shown(child):
                continue
            elif child.tag in {"thead", "tbody", "tfoot"}:
                collect(child)
            elif child.tag == "tr":
                rows.append([x for x in child.children if isinstance(x, str) or shown(x)])
            elif child.tag in {"td", "th"}:
                rows.append([child])
            elif child.tag == "caption":
                captions.append(child)
            else:
                loose.children.append(child)

    collect(node)
    placed, taken, widths = [], {}, {}
    for r, row in enumerate(rows):
        column, line = 0, []
        for cell in row:
            if isinstance(cell, str) or cell.tag not in {"td", "th"}:
                loose.children.append(cell)
                continue
            while taken.get(column, 0) > r:
                column += 1
            across = max(1, _number(cell.attributes.get("colspan"), 1, 1000))
            across = min(across, max(1, MAX_COLUMNS - column))
            down = max(1, _number(cell.attributes.get("rowspan"), 1, 65534))
            for c in range(column, column + across):
                taken[c] = r + down
            line.append((column, across, _layout(cell)))
            column += across
        placed.append(line)
    for wide in (False, True):
        for line in placed:
            for column, across, lines in line:
                if (across > 1) == wide:
                    need = max(map(len, lines), default=0)
                    have = sum(widths.get(c, 0) for c in range(column, column + across)) + 2 * (across - 1)
                    if need > have:
                        last = column + across - 1
                        widths[last] = widths.get(last, 0) + need - have
    starts, at = {}, 0
    for c in range(max(taken, default=-1) + 1):
        starts[c] = min(at, MAX_START)
        # A column without text takes no room.
        width = min(widths.get(c, 0), MAX_WIDTH)
        at += width + 2 * (width > 0)
    out = Lines()
    for caption in captions:
        out.put(_layout(caption))
    # What does not belong into a table stands before it.
    out.put(_layout(loose))
    for line in placed:
        left, k = [cell for cell in line if cell[2]], 0
        while left:
            parts, size = [], 0
            for column, _, lines in left:
                gap = starts[column] - size
                if gap <= 0 and size:
                    gap = 0 if parts[-1].endswith(" ") else 2
                parts += [" " * gap, lines[k]]
                size += max(gap, 0) + len(lines[k])
            out.put(["".join(parts).rstrip()])
            k += 1
            left = [cell for cell in left if k < len(cell[2])]
    return out.lines


def page_text(page: str | None) -> str | None:
    """The visible text of a page, lines ended by line feeds; null for null."""
    if page is None:
        return None
    root = tree(page)
    return "\n".join(_layout(root)) if shown(root) else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text and n_lines of every row.

    A null page has null text and no lines, an empty one empty text. The whole page counts.
    An empty table gives no rows.
    """
    ship(pages.sparkSession)

    @F.pandas_udf(StringType())
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([page_text(x) for x in batch], dtype=object)

    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0)
    return pages.select(
        col(id_col).alias("page_id"), text_of(col(html_col).cast("string")).alias("text")
    ).select("page_id", "text", lines.alias("n_lines"))
