"""Text of web pages as a reader sees it: tree building, visibility, then layout.

A page becomes a tree first. Tags that HTML lets authors leave out are implied: a block ends an open
paragraph, an item ends the item before it, a cell the cell before it, and so on; an end tag
without a start tag is ignored, and what is still open at the end is closed. The tree is then
rendered: invisible subtrees are skipped, blocks are set apart by line breaks (paragraphs, headings,
lists and tables by a blank line), list items get their marks and the indent of their depth,
preformatted text keeps its spaces, and the cells of a table are padded to the width of their columns,
``colspan`` and ``rowspan`` included.

All visible text is kept, navigation and advertisements included; nothing is judged by its content.
Formulas, the texts of drawings, the fallback of an object, all options of a selection and the
values that form controls show are visible.

Invisible are: comments, declarations, script, style, template, noscript, head (the title has a
column of its own), the fallbacks of frames, sound, films and canvases, descriptions and
annotations within drawings and formulas, ``hidden`` attributes, and inline styles with ``display: none``. What is within an
element of ``visibility: hidden`` is invisible up to an element of ``visibility: visible``.

Layout costs no more than the text: cells are padded to ``WIDEST`` characters at most, longer ones stand
out of line; cells of one row are set below each other if side by side they would be mostly empty;
and spans beyond as many places as the table has cells, several times, are not carried on. No text is cut for it.

Null and empty pages give an empty text. Pages are read whole. Nesting below ``DEEPEST`` levels
is flattened, not cut: deeper elements are attached to the same parent, and their text stays. Repeated rows are
rendered alike, and an empty table gives no rows. Columns named like an output column are replaced; all others pass
through as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEEPEST = 200
WIDEST = 80
EMPTY_PLACES = 8
"""Empty places of a row or table for each line or cell that it has, at most, and 256 more."""

# The element classes of HTML that matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes audio video canvas datalist title".split()
)
UNSEEN_IN_DRAWING = frozenset("title desc metadata defs symbol annotation annotation-xml".split())
PREFORMATTED = frozenset("pre textarea xmp".split())
MUTE_INPUT = frozenset("hidden password checkbox radio file image color range".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = SPACED | frozenset(
    "html body address article aside details dialog dd div dt fieldset figcaption footer form header"
    " hgroup legend li main nav optgroup option section summary tbody td text tfoot th thead tr caption menu".split()
)
#: A start tag of the key ends an open element of the value, unless one of the fences is nearer.
ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th", "caption", "colgroup"),
    "td": ("td", "th", "caption"),
    "th": ("td", "th", "caption"),
    "thead": ("caption", "colgroup", "tr", "td", "th"),
    "tbody": ("thead", "caption", "colgroup", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "caption", "colgroup", "tr", "td", "th"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
    "body": ("head",),
}
FENCES = {
    "li": frozenset(("ul", "ol", "menu")),
    "dt": frozenset(("dl",)),
    "dd": frozenset(("dl",)),
    "option": frozenset(("select", "datalist")),
    "optgroup": frozenset(("select",)),
}
ENDS_P = BLOCK - frozenset("html body optgroup option caption td text th tr tbody thead tfoot".split())
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
DRAWING = re.compile(r"<(?:svg|math)\b", re.I)


class Node:
    """An element with its children, which are nodes and strings."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def shown(self) -> bool:
        if self.tag in UNSEEN or "hidden" in self.attributes:
            return False
        return not HIDING.search(self.attributes.get("style", ""))

    def visible(self, inherited: bool) -> bool:
        said = VISIBILITY.findall(self.attributes.get("style", ""))
        return said[-1].lower() not in ("hidden", "collapse") if said else inherited


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(value.strip("\"'")))
    return found


def tree(page: str) -> tuple[Node, str]:
    """The page's tree and its title."""
    root = Node("html", {})
    stack, title, at = [root], "", 0
    drawings = DRAWING.search(page) is not None

    def close(tags: tuple[str, ...], fences: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                del stack[depth:]
                return
            if stack[depth].tag in fences:
                return

    def add_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            close(("head",), frozenset())
        if text:
            stack[-1].children.append(unescape(text))

    while (token := TOKEN.search(page, at)) is not None:
        add_text(page[at : token.start()])
        at = token.end()
        ended, begun = token[1], token[2]
        if ended:
            tag = ended.lower()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if not begun:
            continue
        tag = begun.lower()
        attributes = attributes_of(token[3]) if token[3].strip(" /") else {}
        if tag in ("html", "body") and len(stack) == 1:
            root.attributes = attributes | root.attributes
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(("head",), frozenset())
        if tag in ENDS_P:
            close(("p",), frozenset(("td", "th", "table", "button", "object")))
        if tag in ENDS:
            fences = FENCES.get(tag, frozenset(("table",)))
            while any(n.tag in ENDS[tag] for n in reversed(_inner(stack, fences))):
                close(ENDS[tag], fences)
        if tag == "html":
            continue
        within = drawings and any(n.tag in ("svg", "math") for n in stack)
        if within and tag in UNSEEN_IN_DRAWING:
            attributes = attributes | {"hidden": ""}
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or (token[3].endswith("/") and (within or tag in ("svg", "math"))):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inside = page[at : stop.start() if stop else len(page)]
            at = stop.end() if stop else len(page)
            if tag == "title" and not within:
                title = title or SPACES.sub(" ", unescape(inside)).strip()
            elif tag == "textarea":
                node.children.append(unescape(inside))
            elif tag == "xmp":
                node.children.append(inside)
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    add_text(page[at:])
    return root, title


def _inner(stack: list[Node], fences: frozenset[str]) -> list[Node]:
    """The open elements above the nearest fence."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in fences:
            return stack[depth + 1 :]
    return stack[1:]


def without_hidden(node: Node, visible: bool = True) -> None:
    """Take what can't be seen out of a tree; cells keep their place."""
    children = []
    for child in node.children:
        if isinstance(child, str):
            if visible:
                children.append(child)
        elif child.shown():
            seen = child.visible(visible)
            without_hidden(child, seen)
            if seen or child.children or child.tag in ("td", "th"):
                children.append(child)
    node.children = children


class Page:
    """Lines of text that grow block by block."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.space = False

    def text(self, words: str) -> None:
        """Running text: white space collapses, also across elements."""
        flat = SPACES.sub(" ", words)
        if flat == " " or not flat:
            self.space |= bool(flat) and bool(self.line)
            return
        if self.line and (self.space or flat[0] == " "):
            self.line.append(" ")
        self.line.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self.put("".join(self.line))
        self.line, self.space = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line.rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced


def render(node: Node) -> list[str]:
    """The lines of a node's visible text."""
    page = Page()
    _render(node, page)
    page.end_line()
    return page.lines


def _indented(page: Page, mark: str, lines: list[str]) -> None:
    for i, line in enumerate(lines or [""]):
        page.put((mark if i == 0 else " " * len(mark)) + line if line or i == 0 else "")


def _render(node: Node, page: Page) -> None:
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
            continue
        tag = child.tag
        if tag == "br":
            if page.line:
                page.end_line()
            else:
                page.put("")
        elif tag == "hr":
            page.block(True)
        elif tag == "img":
            page.text(child.attributes.get("alt", ""))
        elif tag == "input":
            kind = child.attributes.get("type", "text").lower()
            if kind not in MUTE_INPUT or kind == "image":
                page.text(child.attributes.get("alt" if kind == "image" else "value", ""))
        elif tag in ("ul", "ol", "menu"):
            page.block(True)
            _list(child, page)
            page.block(True)
        elif tag == "table":
            page.block(True)
            for line in _table(child):
                page.put(line)
            page.block(True)
        elif tag in PREFORMATTED:
            page.block(True)
            for line in _raw(child).strip("\n").split("\n"):
                page.put(line)
            page.block(True)
        elif tag in ("blockquote", "dd"):
            page.block(tag in SPACED)
            _indented(page, "  ", render(child))
            page.block(tag in SPACED)
        elif tag in BLOCK:
            page.block(tag in SPACED)
            if tag == "optgroup":
                page.text(child.attributes.get("label", ""))
                page.end_line()
            _render(child, page)
            page.block(tag in SPACED)
        else:
            _render(child, page)


def _raw(node: Node) -> str:
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        else:
            parts.append(_raw(child))
    return "".join(parts)


def _list(node: Node, page: Page) -> None:
    start = node.attributes.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    loose = Node("li", {})
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            _indented(page, f"{number}. " if node.tag == "ol" else "- ", render(child))
            number += 1
        else:
            loose.children = [child]
            for line in render(loose):
                page.put(line)


def _span(cell: Node, name: str, most: int) -> int:
    given = cell.attributes.get(name, "1")
    return min(int(given), most) if re.fullmatch(r"[1-9]\d{0,4}", given) else 1


class Grid:
    """Rows of a table with their cells in columns; a cell of several rows keeps its columns free below it."""

    def __init__(self) -> None:
        self.rows: list[list[list[str]]] = []
        self.below: dict[int, int] = {}
        self.free = 256

    def section(self) -> None:
        """Cells don't reach beyond the rows of a thead, tbody or tfoot."""
        self.below = {}

    def add(self, cells: list[tuple[list[str], int, int]]) -> None:
        row: list[list[str]] = []
        below = {column: left - 1 for column, left in self.below.items() if left > 1}
        for lines, across, down in cells:
            while len(row) in self.below and self.free > 0:
                self.free -= 1
                row.append([])
            start = len(row)
            row.append(lines)
            self.free += EMPTY_PLACES
            across = 1 + min(across - 1, self.free)
            self.free -= across - 1
            row += [[]] * (across - 1)
            if down > 1:
                below |= {column: down - 1 for column in range(start, len(row))}
        self.rows.append(row)
        self.below = below if self.free > 0 else {}
        self.free -= len(self.below)

    def lines(self) -> list[str]:
        """The rows, padded to the widths of their columns."""
        widths: list[int] = []
        for row in self.rows:
            widths += [0] * (len(row) - len(widths))
            for i, cell in enumerate(row):
                fitting = [len(x) for x in cell if len(x) <= WIDEST]
                widths[i] = max(widths[i], *fitting, 0) if fitting else widths[i]
        out = []
        for row in self.rows:
            height = max(map(len, row), default=0)
            if height * len(row) > EMPTY_PLACES * sum(map(len, row)) + 256:
                out += [line for cell in row for line in cell]
                continue
            for n in range(height):
                parts = [(c[n] if n < len(c) else "").ljust(w) for c, w in zip(row, widths)]
                out.append(" | ".join(parts).rstrip())
        return out


def _table(node: Node) -> list[str]:
    """A table's caption, then its rows with cells in columns."""
    lines: list[str] = []
    grid = Grid()

    def gather(part: Node) -> None:
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    lines.append(SPACES.sub(" ", child).strip())
            elif child.tag in ("thead", "tbody", "tfoot"):
                grid.section()
                gather(child)
                grid.section()
            elif child.tag == "tr":
                cells = []
                for cell in child.children:
                    if not isinstance(cell, str):
                        cells.append((render(cell), _span(cell, "colspan", 100), _span(cell, "rowspan", 65534)))
                    elif cell.strip():
                        cells.append(([SPACES.sub(" ", cell).strip()], 1, 1))
                grid.add(cells)
            elif child.tag in ("td", "th"):
                grid.add([(render(child), 1, 1)])
            else:
                lines.extend(render(child))

    gather(node)
    return lines + grid.lines()


def extract(page: str | None) -> tuple[str, str]:
    """(title, text) of a page."""
    root, title = tree(page or "")
    without_hidden(root, root.visible(True))
    return title, "\n".join(render(root)).strip("\n")


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the markup, with title and text."""
    names = [f.name for f in pages.schema.fields if f.name not in (html, "title", "text")]
    added = [T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType([*(pages.schema[n] for n in names), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "title", "text"])

    return pages.select(*names, html).mapInArrow(run, schema)
