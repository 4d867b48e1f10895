"""Layout-aware text of HTML pages.

A tokeniser and a tree builder with implied tags (paragraphs, list items, table
rows and cells end where HTML says they do) feed a renderer that leaves out what a
browser does not show and keeps the layout: blank lines around paragraphs, headings
and lists, one line for other blocks, markers and indents in lists, aligned columns
in tables, white space as written in preformatted text.

Null page: null. Empty page or one without visible text: empty text. Malformed
markup never fails: stray tags are skipped, open elements end with the page, elements
may be nested to any depth, and numbers that are none of at most nine digits count as
not given. What stands in a table outside its cells is shown before it. Three layout
rules bound the text's size and lose nothing of it: lists are indented up to INDENTS
levels, cells of tables within more than TABLES others stand one below another, and
the columns of a table are aligned only where that takes at most PADDING times its own
characters. Null ids and repeated rows are kept; empty table: no rows. Only the two
named columns are read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calstack.llm.common import small_batches

INDENTS, TABLES, PADDING = 40, 32, 64
#: The greatest spans of a cell.
COLUMNS, ROWS = 1000, 65534
#: Element names of HTML by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title meta link template noscript iframe noembed noframes object audio video canvas svg math datalist area param source track base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup li main nav section summary caption thead tbody tfoot tr legend search optgroup option select textarea".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: A tag and the open elements that it ends, up to the nearest of a scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that an end tag of something outside them does not reach across.
WALLS = {"td", "th", "table", "caption", "body", "html"}

#: Comments, declarations, and tags: quoted values whole if the quotes are paired, else up to the next ">".
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|</?([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
INTEGER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
#: Numbers of characters that no character has.
NO_CHARACTER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def unescaped(text: str) -> str:
    return html.unescape(NO_CHARACTER.sub("\ufffd", text)) if "&" in text else text


def integer(text: str | None, default: int, least: int, most: int) -> int:
    found = INTEGER.match(text or "")
    return min(most, max(least, int(found[1]))) if found else default


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        value = value[1:-1] if value[:1] in ('"', "'") and value[-1:] == value[:1] else value
        found.setdefault(name.lower(), unescaped(value))
    return found


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, raw, start, empty or end."""
    at, last = 0, page.rfind(">")
    while True:
        m = TOKEN.search(page, at) if at <= last else None
        text = page[at : m.start() if m else len(page)]
        if text:
            yield "text", text, ""
        if not m:
            return
        at = m.end()
        if not m[1]:
            continue
        name = m[1].lower()
        if m[0][1] == "/":
            yield "end", name, ""
            continue
        source = m[2] if m[2] is not None else m[3]
        yield ("empty" if source.endswith("/") and name in ("svg", "math") else "start"), name, source.removesuffix("/")
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at, last + 1)
            yield "raw", page[at : close.start() if close else len(page)], ""
            yield "end", name, ""
            at = close.end() if close else len(page)


def tree(page: str) -> Node:
    root = Node("#root", {})
    open_ = [root]
    at: dict[str, list[int]] = defaultdict(list)  # places of the open elements by name

    def last(names: set[str] | frozenset[str]) -> int:
        """The innermost open element of these names, or the root."""
        return max((at[n][-1] for n in names if at.get(n)), default=0)

    def cut(i: int) -> None:
        while len(open_) > i:
            at[open_.pop().tag].pop()

    def close(names: set[str], scope: set[str]) -> None:
        """Ends the open elements of these names that stand inside the nearest scope."""
        while (i := last(names)) > last(scope):
            cut(i)

    def push(name: str, source: str, stays: bool) -> None:
        if open_[-1].tag == "head" and name not in IN_HEAD:
            cut(len(open_) - 1)
        if name in CLOSES_P:
            close({"p"}, WALLS | {"button"})
        if name in ENDS:
            close(*ENDS[name])
        top = open_[-1].tag
        if name == "tr" and top == "table":
            push("tbody", "", True)
        elif name in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
            push("tr", "", True)
        node = Node(name, attributes(source))
        open_[-1].children.append(node)
        if name == "form" and open_[-1].tag in ("table", "thead", "tbody", "tfoot", "tr"):
            return  # holds nothing there: the cells after it are the row's
        if stays:
            at[name].append(len(open_))
            open_.append(node)

    for kind, value, source in tokens(page):
        if kind == "text":
            if open_[-1].tag == "head" and not value.isspace():
                cut(len(open_) - 1)
            open_[-1].children.append(unescaped(value))
        elif kind == "raw":
            open_[-1].children.append(unescaped(value) if open_[-1].tag in ("textarea", "title") else value)
        elif kind == "end":
            if value == "p" and not at["p"]:
                push("p", "", True)
            walls = WALLS
            if value in ("tr", "tbody", "thead", "tfoot"):
                walls = {"table", "body", "html"}
            elif value in ("table", "body", "html"):
                walls = set()
            if at.get(value) and at[value][-1] >= last(walls):
                cut(at[value][-1])
        else:
            push(value, source, kind == "start" and value not in VOID)
    return root


def styles(node: Node) -> dict[str, str]:
    """The declarations of a style attribute, the last of each property."""
    made = {}
    for part in COMMENT.sub(" ", node.attributes.get("style", "")).split(";"):
        name, _, value = part.partition(":")
        made[name.strip().lower()] = value.lower().replace("!important", "").strip()
    return made


def shown(node: Node) -> bool:
    """Whether an element has a place on the page, visible or not."""
    if node.tag in HIDDEN:
        return False
    own = node.attributes
    if not own:
        return True
    if "hidden" in own or (node.tag == "input" and own.get("type", "").lower() == "hidden"):
        return False
    return not (node.tag == "dialog" and "open" not in own) and not ("style" in own and styles(node).get("display") == "none")


def visible(node: Node, before: bool) -> bool:
    """Whether text in an element is seen; unlike a place, a child can win it back."""
    if "style" not in node.attributes:
        return before
    value = styles(node).get("visibility")
    return before if value in (None, "", "inherit") else value not in ("hidden", "collapse")


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text that grow word by word and break by break."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent: list[str] = []
        self.marker = ""

    def word(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.put(first)
            for part in rest:
                self.end(True)
                self.put(part)
            return
        parts = SPACES.split(text)
        for i, part in enumerate(parts):
            if i:
                self.space = bool(self.line)
            self.put(part)

    def put(self, part: str) -> None:
        if part:
            if self.space:
                self.line.append(" ")
            self.line.append(part)
            self.space = False

    def end(self, always: bool = False) -> None:
        """Ends the line; an empty one counts only if `always`."""
        if self.line or always:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indent[:INDENTS])
            if self.marker:
                lead, self.marker = (lead[: len(lead) - len(self.marker)] if len(self.indent) <= INDENTS else lead) + self.marker, ""
            self.lines.append((lead + "".join(self.line)).rstrip())
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = True


def groups(table: Node) -> Iterator[list[Node]]:
    """The rows of a table by group, in the order that they are shown in."""
    parts: dict[str, list[list[Node]]] = {"thead": [], "tbody": [], "tfoot": []}
    for child in table.children:
        if isinstance(child, Node) and shown(child):
            if child.tag == "tr":
                parts["tbody"].append([child])
            elif child.tag in parts:
                parts[child.tag].append([c for c in child.children if isinstance(c, Node) and c.tag == "tr" and shown(c)])
    for part in parts.values():
        yield from part


def strays(table: Node) -> Iterator[tuple[Node | str, Node]]:
    """What stands in a table, a row group or a row but in no cell, each with what it
    stands in; it is shown before the table."""
    todo: list[tuple[Node | str, Node]] = [(c, table) for c in reversed(table.children)]
    while todo:
        child, inside = todo.pop()
        if isinstance(child, str):
            if not child.isspace():
                yield child, inside
        elif child.tag in ("thead", "tbody", "tfoot", "tr"):
            if shown(child):
                todo += [(c, child) for c in reversed(child.children)]
        elif child.tag not in ("colgroup", "col") and not (inside.tag == "tr" and child.tag in ("td", "th")):
            yield child, inside


#: A call that may be nested to any depth: it yields further calls and gets their values.
Call = Generator["Call", object, object]


def called(call: Call) -> object:
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def table_lines(table: Node, depth: int, seen: bool) -> Call:
    """Cells side by side, columns padded to their widest cell; a cell takes the room
    of all columns that it spans, and keeps its columns free in the rows below it."""
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, the one behind it, lines)
    for group in groups(table):
        below: list[list[int]] = []  # [column, the one behind it, rows left] of spans from above
        for row in group:
            cells, at, new, over = [], 0, [], sorted(below)
            in_row = visible(row, seen)
            for cell in row.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th") and shown(cell):
                    while over and over[0][0] <= at:
                        at = max(at, over.pop(0)[1])
                    lines = yield render(cell, depth + 1, in_row)
                    stop = at + integer(cell.attributes.get("colspan"), 1, 1, COLUMNS)
                    cells.append((at, stop, lines or [""]))
                    if (more := integer(cell.attributes.get("rowspan"), 1, 0, ROWS)) != 1:
                        new.append([at, stop, (more or ROWS) - 1])
                    at = stop
            below = [[a, b, n - 1] for a, b, n in below if n > 1] + new
            if cells:
                grid.append(cells)
    columns = sorted({a for cells in grid for a, _, _ in cells})
    place = {a: i for i, a in enumerate(columns)}
    widths = [0] * len(columns)
    aligned: list[list[tuple[int, int, list[str]]]] = []
    for cells in grid:
        aligned.append([])
        for k, (a, b, lines) in enumerate(cells):
            first, stop = place[a], place[a] + 1
            limit = place[cells[k + 1][0]] if k + 1 < len(cells) else len(columns)
            while stop < limit and columns[stop] < b:
                stop += 1
            aligned[-1].append((first, stop, lines))
            if stop == first + 1:
                widths[first] = max(widths[first], max(map(width, lines)))
    edges = [0]
    for w in widths:
        edges.append(edges[-1] + w + 3)
    own = sum(len(x) + 3 for cells in grid for _, _, lines in cells for x in lines)
    padded = sum(edges[cells[-1][1]] * max(len(lines) for _, _, lines in cells) for cells in aligned) <= PADDING * own + 4096
    out = []
    for cells in aligned:
        for k in range(max(len(lines) for _, _, lines in cells)):
            at, parts = 0, []
            for first, stop, lines in cells:
                text = lines[k] if k < len(lines) else ""
                if padded:
                    parts += [" " * w for w in widths[at:first]]
                    text += " " * (edges[stop] - edges[first] - 3 - width(text))
                parts.append(text)
                at = stop
            out.append(" | ".join(parts).rstrip(" ") if len(parts) > 1 else parts[0].rstrip())
    return out


def render(root: Node, depth: int = 0, seen: bool = True) -> Call:
    """Lines of the visible text under a node, which stands in so many tables."""
    page = Page()

    def walk(node: Node, pre: bool, lists: int, seen: bool) -> Call:
        seen = visible(node, seen)
        number = integer(node.attributes.get("start"), 1, -(10**9), 10**9) - 1 if node.tag == "ol" else 0
        for child in node.children:
            if isinstance(child, str):
                if seen and not (node.tag in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "dl") and child.isspace()):
                    page.word(child, pre)
                continue
            tag = child.tag
            if not shown(child):
                continue
            if tag == "br":
                page.end(True)
            elif tag == "hr":
                page.gap()
                if visible(child, seen):
                    page.put("---")
                page.gap()
            elif tag == "table" and depth < TABLES:
                page.gap()
                in_table = visible(child, seen)
                for part, inside in strays(child):
                    alone = Node("div", {})
                    alone.children.append(part)
                    yield walk(alone, False, lists, in_table if inside is child else visible(inside, in_table))
                    page.end()
                lines = yield table_lines(child, depth, in_table)
                for line in lines:
                    page.put(line)
                    page.end(True)
                page.gap()
            elif tag == "li":
                page.end()
                if node.tag == "ol":
                    number = integer(child.attributes.get("value"), number + 1, -(10**9), 10**9)
                mark = f"{number}. " if node.tag == "ol" else "- "
                page.indent.append(" " * len(mark))
                page.marker = mark if visible(child, seen) else ""
                yield walk(child, pre, lists, seen)
                page.end()
                page.marker = ""
                page.indent.pop()
            elif tag in BLOCK:
                inner = tag in ("ul", "ol", "menu") and lists
                page.gap() if tag in SPACED and not inner and not page.marker else page.end()
                if tag in ("dd", "blockquote"):
                    page.indent.append("  ")
                yield walk(child, pre or tag in ("pre", "textarea"), lists + (tag in ("ul", "ol", "menu")), seen)
                if tag in ("dd", "blockquote"):
                    page.end()
                    page.indent.pop()
                page.gap() if tag in SPACED and not inner else page.end()
            else:
                if tag in ("td", "th"):
                    page.space = bool(page.line)
                yield walk(child, pre, lists, seen)

    yield walk(root, root.tag == "pre", 0, seen)
    page.end()
    return page.lines


def text_of(page: str | None) -> str | None:
    return None if page is None else "\n".join(called(render(tree(page))))


def rendered(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text): the visible text of every page."""
    small_batches(pages.sparkSession)
    rows_ = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(p.as_py()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows_.mapInArrow(run, f"id {rows_.schema['id'].dataType.simpleString()}, text string")
