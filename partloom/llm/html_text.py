"""Visible text of HTML pages with the layout of blocks, lists and tables."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes datalist object audio video canvas title rp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks with a blank line before and after them, and those without.
SPACED = frozenset("p ul ol dl pre blockquote table figure menu dir".split()) | HEADINGS
BLOCKS = SPACED | frozenset(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup hr legend "
    "li main nav optgroup option search section summary tr td th thead tbody tfoot caption noscript".split()
)
CLOSES_P = (BLOCKS - frozenset("html body tr td th thead tbody tfoot caption li dt dd option optgroup legend".split())) | {"hr"}
#: An open element of the first kind ends when a tag of the second comes, unless an element of the third lies between.
IMPLIED_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"table"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    **{
        name: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset({"table"}))
        for name in ("thead", "tbody", "tfoot", "colgroup", "caption")
    },
}
SECTIONS = frozenset({"thead", "tbody", "tfoot"})
CELLS = frozenset({"td", "th"})
#: An end tag does not close elements beyond these.
SCOPES = frozenset("td th caption table template".split())
#: Columns are aligned up to this width; longer cells are kept whole and stand out.
WIDEST = 60
#: FIXED VALUES: the largest spans of HTML.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[\"'=])*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str]
    visible: bool = True
    children: list = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    if not source.strip():
        return {}
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def _visible(tag: str, attributes: dict[str, str]) -> bool:
    if tag in UNSEEN or "hidden" in attributes:
        return False
    if tag == "dialog" and "open" not in attributes:
        return False
    return not ("style" in attributes and _INVISIBLE.search(attributes["style"]))


def build(source: str) -> Node:
    """The tree of a page, with the end tags and table parts that HTML lets authors leave out."""
    root = Node("#root", {})
    stack = [root]
    open_tags: Counter[str] = Counter()

    def pop_to(index: int) -> None:
        open_tags.subtract(node.tag for node in stack[index:])
        del stack[index:]

    def find(names: frozenset[str], until: frozenset[str]) -> int | None:
        if not any(open_tags[name] > 0 for name in names):
            return None  # so that a deep page of tags left open is not searched again and again
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in until:
                return None
        return None

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes, _visible(tag, attributes))
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_tags[tag] += 1

    def start(tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            at = find(frozenset({"head"}), frozenset())
            if at is not None:
                pop_to(at)
            if not _visible(tag, attributes):
                push(tag, attributes)
            return
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "template", "noscript"):
            pop_to(-1)
        if tag in CLOSES_P:
            at = find(frozenset({"p"}), SCOPES)
            if at is not None:
                pop_to(at)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop_to(-1)
        if tag in IMPLIED_ENDS:
            names, until = IMPLIED_ENDS[tag]
            while (at := find(names, until)) is not None:
                pop_to(at)
        if tag == "a" and (at := find(frozenset({"a"}), SCOPES | BLOCKS)) is not None:
            pop_to(at)
        if tag in CELLS and stack[-1].tag in SECTIONS | {"table"}:
            push("tr", {})
        push(tag, attributes)

    def end(tag: str) -> None:
        if tag == "br":
            push("br", {})
        elif tag not in ("html", "body"):
            crossing = SCOPES
            if tag == "table":
                crossing = frozenset({"template"})
            elif tag in SECTIONS | CELLS | {"tr", "caption"}:
                crossing = frozenset({"table"})
            at = find(frozenset({tag}) if tag not in HEADINGS else HEADINGS, crossing)
            if at is not None:
                pop_to(at)

    def text(piece: str) -> None:
        if not piece:
            return
        here = stack[-1]
        if here.tag == "head" and not piece.isspace():
            pop_to(-1)
            here = stack[-1]
        here.children.append(piece)

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            text(html.unescape(source[at:]))
            break
        if found.start() > at:
            text(html.unescape(source[at : found.start()]))
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        if found[1]:
            end(tag)
            continue
        start(tag, _attributes(found[3]))
        if tag in RAW and stack[-1].tag == tag:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            content = source[at : close.start() if close else size]
            text(html.unescape(content) if tag in ("title", "textarea") else content)
            pop_to(-1)
            at = close.end() if close else size
    return root


class Layout:
    """Collects lines: inline text joins the line, blocks start new ones, and margins do not add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.first = self.rest = ""  # what stands before the next line, and before those after it

    def put(self, text: str, kept: bool = False) -> None:
        if kept:
            head, *more = text.replace("\r\n", "\n").split("\n")
            self.parts.append(head)
            for line in more:
                self.new_line()
                self.parts.append(line)
            return
        text = _BLANKS.sub(" ", text)
        if text.startswith(" ") and (not self.parts or self.parts[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.parts.append(text)

    def new_line(self) -> None:
        """End the line, also an empty one."""
        self._emit("".join(self.parts))
        self.parts = []

    def _emit(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(f"{self.first}{line}".rstrip())
        self.first = self.rest

    def flush(self) -> None:
        if self.parts:
            line = "".join(self.parts)
            self.parts = []
            if line.strip(" \n"):
                self._emit(line.rstrip(" "))

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap |= spaced and bool(self.lines)


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(found[1]) if found else default


def _span(node: Node, name: str, most: int) -> int:
    return min(max(_number(node.attributes.get(name), 1), 1), most)


def _unwound(task: Generator):
    """Run functions that yield their calls of one another, with a stack of their own: no page is too deep."""
    stack, value = [task], None
    while stack:
        try:
            task, value = stack[-1].send(value), None
            stack.append(task)
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _block(node: Node, kept: bool, depth: int) -> Generator:
    """The lines of the content of a node."""
    inner = Layout()
    yield _children(node, inner, kept, depth)
    inner.flush()
    return inner.lines


def _children(node: Node, out: Layout, kept: bool, depth: int) -> Generator:
    for child in node.children:
        if isinstance(child, str):
            out.put(child, kept)
        elif child.visible:
            yield _render(child, out, kept, depth)


def _indented(out: Layout, lines: list[str], mark: str, rest: str) -> None:
    before = out.first, out.rest
    out.first, out.rest = before[0] + mark, before[1] + rest
    for line in lines:
        out._emit(line)
    out.first, out.rest = (before[1] if lines else before[0]), before[1]


def _list(node: Node, out: Layout, kept: bool, depth: int) -> Generator:
    ordered, number = node.tag == "ol", _number(node.attributes.get("start"), 1)
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.put(child, kept)
            continue
        if not child.visible:
            continue
        if child.tag != "li":
            yield _render(child, out, kept, depth)
            continue
        out.flush()
        number = _number(child.attributes.get("value"), number)
        mark = f"{number}. " if ordered else "- "
        number += 1
        _indented(out, (yield _block(child, kept, depth)) or [""], mark, " " * len(mark))


def _rows(node: Node) -> tuple[list[list[Node]], list[Node]]:
    """Rows of cells of a table, head first and foot last, and what else is in it."""
    head, body, foot, rest = [], [], [], []

    def add(owner: Node, to: list) -> None:
        for child in owner.children:
            if isinstance(child, str):
                if child.strip():
                    rest.append(Node("#text", {}, True, [child]))
            elif not child.visible:
                continue
            elif child.tag in SECTIONS and owner is node:
                add(child, {"thead": head, "tfoot": foot}.get(child.tag, body))
            elif child.tag == "tr":
                cells = [c for c in child.children if isinstance(c, Node) and c.visible]
                rest.extend(Node("#text", {}, True, [c]) for c in child.children if isinstance(c, str) and c.strip())
                rest.extend(c for c in cells if c.tag not in CELLS)
                to.append([c for c in cells if c.tag in CELLS])
            elif child.tag not in ("colgroup", "col"):
                rest.append(child)

    add(node, body)
    return [*head, *body, *foot], rest


def _table(node: Node, out: Layout, depth: int) -> Generator:
    rows, rest = _rows(node)
    for other in rest:  # captions, and content that stands outside of cells
        out.flush()
        yield _children(other, out, False, depth)
    out.flush()
    placed: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # column: rows that a cell above still covers
    widths: dict[int, int] = {}
    for row in rows:
        at, line = 0, {}
        covered = {c for c, left in taken.items() if left > 0}
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        for cell in row:
            while at in covered:
                at += 1
            lines, wide, deep = (yield _block(cell, False, depth + 1)), _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
            line[at] = (lines, wide)
            if wide == 1:
                own = max((len(x) for x in lines), default=0)
                widths[at] = max(widths.get(at, 0), min(own, WIDEST))
            if deep > 1:
                taken.update(dict.fromkeys(range(at, at + wide), deep - 1))
            at += wide
        placed.append(line)
    columns = max((max(line) for line in placed if line), default=-1) + 1
    for line in placed:
        height = max((len(lines) for lines, _ in line.values()), default=0)
        for i in range(height):
            shown, skip = [], 0
            for column in range(columns):
                if skip:
                    skip -= 1
                    continue
                lines, wide = line.get(column, ([], 1))
                skip = min(wide, columns - column) - 1
                room = sum(widths.get(c, 0) for c in range(column, column + skip + 1)) + 3 * skip
                shown.append((lines[i] if i < len(lines) else "").ljust(room))
            out._emit(" | ".join(shown))


def _render(node: Node, out: Layout, kept: bool, depth: int) -> Generator:
    tag = node.tag
    if tag == "br":
        out.new_line()
    elif tag == "hr":
        out.block(True)
    elif tag == "input":
        if node.attributes.get("type", "text").lower() in ("text", "button", "submit", "reset", "search", "email", "url"):
            out.put(node.attributes.get("value", ""))
    elif tag not in BLOCKS:
        if tag == "wbr" or not node.children:
            return
        yield _children(node, out, kept or tag == "textarea", depth)
    else:
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and depth > 0)
        out.block(spaced)
        if tag in ("ul", "ol", "menu", "dir"):
            yield _list(node, out, kept, depth + 1)
        elif tag == "table":
            yield _table(node, out, depth)
        elif tag == "blockquote":
            _indented(out, (yield _block(node, kept, depth)), "> ", "> ")
        elif tag == "dd":
            _indented(out, (yield _block(node, kept, depth)), "  ", "  ")
        elif tag == "pre":
            first = node.children[0] if node.children else None
            if isinstance(first, str) and first.startswith("\n"):
                node.children[0] = first[1:]
            yield _children(node, out, True, depth)
            if out.parts and not "".join(out.parts).strip():
                out.parts = []
        else:
            yield _children(node, out, kept, depth)
        out.block(spaced)


def visible_text(source: str | None) -> str:
    """All visible text of a page, laid out in lines."""
    if not source:
        return ""
    return "\n".join(_unwound(_block(build(source.replace("\0", "�")), False, 0))).strip("\n")


def extract(pages: DataFrame, page_id: str = "page_id", source: str = "html", out: str = "text") -> DataFrame:
    """(page_id, text): all visible text of every page.

    A tree is built with implied end tags (paragraphs, list items, definition lists, options, table parts) and implied
    table rows.  Not visible are the head, scripts, styles, templates, media fallbacks, closed dialogs, elements with
    ``hidden``, and those whose inline style hides them.  Blocks stand on lines of their own, with one blank line around
    paragraphs, headings, lists, tables and the like; list items have marks and are indented; cells of a table
    are aligned, with spans; preformatted text keeps its blanks.  No visible text is left out, however long.

    A null or empty page has an empty text.  Identifiers may be null or repeated: every row gives one row.  Tags left
    open, stray end tags, deep nesting and text outside of cells are all rendered.  An empty table gives an empty
    result.  Further columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(source).alias("html"))
    schema = T.StructType([rows.schema["page_id"], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [visible_text(v.as_py()) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], schema.fieldNames())

    return rows.mapInArrow(run, schema)
