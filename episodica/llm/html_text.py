"""Operator 4, layout-aware text of HTML pages.

A tree builder with implied tags (paragraphs closed by blocks, list items, table rows and cells, options)
feeds a renderer that emits all visible text: blocks on lines of their own with blank lines where a browser leaves a margin or a line
break stands alone, lists with bullets or numbers and indents, preformatted text as it stands, and table cells in aligned columns.
Hidden are scripts, styles, the head, templates, embedded content and its fallbacks, closed dialogs, elements with the hidden attribute
or display:none, and text of visibility:hidden or collapse, which visibility:visible inside shows again. Texts of svg and math show but for
titles, descriptions, definitions and annotations. What stands in a table outside its cells comes before the table, as in browsers.

Cells keep their columns under row and column spans, and at least two spaces stand between cells. Lines of a cell that isn't in the
last column are broken between words after ``WIDE`` characters; a longer word, or a preformatted line, goes over its column's end and
moves the rest of its line. So padding is bounded and no text is lost.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do, never refused; elements
nested deeper than ``DEPTH`` become siblings, as in browsers; very long pages are read whole; repeated rows get equal texts; an
empty table gives no rows. Other columns pass through or are ignored; `text` replaces a column of that name.
"""

from __future__ import annotations

import re
import sys
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import read_table, slices

DEPTH = 512
WIDE = 60
#: The most columns and rows that a cell may span, by the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object video audio canvas datalist".split())
#: Not rendered inside svg or math; outside they are like any unknown element.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient annotation annotation-xml".split())
#: Inside svg or math, what holds HTML again.
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Elements with a blank line around them, and with a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address li dt dd tr caption form details summary figcaption legend option optgroup select thead tbody tfoot td th center dir search hgroup".split())
#: What a start tag closes first: these elements, up to one of those.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **{k: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
}
CLOSES_P = (SPACED | frozenset("div section article aside header footer nav main address form details summary figcaption center li dt dd dir search hgroup".split()))
#: An end tag doesn't look beyond these for its start.
SCOPE = {"td", "th", "table", "template"}
TABLE_PARTS = {"table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}

MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:-->|--!>|\Z))|<(?:[!?][^>]*|/[^a-zA-Z>][^>]*)(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
SPACES = re.compile(r"[ \t\r\n\f]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str) -> Node:
    root = Node("html")
    stack = [root]

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    def close(tags: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                for j in range(len(stack) - 1, 0, -1):  # and what it lies in, of the same kinds
                    if stack[j].tag in until:
                        return
                    if stack[j].tag in tags:
                        del stack[j:]
                return
            if stack[k].tag in until:
                return

    def foreign() -> bool:
        for open_node in reversed(stack):
            if open_node.tag in ("svg", "math"):
                return True
            if open_node.tag in HTML_AGAIN:
                return False
        return False

    at, end = 0, len(html)
    while at < end:
        m = MARKUP.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in TABLE_PARTS:
                    break
            continue
        if tag in ("html", "body"):
            close({"head"}, set())
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "li", "dd", "dt", "div", "section", "article", "blockquote"})
        if stack[-1].tag == "head" and tag in BLOCK:
            del stack[-1:]
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attributes(m[3]) if m[3].strip() else None)
        stack[-1].children.append(node)
        if tag in UNDRAWN and foreign():
            node.attributes["hidden"] = ""
        if m[3].endswith("/") and (tag in ("svg", "math") or foreign()):
            continue
        if tag in RAW:
            stop = RAW_END[tag].search(html, at)
            body = html[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            if tag == "textarea" or tag == "xmp":
                node.children.append(unescape(body) if tag == "textarea" else body)
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root


def style(node: Node, name: str) -> str:
    """The last value that the style attribute gives a property."""
    given = node.attributes.get("style") if node.attributes else None
    values = [m[2].lower() for m in DECLARATION.finditer(given) if m[1].lower() == name] if given else ()
    return values[-1] if values else ""


def hidden(node: Node) -> bool:
    if node.tag in HIDDEN or node.tag == "input" or (node.tag == "dialog" and "open" not in node.attributes):
        return True
    return bool(node.attributes) and ("hidden" in node.attributes or style(node, "display") == "none")


def shown(node: Node, around: bool) -> bool:
    """Whether an element's own text is visible; what it doesn't say itself is as around it."""
    said = style(node, "visibility")
    return around if said in ("", "inherit") else said not in ("hidden", "collapse")


class Page:
    """Lines of text; inline text gathers until a line ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent = ""
        self.mark = ""
        self.gap = False
        self.breaks = 0  # line breaks that stand alone since the last line

    def write(self, s: str, pre: bool) -> None:
        if pre:
            head, *more = s.split("\n")
            self.inline.append(head)
            for line in more:
                self.end(True)
                self.inline.append(line)
        else:
            self.inline.append(SPACES.sub(" ", s))

    def end(self, pre: bool = False) -> bool:
        """Close the line; whether there was one."""
        line = "".join(self.inline)
        self.inline = []
        line = line.rstrip() if pre else SPACES.sub(" ", line).strip(" ")
        if line:
            self.put(line)
        elif pre and self.lines:
            self.breaks += 1
        return bool(line)

    def broken(self, pre: bool) -> None:
        if not self.end(pre) and not pre:
            self.breaks += 1

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * max(self.breaks, 1 if self.gap and self.lines[-1] else 0)
        self.gap, self.breaks = False, 0
        self.lines.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark + line if self.mark else self.indent + line)
        self.mark = ""

    def space(self) -> None:
        self.end()
        self.gap = True


def _number(s: str | None, other: int) -> int:
    return int(s) if s and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", s) else other


def unfolded(node: Node) -> list:
    """What shows of an element's children: of closed details the first summary alone."""
    if node.tag != "details" or "open" in node.attributes:
        return node.children
    return [c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]


def label(node: Node) -> str:
    """What a button made as an input says; other inputs hold what a reader would type."""
    return node.attributes.get("value") or "" if node.attributes and (node.attributes.get("type") or "").lower() in ("submit", "button", "reset") else ""


def render(node: Node, page: Page, pre: bool = False, seen: bool = True) -> None:
    number = _number(node.attributes.get("start"), 1) if node.tag == "ol" else 0
    for child in unfolded(node):
        if isinstance(child, str):
            if seen:
                page.write(child, pre)
            continue
        tag = child.tag
        if tag == "br":
            page.broken(pre)
            continue
        if tag == "input" and label(child) and "hidden" not in child.attributes and style(child, "display") != "none" and shown(child, seen):
            page.write(f" {label(child)} ", False)
        if hidden(child):
            continue
        visible = shown(child, seen)
        if tag not in BLOCK:
            apart = tag == "text" and node.tag in ("svg", "g")
            if apart:
                page.write(" ", False)
            render(child, page, pre or tag in ("textarea", "xmp"), visible)
            if apart:
                page.write(" ", False)
            continue
        if tag == "table":
            page.space()
            for line in table(child, visible):
                page.put(line) if line else page.lines.append("")
            page.space()
            continue
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and page.indent)
        page.space() if spaced else page.end(pre)
        before, mark = page.indent, page.mark
        if tag == "li":
            number = _number(child.attributes.get("value"), number) if node.tag == "ol" else 0
            page.mark = f"{number}. " if node.tag == "ol" else "- "
            page.indent += " " * len(page.mark)
            number += 1
        elif tag in ("blockquote", "dd"):
            page.indent += "  "
        render(child, page, pre or tag == "pre", visible)
        page.space() if spaced else page.end(pre)
        page.indent = before
        if tag == "li":
            page.mark = mark


class Rows:
    """What a table holds: its head's, body's and foot's rows of (cell, visible), captions, and what stands outside of both."""

    def __init__(self):
        self.parts: dict[str, list[list[tuple[Node, bool]]]] = {"thead": [], "tbody": [], "tfoot": []}
        self.captions: list[tuple[Node, bool]] = []
        self.loose = Node("div")

    def collect(self, node: Node, seen: bool, part: str = "tbody", row: list | None = None, shut: bool = False) -> None:
        """A form in a table is empty for browsers, so what lies in it is the table's; text of hidden rows (shut) moves out and shows."""
        for child in node.children:
            loose = self.loose.children
            if isinstance(child, str):
                if seen and (child.strip() or loose):
                    loose.append(child)
                continue
            tag = child.tag
            if tag in ("form", "colgroup"):
                self.collect(child, seen, part, row, shut)
            elif tag in ("thead", "tbody", "tfoot"):
                self.collect(child, shown(child, seen), tag, None, shut or hidden(child))
            elif tag == "tr":
                own: list = []
                if not shut and not hidden(child):
                    self.parts[part].append(own)
                self.collect(child, shown(child, seen), part, own, shut or hidden(child))
            elif hidden(child) or tag == "col":
                continue
            elif tag in ("td", "th"):
                if row is None:
                    row = []
                    if not shut:
                        self.parts[part].append(row)
                row.append((child, shown(child, seen)))
            elif tag == "caption":
                if not shut:
                    self.captions.append((child, shown(child, seen)))
            elif seen:
                loose.append(child)
            else:
                around = Node("div" if tag in BLOCK else "span", {"style": "visibility:hidden"})
                around.children.append(child)
                loose.append(around)
            if loose and tag in ("form", "thead", "tbody", "tfoot", "tr"):
                loose.append(" ")


def place(rows: list[list[tuple[Node, bool]]]) -> list[list[tuple[int, int, Node, bool]]]:
    """Each row's cells with their first column and the one after their last; spans of rows end with the rows given."""
    held: list[tuple[int, int, int]] = []  # (first column, column after, rows left) of cells from rows above
    out = []
    for k, row in enumerate(rows):
        held = [(a, b, n - 1) for a, b, n in held if n > 1]
        taken, cells, at, own = sorted((a, b) for a, b, _ in held), [], 0, []
        for cell, visible in row:
            while taken and taken[0][0] <= at:
                at = max(at, taken.pop(0)[1])
            wide = max(1, min(MOST_COLUMNS, _number(cell.attributes.get("colspan"), 1)))
            high = min(MOST_ROWS, max(0, _number(cell.attributes.get("rowspan"), 1))) or len(rows)
            cells.append((at, at + wide, cell, visible))
            if high > 1:
                own.append((at, at + wide, min(high, len(rows) - k)))
            at += wide
        held += own
        out.append(cells)
    return out


def wrapped(line: str, wide: int = WIDE) -> list[str]:
    """The line broken between words where it is longer; a longer word stays whole."""
    out, rest = [], line
    while len(rest) > wide:
        at = rest.rfind(" ", 1, wide + 1)
        at = rest.find(" ", wide) if at < 0 or not rest[:at].strip() else at
        if at < 0:
            break
        out.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [*out, rest] if rest or not out else out


def _preformatted(node: Node) -> bool:
    return node.tag in ("pre", "textarea", "xmp") or any(_preformatted(c) for c in node.children if not isinstance(c, str))


def table(node: Node, seen: bool = True) -> list[str]:
    held = Rows()
    held.collect(node, seen)
    out = lines_of(held.loose)
    for caption, visible in held.captions:
        out += lines_of(caption, visible)
    grid = [cells for part in ("thead", "tbody", "tfoot") for cells in place(held.parts[part])]
    edges = sorted({x for cells in grid for a, b, _, _ in cells for x in (a, b)} | {0})
    number = {x: k for k, x in enumerate(edges)}
    last = len(edges) - 1
    texts, spans = [], []
    for cells in grid:
        row = []
        for a, b, cell, visible in cells:
            lines = lines_of(cell, visible) or [""]
            if number[b] < last and max(map(len, lines)) > WIDE and not _preformatted(cell):
                lines = [part for line in lines for part in wrapped(line)]
            row.append((number[a], number[b], lines))
            spans.append((number[b] - number[a], number[a], number[b], min(WIDE, max(map(len, lines)))))
        texts.append(row)
    width = [0] * max(1, last)
    for _, a, b, need in sorted(spans):
        lack = need - (sum(width[a:b]) + 2 * (b - a - 1))
        if lack > 0:
            width[b - 1] += lack
    start = [0]
    for w in width:
        start.append(start[-1] + w + 2)
    for row in texts:
        drawn = []
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for a, _, lines in row:
                if own := lines[k] if k < len(lines) else "":
                    line = line.ljust(start[a]) if not line or len(line) + 2 <= start[a] else line + "  "
                    line += own
            drawn.append(line)
        while drawn and not drawn[-1].strip():
            drawn.pop()
        out += drawn
    return out


def lines_of(node: Node, seen: bool = True) -> list[str]:
    page = Page()
    render(node, page, seen=seen)
    page.end()
    return page.lines


def to_text(html: str | None) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))
    page = Page()
    render(parse(html or ""), page)
    page.end()
    return "\n".join(page.lines).strip("\n")


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """pages' columns `keep` and text."""
    keep = [c for c in keep if c.lower() != "text"]
    source = pages.select(*dict.fromkeys([*keep, html]))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html):
                text = pa.array([to_text(x) for x in batch.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text], names=[*keep, "text"])

    return source.mapInArrow(run, schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"])
