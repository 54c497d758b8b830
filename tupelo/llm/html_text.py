"""HTML to text as a reader sees it.

A lenient tokenizer feeds a tree builder that supplies the tags authors leave out (a paragraph ends
where a block begins, an item where the next begins, cells belong to rows) and drops end tags that
close nothing. What a browser wouldn't show is left out: scripts, styles, the head, templates,
elements that are hidden by attribute or by their own style (one whose visibility is hidden may hold
one that is visible), closed details, media that browsers play in place of their content. The rest
is laid out in lines: blocks on lines of their own, with a blank line around paragraphs, headings,
lists and tables; list items with their bullet or number and hanging indents; preformatted text as
it is; table cells in aligned columns, spans included. Padding is bounded: a column is padded to
WIDEST at most, and a line to LONGEST, beyond which cells follow each other two spaces apart.

No step recurses, and as in browsers elements nest at most MOST_DEPTH deep: deeper ones become
siblings, no text is lost, and what a hidden one holds stays hidden up to its end.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import own_columns, ship

MOST_DEPTH = 400
WIDEST, LONGEST = 100, 300
#: Columns of a table that are told apart: as each takes three places at least, more can't be aligned within a line.
COLUMNS = 128

# Elements by their kind in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noembed noframes iframe datalist title meta link base video audio canvas area param source track rp defs desc metadata symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 listing menu ol p pre table ul xmp".split())
ENDS_PARAGRAPH = BLOCK - frozenset("body caption html legend li optgroup option tbody td tfoot th thead tr".split()) | {"li"}
PARAGRAPH_SCOPE = frozenset("applet button caption html marquee object table td template th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
#: An element that begins ends these, as far up as the elements of the third column.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), LISTS | PARAGRAPH_SCOPE),
    "dt": (frozenset(["dt", "dd"]), PARAGRAPH_SCOPE | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), PARAGRAPH_SCOPE | {"dl"}),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup", "html"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist", "html"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "template", "html"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "template", "html", "tr"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "template", "html", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "template", "html"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "template", "html"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "template", "html"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby", "html"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby", "html"])),
}
#: An end tag finds its element no further up than these.
END_SCOPE = frozenset("table td th caption template html object".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)?""")
_GAP = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes); kind: text, start or end. Comments and the like are left out."""
    at, size = 0, len(source)
    while at < size:
        cut = source.find("<", at)
        if cut < 0:
            yield "text", html.unescape(source[at:]), {}
            return
        if cut > at:
            yield "text", html.unescape(source[at:cut]), {}
        if source.startswith("<!--", cut):
            if source.startswith(("<!-->", "<!--->"), cut):
                at = source.find(">", cut) + 1
            else:
                end = re.compile("--!?>").search(source, cut + 4)
                at = end.end() if end else size
            continue
        closing = source.startswith("</", cut)
        name = _NAME.match(source, cut + 1 + closing)
        if not name:
            if closing or source.startswith(("<!", "<?"), cut):
                end = source.find(">", cut)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", {}
                at = cut + 1
            continue
        tag, at, attributes = name[0].lower(), name.end(), {}
        while at < size and source[at] != ">":
            found = _ATTRIBUTE.match(source, at)
            if found.end() == at:
                break
            at = found.end()
            if found[1] and not closing:
                value = next((v for v in found.groups()[1:] if v is not None), "")
                attributes.setdefault(found[1].lower(), html.unescape(value) if "&" in value else value)
        at += 1
        if closing:
            yield "end", tag, {}
            continue
        yield "start", tag, attributes
        if tag in RAW or tag in RAW_WITH_REFERENCES:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else size
            if stop > at:
                yield "text", html.unescape(source[at:stop]) if tag in RAW_WITH_REFERENCES else source[at:stop], {}
            at = stop
        elif tag == "plaintext":
            yield "text", source[at:], {}
            return


def tree(source: str) -> Node:
    """The tree of a page, below a root node `html`."""
    root = Node("html", {})
    stack = [root]

    def close(names: frozenset[str], scope: frozenset[str]) -> None:
        """Ends the outermost run of open elements down from the highest of `names` within scope."""
        found = 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                found = depth
            elif stack[depth].tag in scope:
                break
        if found:
            del stack[found:]

    def nearest(name: str, scope: frozenset[str]) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == name:
                return depth
            if stack[depth].tag in scope:
                return 0
        return 0

    # Within a hidden element beyond MOST_DEPTH: its tag, the elements open in it, and how many of each name.
    skipped, inside, held = "", [], Counter()

    def open_(tag: str, attributes: dict[str, str]) -> None:
        nonlocal skipped
        node = Node(tag, attributes)
        if tag not in VOID and len(stack) >= MOST_DEPTH and not seen(node):
            skipped = tag
            inside.clear(), held.clear()
            return
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < MOST_DEPTH:
            stack.append(node)

    def goes_on(kind: str, name: str) -> bool:
        """Whether the hidden element goes on past this token, which is then a part of it or its end."""
        nonlocal skipped
        if kind == "start":
            ends = name in ENDS_PARAGRAPH if skipped == "p" else name in IMPLIED_ENDS and skipped in IMPLIED_ENDS[name][0]
            if inside or not ends:
                if name not in VOID:
                    inside.append(name)
                    held[name] += 1
                return True
        elif kind == "text":
            return True
        elif held[name]:
            last = ""
            while last != name:
                last = inside.pop()
                held[last] -= 1
            return True
        elif name == skipped:
            skipped = ""
            return True
        elif not nearest(name, END_SCOPE - {name}):
            return True
        skipped = ""
        return False

    for kind, name, attributes in tokens(source):
        if skipped and goes_on(kind, name):
            continue
        top = stack[-1]
        if kind == "text":
            if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and name.strip(" \t\n\f\r"):
                # Text between cells is shown before the table.
                depth = max(d for d, n in enumerate(stack) if n.tag == "table") if any(n.tag == "table" for n in stack) else len(stack) - 1
                holder = stack[depth - 1].children if stack[depth].tag == "table" else top.children
                holder.insert(len(holder) - 1 if stack[depth].tag == "table" else len(holder), name)
            elif top.tag == "head" and name.strip(" \t\n\f\r"):
                stack.pop()
                stack[-1].children.append(name)
            else:
                top.children.append(name)
        elif kind == "start":
            if name in ("html", "body"):
                # There is one of each; what they say about being seen holds for it.
                if name == "body":
                    close(frozenset(["head"]), frozenset())
                for k, v in attributes.items():
                    root.attributes.setdefault(k, v)
                continue
            if top.tag == "head" and name not in ("base", "link", "meta", "noscript", "script", "style", "template", "title", "head"):
                stack.pop()
            if name == "image":
                name = "img"
            if name in ENDS_PARAGRAPH and (depth := nearest("p", PARAGRAPH_SCOPE)):
                del stack[depth:]
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if name in IMPLIED_ENDS:
                close(*IMPLIED_ENDS[name])
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                open_("tr", {})
            open_(name, attributes)
        elif name == "br":
            open_("br", {})
        elif name == "p":
            depth = nearest("p", PARAGRAPH_SCOPE)
            if depth:
                del stack[depth:]
            else:
                top.children.append(Node("p", {}))
        elif name in HEADINGS:
            depth = max((nearest(h, END_SCOPE) for h in HEADINGS), default=0)
            if depth:
                del stack[depth:]
        elif name not in ("html", "body"):
            scope = frozenset(["table", "template", "html"]) - {name} if name in TABLE_PARTS else END_SCOPE - {name}
            if depth := nearest(name, scope):
                del stack[depth:]
    return root


def declared(node: Node, name: str) -> str:
    """The value that the element's own style gives a property: the last one, in lower case."""
    found = ""
    for part in node.attributes.get("style", "").split(";"):
        key, _, value = part.partition(":")
        if key.strip().lower() == name:
            found = value.partition("!")[0].strip().lower() or found
    return found


def seen(node: Node) -> bool:
    """Whether the element takes part in the layout."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
        return False
    return not (node.tag == "input" and a.get("type", "").lower() == "hidden" or "style" in a and declared(node, "display") == "none")


def width(text: str) -> int:
    """Columns that a line takes on a terminal."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text under construction: of the page, or of one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indents = [""]
        self.marker: str | None = None

    def text(self, raw: str) -> None:
        """Ordinary text: runs of white space are one space, none at the ends of a line."""
        words = _GAP.sub(" ", raw)
        if words[:1] == " ":
            self.space = self.space or bool(self.parts)
            words = words[1:]
        if words:
            tail = words[-1] == " "
            self._add((" " if self.space and self.parts else "") + (words[:-1] if tail else words))
            self.space = tail

    def exact(self, raw: str) -> None:
        first, *rest = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self._add(first)
        for line in rest:
            self.end_line(True)
            if line:
                self._add(line)

    def _add(self, text: str) -> None:
        if not self.parts:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.parts.append(self.indents[-1] if self.marker is None else self.marker)
            self.marker = None
        self.parts.append(text)

    def end_line(self, even_empty: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        elif even_empty and self.lines and not self.gap:
            self.lines.append("")
        self.space = False

    def block(self, gap: int = 0) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        """Whole lines, as they are."""
        self.block()
        for line in lines:
            self._add(line)
            self.end_line()

    def result(self) -> list[str]:
        self.block()
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        return lines


class Table:
    """Cells of a table: their lines, where they start and what they span.

    Columns from the last of COLUMNS on are one, in which cells follow each other.
    """

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str], str]]] = []
        self.until: np.ndarray | None = None  # of each column: the row up to which a cell from above covers it
        self.caption: list[str] = []

    def row(self) -> None:
        self.rows.append([])

    def cell(self, lines: list[str], node: Node) -> None:
        if not self.rows:
            self.row()
        own, last = self.rows[-1], COLUMNS - 1
        column = own[-1][1] if own else 0
        if self.until is not None and column < last:
            free = np.flatnonzero(self.until[column:] < len(self.rows))
            column = column + int(free[0]) if len(free) else last
        column = min(column, last)
        end = min(column + _count(node, "colspan", 1000), COLUMNS)
        own.append((column, end, lines, align(node)))
        if (down := _count(node, "rowspan", 65534)) > 1:
            if self.until is None:
                self.until = np.zeros(COLUMNS, np.int64)
            self.until[column:end] = np.maximum(self.until[column:end], len(self.rows) + down - 1)

    def lines(self) -> list[str]:
        """Columns as wide as their widest cell, two spaces between them; the last isn't padded."""
        widths = np.zeros(COLUMNS, np.int64)
        spans = []
        for row in self.rows:
            for column, end, lines, _ in row:
                if lines:
                    need = min(WIDEST, max(map(width, lines)))
                    if end == column + 1:
                        widths[column] = max(widths[column], need)
                    else:
                        spans.append((column, end, need))
        taken = lambda x: x.sum() + 2 * np.count_nonzero(x)
        for column, end, need in spans:
            if (more := need - max(0, taken(widths[column:end]) - 2)) > 0:
                # A last column without a width of its own takes two places more, for the gap before it.
                new = not widths[end - 1] and taken(widths[column:end]) > 0
                widths[end - 1] += max(1, more - 2) if new else more
        start = np.minimum(np.concatenate([[0], np.cumsum(widths + 2 * (widths > 0))]), LONGEST).tolist()
        out = list(self.caption)
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines, _ in row), default=0)):
                line, have = [], 0
                for column, end, lines, side in row:
                    text = lines[k] if k < len(lines) else ""
                    if not text:
                        continue
                    free = max(0, start[end] - start[column] - 2 - width(text))
                    begin = start[column] + (free if side == "right" else free // 2 if side == "center" else 0)
                    begin = max(begin, have + 2 if line else 0)
                    line.append(" " * (begin - have) + text)
                    have = begin + width(text)
                out.append("".join(line).rstrip(" "))
        return out


def _count(node: Node, name: str, most: int) -> int:
    digits = re.match(r"\s*\+?(\d{1,9})", node.attributes.get(name, ""))
    return min(most, max(1, int(digits[1]))) if digits else 1


def align(node: Node) -> str:
    return declared(node, "text-align") or node.attributes.get("align", "").lower()


def _marker(kind: str, number: int) -> str:
    if kind in ("a", "A"):
        out, n = "", number
        while n > 0:
            n, k = divmod(n - 1, 26)
            out = chr(ord(kind) + k) + out
        return (out or str(number)) + ". "
    return f"{number}. "


def render(root: Node) -> str:
    flows, tables, lists = [Flow()], [], []
    #: Nodes to enter or leave, whether within preformatted text, and whether what they show is visible.
    todo: list[tuple[object, bool, bool, bool]] = [(root, False, False, True)]
    while todo:
        node, leaving, pre, shown = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if shown:
                flow.exact(node) if pre else flow.text(node)
            continue
        tag = node.tag
        gap = int(tag in SPACED and not (tag in LISTS and len(lists) > leaving))
        if not leaving:
            if not seen(node):
                continue
            if "style" in node.attributes and (visibility := declared(node, "visibility")):
                shown = visibility not in ("hidden", "collapse") and (shown or visibility == "visible")
            if tag == "br":
                flow.end_line(True)
                continue
            if tag == "img":
                continue
            if tag == "hr":
                flow.block()
                continue
            if tag == "input":
                if shown and node.attributes.get("type", "text").lower() in ("text", "button", "submit", "reset", "search", "email", "url", "tel", "number"):
                    flow.text(node.attributes.get("value", ""))
                continue
            if tag == "table":
                flow.block(1)
                tables.append(Table())
                flows.append(Flow())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th", "caption") and tables:
                flows.append(Flow())
            elif tag in BLOCK:
                flow.block(gap)
            if tag in LISTS:
                number = re.match(r"\s*([+-]?\d{1,9})", node.attributes.get("start", ""))
                count = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
                down = tag == "ol" and "reversed" in node.attributes
                lists.append([tag, int(number[1]) if number else count if down else 1, -1 if down else 1, node.attributes.get("type", "")])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    value = re.match(r"\s*([+-]?\d{1,9})", node.attributes.get("value", ""))
                    if value:
                        lists[-1][1] = int(value[1])
                    mark = _marker(lists[-1][3], lists[-1][1])
                    lists[-1][1] += lists[-1][2]
                flow.marker = (flow.indents[-1] if flow.marker is None else flow.marker) + mark
                flow.indents.append(flow.indents[-1] + " " * len(mark))
            elif tag in ("blockquote", "dd"):
                flow.indents.append(flow.indents[-1] + "  ")
            now = pre or tag in ("pre", "textarea", "listing", "xmp", "plaintext")
            children = node.children
            if now and not pre and children and isinstance(children[0], str):
                children = [re.sub(r"^\r?\n", "", children[0]), *children[1:]]
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            todo.append((node, True, pre, shown))
            todo += [(c, False, now, shown) for c in reversed(children)]
            continue
        if tag == "table":
            own = flows.pop().result()  # what stood between the cells
            lines = [*own, *tables.pop().lines()]
            flows[-1].put(lines)
            flows[-1].block(1)
        elif tag in ("td", "th", "caption") and tables:
            lines = flows.pop().result()
            if tag == "caption":
                tables[-1].caption += lines
            else:
                tables[-1].cell(lines, node)
        elif tag == "li":
            flow.block()
            flow.indents.pop()
            flow.marker = None
        elif tag in ("blockquote", "dd"):
            flow.block(gap)
            flow.indents.pop()
        elif tag in BLOCK:
            flow.block(gap)
        if tag in LISTS:
            lists.pop()
    return "\n".join(flows[0].result())


def page_text(source: str | None) -> str:
    return render(tree(source)) if source else ""


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """One row per row of pages: its key and text.

    Null and empty pages have an empty text; text without any tag is one block; null keys and
    repeated rows are rendered like others, and equal pages alike. Very long pages are rendered whole:
    a table's text is at most LONGEST places a line longer than its cells'. Other columns, whatever
    their names, stay out. An empty table gives an empty table.
    """
    ship(pages.sparkSession)
    base = own_columns(pages, key, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                held.append(page_text(value.as_py()))
                size += len(held[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(held, pa.string())], names=[key, "text"])
                    held, size, first = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(held, pa.string())], names=[key, "text"])

    return base.mapInArrow(run, type(base.schema)([base.schema.fields[0]]).add("text", "string"))
