"""HTML extraction by layout-aware rendering.

A tag scanner feeds a tree builder that closes elements where HTML implies it; a renderer
walks the tree under visibility rules and emits what a reader would see: blocks on lines
of their own, paragraphs apart, list items marked and indented, table cells aligned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small

# Elements by the roles that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video title datalist noembed noframes dialog desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split()
)
APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
#: An opening tag closes these, up to the nearest of the limits.
CLOSES = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
}
CLOSES["tbody"] = CLOSES["tfoot"] = CLOSES["thead"]
#: An end tag does not reach out of these.
WALLS = {"li": LISTS, "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"])}
CELLS = frozenset(["td", "th"])

#: A quote opens a value only behind "="; one that is never closed is a character. Nothing here goes back, so a page is read once.
_VALUE = r"""\s*+=\s*+(?:"{0}"|'{1}'|{2})"""
_SKIPPED, _KEPT = (_VALUE.format(*parts) for parts in ((r'[^"]*+', r"[^']*+", r"[^\s>]*+"), (r'([^"]*+)', r"([^']*+)", r"([^\s>]*+)")))
_TAG = re.compile(rf"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_SKIPPED})?+)*+)(>|\Z))""", re.S)
_ATTRIBUTE = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:{_KEPT})?+""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_GONE = re.compile(r"(?:^|[;{\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;{\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_CSS_SIGN = re.compile(r"""[{};]|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'""", re.S)
DEEPEST = 200  # deeper elements are hung on their ancestor at this depth, as browsers do
WIDEST, TALLEST = 1000, 65_534  # columns and rows a cell may span: the bounds that HTML sets


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)  # nodes and strings

    def attribute(self, name: str) -> str | None:
        for key, *values in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(next(filter(None, values), ""))
        return None


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for every screen: one of them is empty, all, screen or not print. Other conditions may hold or not, so they do not count."""
    return any(" ".join(q.split()).lower().removeprefix("only ") in ("", "all", "screen", "not print") for q in media.split(","))


def style_rules(sheet: str) -> dict[str, str]:
    """Selector of one tag, class or id: its declarations, as far as they concern visibility.

    Rules count at top level and within ``@media`` that holds for every screen; those within
    other at-rules, and rules nested in rules, do not.
    """
    found: dict[str, str] = {}
    sheet, start, said = _COMMENT.sub(" ", sheet), 0, ""
    open_blocks: list[str | None] = []  # selectors of a rule, "" for a group whose rules count, None for what does not
    for sign in _CSS_SIGN.finditer(sheet):
        if len(sign[0]) > 1:
            continue  # a string
        before, start = sheet[start : sign.start()].strip(), sign.end()
        if sign[0] == "{":
            if None in open_blocks or open_blocks and open_blocks[-1]:
                open_blocks.append(None)
            elif before.startswith("@"):
                open_blocks.append("" if before[:6].lower() == "@media" and on_screen(before[6:]) else None)
            else:
                open_blocks.append(before or None)
                said = ""
        elif open_blocks and open_blocks[-1]:
            said += f";{before}"
        if sign[0] == "}" and open_blocks:
            selectors = open_blocks.pop()
            if selectors and (_GONE.search(said) or _VISIBILITY.search(said)):
                for selector in map(str.strip, selectors.split(",")):
                    if re.fullmatch(r"[.#]?[\w-]+", selector):
                        found[selector] = found.get(selector, "") + said
    return found


def build_tree(source: str, sheets: list[str] | None = None) -> Node:
    """The tree of a page; text that no tag claims hangs on the open element, and so does a tag that the page's end cuts off.

    Elements deeper than DEEPEST hang on their ancestor at that depth; four times as deep,
    they no longer hold what follows them.  No text is lost by either.  Style sheets for
    the screen are added to ``sheets``.
    """
    root = Node("html")
    stack, at = [root], 0

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while (found := _TAG.search(source, at)) is not None:
        text(source[at : found.start()])
        if found[2] and not found[4]:
            at = found.start()
            break
        at = found.end()
        closing, tag, attributes = found[1], (found[2] or "").lower(), found[3]
        if not tag or tag in ("html", "body"):
            continue
        if closing:
            wall = WALLS.get(tag, frozenset(["td", "th", "table"]) if tag not in ("table", "thead", "tbody", "tfoot", "caption") else frozenset())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in wall:
                    break
            continue
        if tag in BLOCK or tag == "tr":
            _close(stack, frozenset(["p"]), BLOCK - {"p"} | CELLS)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        if tag in CELLS and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")  # a cell implies its row
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attributes or "")
        stack[min(len(stack), DEEPEST) - 1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else len(source)])
            if tag == "style" and sheets is not None and on_screen(node.attribute("media") or ""):
                sheets.append(node.children[0])
            at = end.end() if end else len(source)
        elif tag not in VOID and not (attributes or "").endswith("/") and len(stack) < 4 * DEEPEST:
            stack.append(node)
    text(source[at:])
    return root


def _close(stack: list[Node], tags: frozenset[str], limits: frozenset[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in limits:
            return
        if stack[k].tag in tags:
            del stack[k:]
            if tags == {"p"}:
                return
            return _close(stack, tags, limits)


def _styles(node: Node, rules: dict[str, str]) -> str:
    """The declarations that apply to an element, its own last."""
    if not rules:
        return (node.attribute("style") or "") if "style" in node.attributes else ""
    names = [node.tag]
    if "class" in node.attributes:
        names += [f".{c}" for c in (node.attribute("class") or "").split()]
    if "id" in node.attributes:
        names.append(f"#{node.attribute('id')}")
    own = node.attribute("style") if "style" in node.attributes else None
    return ";".join([*(rules[n] for n in names if n in rules), own or ""])


def gone(node: Node, rules: dict[str, str]) -> bool:
    """Whether an element and all within it takes no place."""
    if node.tag in HIDDEN:
        return node.tag != "dialog" or node.attribute("open") is None
    if "hidden" in node.attributes and node.attribute("hidden") is not None:
        return True
    return bool((node.attributes or rules) and _GONE.search(_styles(node, rules)))


def seen(node: Node, rules: dict[str, str], before: bool) -> bool:
    """Whether an element's own text is seen, as its style or, without one, its parent's visibility says."""
    said = _VISIBILITY.findall(_styles(node, rules)) if node.attributes or rules else ()
    return said[-1].lower() == "visible" if said else before


class Renderer:
    """Lines of text so far; ``gap`` is the number of line ends due before the next text."""

    def __init__(self, rules: dict[str, str] | None = None, shown: bool = True) -> None:
        self.rules = rules or {}
        self.shown = shown
        self.lines: list[str] = [""]
        self.gap = 0
        self.space = False
        self.indent = ""
        self.mark = ""

    def emit(self, text: str) -> None:
        if self.gap and any(self.lines):
            self.lines.extend([""] * self.gap)
            self.space = False
        self.gap = 0
        if not self.lines[-1]:
            at = len(self.mark)
            self.lines[-1] = (self.indent[:-at] + self.mark if at else self.indent) + text
            self.mark = ""
        else:
            self.lines[-1] += (" " if self.space else "") + text
        self.space = False

    def inline(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words.startswith(" "):
            self.space = True
        if inner := words.strip(" "):
            self.emit(inner)
            self.space = words.endswith(" ")

    def breaks(self, n: int) -> None:
        self.gap = max(self.gap, n)

    def walk(self, node: Node, pre: bool = False) -> None:
        for child in node.children:
            if isinstance(child, str):
                if not self.shown:
                    continue
                if pre:
                    for k, line in enumerate(child.split("\n")):
                        if k:
                            self.breaks(1) if not self.gap else self.__dict__.update(gap=self.gap + 1)
                        if line.strip():
                            self.emit(line.rstrip())
                else:
                    self.inline(child)
            elif not gone(child, self.rules):
                self.element(child, pre)

    def element(self, node: Node, pre: bool) -> None:
        before, self.shown = self.shown, seen(node, self.rules, self.shown)
        self.laid_out(node, pre)
        self.shown = before

    def laid_out(self, node: Node, pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            self.gap = self.gap + 1 if self.gap else 1
        elif tag == "table":
            self.breaks(2)
            self.table(node)
            self.breaks(2)
        elif tag in LISTS:
            self.listed(node, pre)
        elif tag == "svg":
            for label in _labels(node):
                self.inline(f" {label} ")
        elif tag == "select":
            options = [o for o in _descendants(node, "option") if not gone(o, self.rules)]
            if node.attribute("multiple") is None and (node.attribute("size") or "1") in ("", "0", "1"):  # a closed list shows one
                options = [o for o in options if o.attribute("selected") is not None][-1:] or options[:1]
            for option in options:
                self.inline(" ")
                self.walk(option)
                self.inline(" ")
        elif tag in ("textarea", "xmp"):
            self.breaks(1)
            self.walk(node, pre=True)
            self.breaks(1)
        elif tag == "details" and node.attribute("open") is None:
            self.breaks(1)
            self.walk(Node("details", "", [c for c in node.children if isinstance(c, Node) and c.tag == "summary"]))
            self.breaks(1)
        elif tag in BLOCK:
            around, indent = (2 if tag in APART else 1), self.indent
            self.breaks(around)
            self.indent += "    " if tag == "dd" else "  " if tag == "blockquote" else ""
            self.walk(node, pre or tag == "pre")
            self.indent = indent
            self.breaks(around)
        else:
            self.walk(node, pre)

    def listed(self, node: Node, pre: bool) -> None:
        around, indent = (1 if self.indent else 2), self.indent
        self.breaks(around)
        start = node.attribute("start") or "1"
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str):
                if self.shown:
                    self.inline(child)
            elif gone(child, self.rules):
                continue
            elif child.tag == "li":
                self.breaks(1)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                self.indent, self.mark = indent + " " * len(mark), mark
                before, self.shown = self.shown, seen(child, self.rules, self.shown)
                self.walk(child, pre)
                self.indent, self.mark, self.shown = indent, "", before
                self.breaks(1)
            else:
                self.element(child, pre)
        self.breaks(around)

    def table(self, node: Node) -> None:
        rows, captions = self.rows(node)
        for caption, shown in captions:
            before, self.shown = self.shown, shown
            self.element(caption, False)
            self.shown = before
            self.breaks(1)
        cells, widths = _placed([[(rendered(c, self.rules, seen(c, self.rules, shown)).split("\n"), c) for c in row] for row, shown in rows])
        for row in cells:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                line = ""
                for at, lines, span in row:
                    line = line.ljust(sum(w + 2 for w in widths[:at] if w)) + (lines[k] if k < len(lines) else "")
                if line.strip():
                    self.breaks(1)
                    self.emit(line.rstrip())
            self.breaks(1)

    def rows(self, table: Node) -> tuple[list[tuple[list[Node], bool]], list[tuple[Node, bool]]]:
        """The cells of each row of a table, header first and footer last, and what else is in it, each with whether it is seen."""
        rows, captions, pending = [], [], [(table, self.shown)]

        def loose(child: Node | str, shown: bool) -> None:
            if isinstance(child, str):
                if child.strip():
                    captions.append((Node("p", "", [child]), shown))
            elif not gone(child, self.rules):
                captions.append((child, shown))

        parts = {"thead": [], "tbody": [], "tfoot": []}
        for child in table.children:
            if isinstance(child, Node) and child.tag in parts and not gone(child, self.rules):
                parts[child.tag].append((child, seen(child, self.rules, self.shown)))
        pending = [*parts["thead"], (table, self.shown), *parts["tfoot"]]
        for part, shown in pending:
            for child in part.children:
                if isinstance(child, Node) and child.tag == "tbody" and part is table and not gone(child, self.rules):
                    inner = seen(child, self.rules, shown)
                    bodies = [(c, inner) for c in child.children]
                elif isinstance(child, Node) and child.tag in parts and part is table:
                    continue
                else:
                    bodies = [(child, shown)]
                for item, inner in bodies:
                    if not isinstance(item, Node) or item.tag != "tr":
                        loose(item, inner)
                    elif not gone(item, self.rules):
                        of_row = seen(item, self.rules, inner)
                        rows.append(([c for c in item.children if isinstance(c, Node) and c.tag in CELLS and not gone(c, self.rules)], of_row))
                        for c in item.children:
                            if isinstance(c, str) or c.tag not in CELLS:
                                loose(c, of_row)
        return rows, captions


def _descendants(node: Node, tag: str) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            if child.tag == tag:
                yield child
            else:
                yield from _descendants(child, tag)


def _labels(node: Node) -> Iterator[str]:
    """The text of a drawing: that of its text elements."""
    for text in _descendants(node, "text"):
        pending, parts = [text], []
        while pending:
            item = pending.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag not in HIDDEN:
                pending += reversed(item.children)
        yield "".join(parts)


def _placed(rows: list[list[tuple[list[str], Node]]]) -> tuple[list[list[tuple[int, list[str], int]]], list[int]]:
    """(column, lines, columns spanned) of the cells of each row, and the columns' widths.

    A cell takes the first columns that no cell above reaches down to.
    """
    placed, widths, held = [], [], {}  # held: column -> rows that a cell above still takes there
    for row in rows:
        at, here, now = 0, [], {}
        for lines, cell in row:
            while held.get(at, 0):
                at += 1
            span, down = _spans(cell, "colspan", WIDEST), _spans(cell, "rowspan", TALLEST)
            here.append((at, lines, span))
            for column in range(at, at + span):
                now[column] = down
            at += span
        widths += [0] * (max([at, *(c + 1 for c in held)], default=0) - len(widths))
        for column, lines, span in here:
            if span == 1:
                widths[column] = max(widths[column], *map(len, lines))
        held = {c: n - 1 for c, n in {**held, **now}.items() if n > 1}
        placed.append(here)
    for row in placed:  # a cell over several columns widens the last of them
        for column, lines, span in row:
            inside = [w for w in widths[column : column + span] if w]
            short = max(map(len, lines)) - sum(inside) - 2 * max(0, len(inside) - bool(widths[column + span - 1]))
            if span > 1 and short > 0 and column + span < len(widths):
                widths[column + span - 1] += short
    return placed, widths


def _spans(cell: Node, name: str, most: int) -> int:
    said = cell.attribute(name) or "1"
    if not re.fullmatch(r"\d{1,9}", said):
        return 1
    return min(most, int(said)) or (most if name == "rowspan" else 1)  # a rowspan of 0 reaches down to the end


def rendered(node: Node, rules: dict[str, str] | None = None, shown: bool = True) -> str:
    view = Renderer(rules, shown)
    view.walk(node)
    return "\n".join(line.rstrip() for line in view.lines).strip("\n")


def visible_text(source: str | None) -> str:
    """The text that a reader of an HTML page sees; "" for none."""
    if not source:
        return ""
    sheets: list[str] = []
    return rendered(build_tree(source, sheets), style_rules("\n".join(sheets)) if sheets else None)


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of the HTML in ``column``; null and empty pages have an empty text.

    Visible is what a browser shows at first: not hidden elements, nor what inline styles or
    rules of a style sheet for one tag, class or id take away, but what is visible again
    within invisible elements.  All rows, repeated ones too, and all other columns stay as
    they are, the HTML itself left out and a column named like ``into`` replaced; pages are
    read whole, however long; an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (column, into)]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = pa.array(map(visible_text, batch.column(column).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, into])

    source = pages.select(*kept, F.col(column).cast("string").alias(column))
    schema = pages.select(*kept, F.lit("").alias(into)).schema
    return source.mapInArrow(texts, schema)
