"""Visible text of web pages, laid out as a text browser would."""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Generator, Iterable
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import fields, with_arrays

# The element classes of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NEVER_SHOWN = set("head title script style template noscript datalist audio video canvas object iframe area param rp".split())
_SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset".split())
_BLOCK = _SPACED | set(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer header hgroup legend li main menu nav section summary caption tr td th tbody thead tfoot".split()
)
# An element of the first kind is closed by the start of one of the second.
_CLOSED_BY = {
    "p": _BLOCK - set("html body tr td th tbody thead tfoot caption summary legend".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "tbody": {"tbody", "thead", "tfoot"}, "thead": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead", "tfoot"},
    "caption": {"tr", "tbody", "thead", "tfoot", "td", "th"}, "head": {"body"}, "select": {"select", "input", "textarea"},
}
# What an implied end does not reach beyond.
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, **dict.fromkeys("td th tr tbody thead tfoot caption".split(), {"table"})}
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Drawings and formulas: what is not painted, what holds HTML, what HTML ends them, and whose parts stand apart.
_UNPAINTED = set("desc metadata defs symbol clippath mask marker pattern filter lineargradient radialgradient annotation annotation-xml mphantom".split())
_HOLDS_HTML = {"svg": {"foreignobject", "desc", "title"}, "math": set("mi mo mn ms mtext annotation-xml".split())}
_BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span"
    " strong strike sub sup table tt u ul var".split()
)
_APART = set("mfrac mtable mtr mlabeledtr munder mover munderover".split())
# Later versions of the parser read the text of these as such.
_PLAIN_TEXT = {"textarea"} - set(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()))
# Below so many open blocks inline elements start lines of their own.
_MAX_BLOCKS = 2000
# Text of any depth stays; beyond these, lists do not indent further and cells of nested tables are lines.
_MAX_INDENT = 1000
_MAX_TABLES = 100
_MAX_SPAN = 1000
# Cells are aligned up to this width, and columns that start within this many characters, fewer in nested tables.
_MAX_COLUMN = 60
_MAX_ALIGNED = 240
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    # ``drawing`` tells what content is: "svg", "text" in it, "math", or "" for HTML.
    __slots__ = ("tag", "attributes", "children", "parent", "depth", "blocks", "drawing")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.blocks = parent.blocks + (parent.tag in _BLOCK) if parent else 0
        self.drawing = parent.drawing if parent else ""
        if tag in _HOLDS_HTML:
            self.drawing = tag
        elif tag in _HOLDS_HTML.get(self.drawing, ()):
            self.drawing = ""
        elif tag == "text" and self.drawing == "svg":
            self.drawing = "text"


class Tree(HTMLParser):
    """Builds a tree, with ends and table parts that authors leave out put in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("html", {}, None)
        # Open elements by tag, so that a page of any depth is read in one pass.
        self.opened: dict[str, list[Node]] = defaultdict(list, html=[self.root])
        self.css: list[str] = []
        self.feed(html)
        self.close()
        if self.cdata_elem in _PLAIN_TEXT:
            self.handle_data(self.rawdata)

    def _open(self, tag: str, *within: str) -> Node | None:
        """The nearest open element with the tag, not beyond one of ``within``."""
        if not self.opened[tag]:
            return None
        node = self.opened[tag][-1]
        return None if any(self.opened[x] and self.opened[x][-1].depth > node.depth for x in within) else node

    def _leave(self, node: Node) -> None:
        """Close the open elements up to this one, which is closed too."""
        to = node.parent
        while self.here is not to:
            self.opened[self.here.tag].pop()
            self.here = self.here.parent

    def _push(self, tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes, self.here)
        self.here.children.append(node)
        self.opened[tag].append(node)
        self.here = node

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.here.drawing and (tag in _BREAKOUT or tag == "font" and {"color", "face", "size"} & {k for k, _ in attrs}):
            while self.here.drawing:
                self._leave(self.here)
        if tag in ("html", "body") and (tag == "html" or self._open("body")):
            return
        for old, starts in _CLOSED_BY.items():
            if tag in starts:
                node = self._open(old, *_SCOPE.get(old, ()), *({"table", "td", "th", "caption"} if old == "p" else ()))
                if node is not None:
                    self._leave(node)
        if tag in _HEADINGS and self.here.tag in _HEADINGS:
            self._leave(self.here)
        if tag in ("td", "th") and self._open("tr", "table") is None and self._open("table"):
            self._push("tr", {})
        attributes = {k: v or "" for k, v in attrs}
        if tag in _VOID:
            self.here.children.append(Node(tag, attributes, self.here))
        else:
            self._push(tag, attributes)
            if tag in _PLAIN_TEXT and not self.here.drawing:
                self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # The slash counts in drawings and formulas alone.
        if self.here.tag == tag and tag not in _VOID and self.here.parent is not None and (tag in _HOLDS_HTML or self.here.parent.drawing):
            self._leave(self.here)

    def unknown_decl(self, data: str) -> None:
        if self.here.drawing and data.startswith("CDATA["):
            self.handle_data(data[len("CDATA[") :])

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.here.children.append(Node("br", {}, self.here))
        elif tag == "p" and self._open("p", "table", "td", "th") is None:
            self.here.children.append(Node("p", {}, self.here))
        else:
            node = self._open(tag, *({"td", "th", "table"} if tag not in ("td", "th", "table", "tr", "tbody", "thead", "tfoot", "body", "html") else ()))
            if node is not None and node.parent is not None:
                self._leave(node)

    def handle_data(self, data: str) -> None:
        if self.here.tag == "style":
            self.css.append(data)
        elif self.here.drawing == "svg":
            pass  # Only text elements are painted.
        elif self.here.tag in _PLAIN_TEXT:
            self.here.children.append(unescape(data))
        elif self.here.tag not in ("table", "tbody", "thead", "tfoot", "tr") or data.strip():
            self.here.children.append(data)


def _is_block(node: Node) -> bool:
    return node.tag in _BLOCK or (node.tag == "text" and node.drawing == "text")


def _plain(node: Node) -> str:
    """All text in an element."""
    found, walk = [], [node]
    while walk:
        x = walk.pop()
        if isinstance(x, str):
            found.append(x)
        elif x.tag not in _NEVER_SHOWN:
            walk.extend(reversed(x.children))
    return "".join(found)


class HiddenBy:
    """Simple selectors (tag, classes, ids) of the rules that hide what they match, found by one of their names."""

    def __init__(self, css: str):
        selectors = set()
        for heads, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
            if _HIDING.search(body):
                for selector in heads.split(","):
                    m = _SELECTOR.fullmatch(selector.strip())
                    if m and m.group(0):
                        parts = re.findall(r"[.#][\w-]+", m.group(2))
                        classes = frozenset(p[1:] for p in parts if p[0] == ".")
                        selectors.add(((m.group(1) or "").lower(), classes, frozenset(p[1:] for p in parts if p[0] == "#")))
        # Under an id, else under the class that the fewest selectors have, else under the tag.
        often = Counter(c for _, classes, _ in selectors for c in classes)
        self.under: dict[str, list[tuple[str, frozenset, frozenset]]] = defaultdict(list)
        for tag, classes, ids in selectors:
            name = "#" + min(ids) if ids else "." + min(classes, key=lambda c: (often[c], c)) if classes else tag
            self.under[name].append((tag, classes, ids))

    def __call__(self, node: Node) -> bool:
        classes = set(node.attributes.get("class", "").split())
        own = node.attributes.get("id")
        names = [node.tag, *("." + c for c in classes), *(["#" + own] if own is not None else [])]
        return any(
            (not t or t == node.tag) and c <= classes and (not i or i == {own}) for name in names for t, c, i in self.under.get(name, ())
        )


# Lines of an element, by a generator that yields those of elements in it and is sent their lines.
Lines = Generator["Lines", deque, deque]


def _run(lines: Lines) -> deque:
    """Run nested generators with a stack of their own, as pages may be nested deeper than Python's."""
    stack, value = [lines], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _joined(lines: deque, new: Iterable[str]) -> deque:
    """All lines, in whichever of the two is longer."""
    if isinstance(new, deque) and len(new) > len(lines):
        new.extendleft(reversed(lines))
        return new
    lines.extend(new)
    return lines


class Renderer:
    def __init__(self, html: str):
        tree = Tree(html)
        self.hiding = HiddenBy("\n".join(tree.css))
        self.tables = self.items = 0
        lines = _run(self.block(tree.root))
        while lines and not lines[0].strip():
            lines.popleft()
        while lines and not lines[-1].strip():
            lines.pop()
        self.text = "\n".join(line.rstrip() for line in lines)

    def hidden(self, node: Node) -> bool:
        a = node.attributes
        if node.tag in _NEVER_SHOWN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
            return True
        if node.parent is not None and node.parent.drawing and (node.tag in _UNPAINTED or a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse")):
            return True
        if "style" in a and _HIDING.search(a["style"]):
            return True
        if node.parent is not None and node.parent.tag == "details" and "open" not in node.parent.attributes and node.tag != "summary":
            return True
        return self.hiding(node)

    def block(self, node: Node, pre: bool = False, indent: int = 0, tables: int = 0) -> Lines:
        """The lines of an element's content; empty ones part what stands apart."""
        lines: deque[str] = deque()
        inline: list[str] = []
        gap = False

        def flush() -> None:
            nonlocal gap
            text = "".join(inline)
            inline.clear()
            new = text.split("\n") if pre else [_WHITE.sub(" ", x).strip(" ") for x in text.replace("\n", " ").split("\0")]
            if any(x.strip() for x in new):
                add(new, False)

        def add(new: Iterable[str], spaced: bool) -> None:
            nonlocal gap, lines
            if new:
                if lines and (spaced or gap) and lines[-1].strip():
                    lines.append("")
                lines = _joined(lines, new)
                gap = spaced

        number = self.number(node.attributes.get("start")) if node.tag == "ol" else 1
        walk: list = list(reversed(node.children))
        while walk:
            child = walk.pop()
            if isinstance(child, str):
                if not (node.tag == "details" and "open" not in node.attributes):
                    inline.append(child)
            elif child.tag == "br":
                inline.append("\n" if pre else "\0")
            elif child.tag == "wbr" or self.hidden(child):
                continue
            elif child.tag == "img":
                inline.append(child.attributes.get("alt", ""))
            elif child.tag == "input":
                if child.attributes.get("type", "text").lower() in ("submit", "button", "reset"):
                    inline.append(child.attributes.get("value", ""))
            elif child.tag == "select" and not self.listed(child):
                inline.append(f" {self.chosen(child)} ")
            elif child.tag in ("select", "textarea"):
                flush()
                new = self.options(child) if child.tag == "select" else re.split(r"\r\n?|\n", _plain(child))
                while new and not new[0].strip():
                    new.pop(0)
                while new and not new[-1].strip():
                    new.pop()
                add(new, False)
            elif not _is_block(child) and not any(isinstance(x, Node) and _is_block(x) for x in child.children):
                # Inline: its content stands in the same line.
                if child.blocks > _MAX_BLOCKS and inline and inline[-1].strip() and inline[-1] not in "\0\n":
                    inline.append("\n" if pre else "\0")
                for x in reversed(child.children):
                    walk += [" ", x] if child.tag in _APART else [x]
                if child.tag == "tspan" and ("x" in child.attributes or "y" in child.attributes):
                    inline.append(" ")
            elif child.tag in _VOID:
                flush()
                add(["---"] if child.tag == "hr" else [], True)
            else:
                flush()
                if child.tag == "table":
                    new = yield self.table(child, indent, tables + 1)
                elif child.tag in ("li", "dd", "blockquote"):
                    first = mark = "  "
                    if child.tag == "li":
                        self.items += 1
                        mark = f"{number}. " if node.tag == "ol" else "- "
                        first = " " * len(mark)
                        number += 1
                    deeper = indent + len(mark)
                    new = yield self.block(child, pre, min(deeper, _MAX_INDENT), tables)
                    if child.tag == "li":
                        new = new or deque([""])
                        head = mark + new.popleft()
                    if deeper <= _MAX_INDENT:
                        new = deque(first + x if x.strip() else x for x in new)
                    if child.tag == "li":
                        new.appendleft(head)
                else:
                    new = yield self.block(child, pre or child.tag == "pre", indent, tables)
                nested = child.tag in ("ul", "ol", "menu") and node.tag == "li"
                add(new, child.tag in _SPACED and not nested)
        flush()
        return lines

    @staticmethod
    def number(value: str | None, least: int = 1) -> int:
        return max(least, int(value)) if value and value.strip().isascii() and value.strip().isdigit() else 1

    def listed(self, select: Node) -> bool:
        """Whether a choice shows its options, not only the chosen one."""
        return "multiple" in select.attributes or self.number(select.attributes.get("size")) > 1

    @staticmethod
    def label(option: Node) -> str:
        return _WHITE.sub(" ", option.attributes.get("label") or _plain(option)).strip(" ")

    def chosen(self, select: Node) -> str:
        """The option that a closed choice shows, which may be hidden in the list."""
        first = last = None
        walk = [(select, False)]
        while walk:
            node, off = walk.pop()
            off = off or (node.tag in ("optgroup", "option") and "disabled" in node.attributes)
            if node.tag == "option":
                last = node if "selected" in node.attributes else last
                first = node if first is None and not off else first
            else:
                walk.extend((x, off) for x in reversed(node.children) if isinstance(x, Node))
        shown = last or first
        return self.label(shown) if shown else ""

    def options(self, select: Node) -> list[str]:
        """All options of an open choice, a line each, below the labels of their groups."""
        found, walk = [], list(reversed(select.children))
        while walk:
            node = walk.pop()
            if isinstance(node, str) or self.hidden(node):
                continue
            if node.tag == "option":
                found.append(self.label(node))
            else:
                found += [self.label(node)] if node.tag == "optgroup" and node.attributes.get("label") else []
                walk.extend(reversed(node.children))
        return found

    def loose(self, part: Node, indent: int, tables: int) -> Lines:
        """What stands in a table but in no cell."""
        if part.tag in ("select", "textarea"):
            around = Node("div", {}, part.parent)
            around.children.append(part)
            return self.block(around, False, indent, tables)
        return self.block(part, False, indent, tables)

    def table(self, table: Node, indent: int, tables: int) -> Lines:
        """Rows of cells in columns of even width; spans leave the places they cover empty."""
        self.tables += 1
        rows: list[Node] = []
        caption: deque[str] = deque()
        other: deque[str] = deque()
        below: deque[str] = deque()
        for part in table.children:
            if isinstance(part, str) or self.hidden(part):
                other += [part.strip()] if isinstance(part, str) and part.strip() else []
            elif part.tag == "tr":
                rows.append(part)
            elif part.tag in ("tbody", "thead", "tfoot"):
                rows += [r for r in part.children if isinstance(r, Node) and r.tag == "tr" and not self.hidden(r)]
                other += [r.strip() for r in part.children if isinstance(r, str) and r.strip()]
            elif part.tag == "caption":
                caption = _joined(caption, (yield self.block(part, False, indent, tables)))
            elif part.tag not in ("col", "colgroup"):
                other = _joined(other, (yield self.loose(part, indent, tables)))
        grid: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}
        for row in rows:
            cells: dict[int, list[str]] = {}
            column = 0
            covered = {c for c, n in taken.items() if n > 0}
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            for cell in row.children:
                if isinstance(cell, str) or self.hidden(cell):
                    other += [cell.strip()] if isinstance(cell, str) and cell.strip() else []
                    continue
                if cell.tag not in ("td", "th"):
                    other = _joined(other, (yield self.loose(cell, indent, tables)))
                    continue
                found = yield self.block(cell, False, indent, tables)
                if tables > _MAX_TABLES:
                    below = _joined(below, found)
                    continue
                while column in covered:
                    column += 1
                cells[column] = list(found)
                width = min(self.number(cell.attributes.get("colspan")), _MAX_SPAN)
                height = self.number(cell.attributes.get("rowspan"))
                for c in range(column, column + width):
                    if height > 1:
                        taken[c] = height - 1
                column += width
            grid.append(cells)
        # Longer lines stay whole and do not widen their column.
        widths: dict[int, int] = defaultdict(int)
        shown: dict[int, bool] = defaultdict(bool)
        for cells in grid:
            for c, lines in cells.items():
                shown[c] |= bool(lines)
                widths[c] = max([widths[c], *(len(x) for x in lines if len(x) <= _MAX_COLUMN)])
        starts: dict[int, int] = {}
        at = 0
        for c in sorted(c for c, filled in shown.items() if filled):
            if at > _MAX_ALIGNED // tables:
                break
            starts[c] = at
            at += widths[c] + 2
        out = []
        for cells in grid:
            columns = sorted(cells)
            for i in range(max((len(x) for x in cells.values()), default=0)):
                line = ""
                for c in columns:
                    text = cells[c][i] if i < len(cells[c]) else ""
                    if text:
                        # To the column's start, or two spaces on where the line is there already or columns have ended.
                        line = max(line + "  " if line else "", line.ljust(starts.get(c, 0)), key=len) + text
                out.append(line.rstrip())
        return _joined(_joined(_joined(caption, other), below), out)


def rendered(html: str | None) -> tuple[str, int, int]:
    """Visible text, tables and list items of a page; a missing page is empty."""
    if not html:
        return "", 0, 0
    page = Renderer(html)
    return page.text, page.tables, page.items


def render(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text``, ``n_chars``, ``n_tables`` and ``n_items`` to pages, in place of the html.

    All text a reader would see is kept, in order: not scripts, heads, comments, closed
    details, or what attributes and simple style rules hide. A closed choice shows its
    chosen option, an open one all; text areas keep their lines. Labels of drawings are
    lines, formulas their symbols in order; text that a drawing shows by reference, and
    what stands in one-line inputs, is not rendered. Blocks stand on lines of
    their own, paragraphs apart; list items are marked and indented; table cells are
    aligned in columns. A missing or empty page has an empty text. Markup that is not
    closed or nested wrongly is repaired, at any depth. Columns with the new names are
    replaced.

    White space is bounded, so that the text grows with the page: cells are aligned up
    to 60 characters (longer ones stay whole and push on what follows) in columns that
    start within the first 240, in the n-th nested table 240 / n; others follow two
    spaces on. Indents end at 1,000 columns, spans at 1,000 cells; cells of tables
    within 100 tables are lines, and inline elements within 2,000 blocks start lines.
    """

    def f(html: pa.Array) -> list:
        found = [rendered(h) for h in html.to_pylist()]
        return [[t for t, _, _ in found], [len(t) for t, _, _ in found], [n for _, n, _ in found], [n for _, _, n in found]]

    return with_arrays(pages, [html_col], fields("text string, n_chars long, n_tables long, n_items long"), lambda: f, drop=[html_col])
