"""Visible text of HTML pages, laid out as a text browser would.

A scanner feeds a tree builder that closes what HTML leaves implied (head and colgroup before what they cannot
hold, p before blocks, li, dt/dd, option, table parts), moves what stands loose between the parts of a table
before it, and ignores end tags without a start. Not shown are head, script, style, template and the like, elements with
``hidden`` or ``display:none``, dialogs and details that are not open (but for the summary); text under ``visibility:hidden`` is not
shown unless an element inside of it is ``visible`` again. The renderer collapses white space as inline layout does, puts blocks on lines of
their own (with an empty line around paragraphs, headings, lists, tables), marks list items with
``-`` or numbers and indents nested lists, keeps ``pre`` as written, and aligns table cells in columns, with row and column spans.

Trees of any depth are followed, by stacks and not by recursion, and time and memory are linear in the page: open elements are
found by tag, and a tag that never ends is looked for once. Three limits of the layout keep the result in
proportion to the page, none of which loses text: indents grow up to ``INDENT`` characters; tables inside of ``TABLES`` others
are not aligned; nor are tables whose padding would outweigh their text by far (``PADDING``), nor cells from column ``COLUMNS`` on,
the largest span that HTML has.

Null pages give null text; pages without visible text give an empty one. No page raises an error, whatever its markup. Other columns pass
through, but for one of the name of the result; repeated rows give the same result, empty tables an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDENT, TABLES, COLUMNS = 64, 6, 1000
#: Padding is allowed up to so many times the text of a table, and so many characters besides.
PADDING = (8, 4096)
#: The largest row span of HTML.
ROWS = 65_534

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is text, whatever it looks like; in the first ones character references count.
ESCAPED = {"textarea", "title"}
RAW = ESCAPED | set("script style noscript iframe xmp noembed noframes".split())
FOREIGN = {"svg", "math"}
HIDDEN = set("head script style template title noscript iframe noembed noframes object datalist colgroup col audio video canvas rp defs symbol metadata desc annotation annotation-xml".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure form fieldset hr".split())
BLOCK = SPACED | set("html body div section article nav header footer main aside address li dt dd tr caption thead tbody tfoot td th figcaption details summary option legend center dialog".split())
ENDS_P = BLOCK - set("html body td th tr li dt dd option thead tbody tfoot caption".split()) | {"li", "dt", "dd"}
#: A start tag closes these open elements, looking no further out than the given ones.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: These end before text and before any start tag but the given ones.
HOLDS = {"head": set("base basefont bgsound link meta noframes noscript script style template title".split()), "colgroup": {"col", "template"}}
SECTIONS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}
PARTS = SECTIONS | CELLS | {"tr", "caption", "colgroup"}
#: What may stand between the parts of a table.
BETWEEN = PARTS | {"col", "script", "style", "template"}
BARRIER = {"table", "td", "th", "caption", "button", "template"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*>")
_SKIP = re.compile(r"[\s/]*")
_ATTR = re.compile(r"""(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_QUOTE = re.compile(r"""\s*=\s*(?=["'])""")
_SPACES = re.compile(r"[ \t\n\r\f\u00a0]+")
_INT = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]+)")


def number(text: str | None, default: int, low: int, high: int) -> int:
    """The integer a value begins with, brought into the bounds; the default if there is none."""
    m = _INT.match(text or "")
    return default if not m else min(max(int(m[1][:12]), low), high)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Scanner:
    """Tokens of a page: ("text", text, None), ("raw", text, None), ("start", name, attributes), ("close", name, attributes) for <name/>, ("end", name, None)."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.quotes = True  # until one is found that never ends

    def tag(self, i: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from place i on, whether the tag ends in a slash, and the place behind it; the end of the page if it has no end."""
        html, attrs = self.html, {}
        if i > self.last:
            return attrs, False, len(html)
        plain = _PLAIN.match(html, i)
        end = plain.end() - 1 if plain else -1 if self.quotes else html.find(">", i)
        at = i
        while True:
            at = _SKIP.match(html, at).end()
            if at >= len(html) or (end >= 0 and at >= end) or html[at] == ">":
                break
            m = _ATTR.match(html, at)
            if 0 <= end < m.end():
                break
            if self.quotes and m[2] is m[3] is m[4] is None and self._open_quote(m.end()):
                self.quotes = False
                return self.tag(i)
            attrs.setdefault(m[1].lower(), unescape(next((v for v in (m[2], m[3], m[4]) if v is not None), "")))
            at = m.end()
        at = end if end >= 0 else at
        return attrs, html[at - 1] == "/", min(at + 1, len(html))

    def _open_quote(self, at: int) -> bool:
        """Whether a value begins here with a quote that never ends."""
        m = _QUOTE.match(self.html, at)
        return bool(m) and self.html.find(self.html[m.end()], m.end() + 1) < 0

    def tokens(self) -> Iterator[tuple[str, str, dict | None]]:
        html, i = self.html, 0
        n = len(html)
        while i < n:
            j = html.find("<", i)
            if j < 0:
                yield "text", html[i:], None
                return
            if j > i:
                yield "text", html[i:j], None
            if html.startswith("<!--", j):
                if html.startswith((">", "->"), j + 4):
                    i = html.index(">", j) + 1
                else:
                    k = html.find("-->", j + 4)
                    i = n if k < 0 else k + 3
            elif html.startswith(("<!", "<?"), j):
                k = html.find(">", j)
                i = n if k < 0 else k + 1
            elif m := _NAME.match(html, j + 2 if html.startswith("/", j + 1) else j + 1):
                name = m[0].lower()
                attrs, slash, i = self.tag(m.end())
                if html[j + 1] == "/":
                    yield "end", name, None
                    continue
                yield "close" if slash else "start", name, attrs
                if name in RAW:
                    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, i)
                    text = html[i : found.start() if found else n]
                    yield "raw", unescape(text) if name in ESCAPED else text, None
                    yield "end", name, None
                    k = html.find(">", found.end()) if found else -1
                    i = n if k < 0 else k + 1
            elif html.startswith("</", j) and j + 2 < n:
                k = html.find(">", j)
                i = n if k < 0 else k + 1
            else:
                yield "text", "<", None
                i = j + 1


class Builder:
    """The tree of a page. Open elements are also kept by tag, so that none is looked for along the whole stack."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def cut(self, k: int) -> None:
        """Closes the open elements from place k on."""
        while len(self.open) > max(k, 1):
            self.at[self.open.pop().tag].pop()

    def find(self, tags: set[str]) -> int:
        """The place of the innermost open element of these tags; 0: there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: set[str], stop: set[str]) -> None:
        k = self.find(tags)
        if k and k >= self.find(stop):
            self.cut(k)

    def loose_in(self) -> int:
        """The place of the table between whose parts the next node would stand; 0: in none."""
        k = len(self.open) - 1
        while self.open[k].tag in SECTIONS or self.open[k].tag == "tr":
            k -= 1
        return k if self.open[k].tag == "table" else 0

    def add(self, x: Node | str, table: int) -> None:
        if table:
            self.open[table - 1].children.insert(-1, x)  # an open table is its parent's last child
        else:
            self.open[-1].children.append(x)

    def text(self, text: str) -> None:
        loose = text.strip(" \t\n\r\f")
        if loose and self.open[-1].tag in HOLDS:
            self.cut(len(self.open) - 1)
        self.add(text, self.loose_in() if loose else 0)

    def end(self, name: str) -> None:
        stop = set() if name in BARRIER else {"table"} if name == "tr" or name in SECTIONS else BARRIER
        if name == "p" and not self.at.get("p"):
            self.open[-1].children.append(Node("p", {}))
        self.close({name}, stop)

    def start(self, name: str, attrs: dict[str, str], empty: bool) -> None:
        foreign = self.find(FOREIGN) > 0
        if self.open[-1].tag in HOLDS and name not in HOLDS[self.open[-1].tag]:
            self.cut(len(self.open) - 1)
        if name in ENDS_P:
            self.close({"p"}, BARRIER)
        at = self.find({"table", "template"}) if name in PARTS else 0
        if at and self.open[at].tag == "table":
            at += 1
            if name not in SECTIONS and name not in ("caption", "colgroup") and at < len(self.open) and self.open[at].tag in SECTIONS:
                at += 1
            if name in CELLS and at < len(self.open) and self.open[at].tag == "tr":
                at += 1
            self.cut(at)
            if name in CELLS and self.open[-1].tag != "tr":
                row = Node("tr", {})
                self.open[-1].children.append(row)
                self.push(row)
        elif name in CLOSES:
            tags, stop = CLOSES[name]
            if name == "tr" or name in SECTIONS:
                while len(self.open) > 1 and self.open[-1].tag in tags:
                    self.cut(len(self.open) - 1)
            self.close(tags, stop)
        node = Node(name, attrs)
        loose = 0 if name in BETWEEN else self.loose_in()
        if loose and name == "table":
            self.cut(loose)
            loose = 0
        self.add(node, loose)
        if name not in VOID and not (empty and (foreign or name in FOREIGN)) and not (loose and name == "form"):
            self.push(node)


def tree(html: str) -> Node:
    b = Builder()
    for kind, name, attrs in Scanner(html).tokens():
        if kind == "text":
            b.text(unescape(name))
        elif kind == "raw":
            b.add(name, 0)
        elif kind == "end":
            b.end(name)
        else:
            b.start(name, attrs, kind == "close")
    return b.root


def style_of(attrs: dict[str, str]) -> dict[str, str]:
    """Display and visibility as the style attribute has them: the last one counts, an important one before others."""
    out, firm = {}, set()
    for part in attrs.get("style", "").lower().split(";"):
        name, _, value = (x.strip() for x in part.partition(":"))
        important = value.endswith("important") and "!" in value
        if name in ("display", "visibility") and value and (important or name not in firm):
            out[name] = value.partition("!")[0].strip()
            firm |= {name} if important else set()
    return out


def seen(node: Node, visible: bool) -> bool | None:
    """Whether text directly in the element is visible; None: nothing inside it is shown."""
    a = node.attrs
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return None
    if not a:
        return visible
    style = style_of(a) if "style" in a else {}
    if style.get("display") == "none" or ("hidden" in a and "display" not in style):
        return None
    v = style.get("visibility")
    return v == "visible" if v in ("visible", "hidden", "collapse") else visible


class Page:
    """Lines of text, with what is due before the next one: space, empty lines, indent, marks of list items."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.gap, self.indent = False, 0, 0
        self.marks: list[tuple[int, str]] = []
        self.fresh = True  # no line yet in the innermost item, quote or cell

    def inline(self, text: str) -> None:
        body = _SPACES.sub(" ", text)
        bare = body.strip(" ")
        if not bare:
            self.space |= bool(body)
            return
        if self.now and (self.space or body[0] == " "):
            self.now.append(" ")
        self.now.append(bare)
        self.space = body[-1] == " "

    def end_line(self, gap: int = 0) -> None:
        """Ends the line; ``gap`` empty lines are due before the next text."""
        if self.now:
            self.put(["".join(self.now)])
            self.now = []
        self.space = False
        if not self.fresh:
            self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap, self.fresh = 0, False
        for s in lines:
            if s and self.marks:
                at, line = 0, []
                for col, mark in self.marks:
                    line.append(" " * (min(col, INDENT) - min(at, INDENT)) + mark)
                    at = col + len(mark)
                self.lines.append("".join(line) + " " * (min(self.indent, INDENT) - min(at, INDENT)) + s)
                self.marks = []
            else:
                self.lines.append(" " * min(self.indent, INDENT) + s if s else s)

    def enter(self, mark: str) -> tuple:
        """Begins an item or quote; what is due before it stays due, what its own blocks ask for before its first line does not."""
        self.end_line()
        state = (self.fresh, self.indent, len(mark), bool(mark.strip()))
        if state[3]:
            self.marks.append((self.indent, mark))
        self.indent += len(mark)
        self.fresh = True
        return state

    def leave(self, state: tuple) -> None:
        self.end_line()
        fresh, self.indent, _, marked = state
        if self.fresh:
            if marked and self.marks:
                self.marks.pop()
            self.fresh = fresh
        else:
            self.gap = 0


class Grid:
    """Cells of one table by row and column."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.taken: np.ndarray | None = None  # by column, the row before which a row span keeps it
        self.col = 0

    def new_row(self) -> None:
        self.rows.append([])
        self.col = 0

    def place(self, lines: list[str], colspan: int, rowspan: int) -> None:
        r = len(self.rows) - 1
        if self.taken is not None and self.col < COLUMNS:
            free = self.taken[self.col :] <= r
            self.col += int(free.argmax()) if free.any() else COLUMNS - self.col
        self.rows[-1].append((self.col, lines))
        if rowspan != 1 and self.col < COLUMNS:
            if self.taken is None:
                self.taken = np.zeros(COLUMNS, np.int64)
            self.taken[self.col : self.col + colspan] = r + (rowspan or ROWS)
        self.col += colspan

    def end_section(self) -> None:
        self.taken = None  # row spans end with their section

    def text(self) -> list[str]:
        rows = [r for r in self.rows if any(lines for _, lines in r)]
        width: dict[int, int] = {}
        for r in rows:
            for c, lines in r:
                if lines and c < COLUMNS:
                    width[c] = max(width.get(c, 0), max(map(len, lines)))
        cols = sorted(width)
        height = [max((len(lines) for _, lines in r), default=0) for r in rows]
        own = sum(len(s) for r in rows for _, lines in r for s in lines)
        start, at = {}, 0
        for c in cols:
            start[c] = at
            at += width[c] + 2
        needed = sum(h * max((start[c] for c, lines in r if lines and c < COLUMNS), default=0) for h, r in zip(height, rows, strict=True))
        aligned = needed <= PADDING[0] * own + PADDING[1]
        out = []
        for h, r in zip(height, rows, strict=True):
            held = [(start.get(c) if aligned else None, lines) for c, lines in r if lines]
            parts: list[list[str]] = [[] for _ in range(h)]
            length = [0] * h
            for x, lines in held:
                for i, s in enumerate(lines):
                    gap = 2 if parts[i] else 0
                    if x is not None:
                        gap = max(x - length[i], gap)
                    parts[i].append(" " * gap + s)
                    length[i] += gap + len(s)
            out += ["".join(p).rstrip() for p in parts]
        return out


#: Steps of the renderer besides a node or text to show.
END, LEAVE, PRE, ITEM, CELL, CELL_END, ROW, SECTION, GRID = range(9)


class Renderer:
    def __init__(self):
        self.page = Page()
        self.raw: list[str] | None = None  # text of the pre we are in
        self.tables = 0
        self.todo: list = []

    def children(self, node: Node, visible: bool, item: bool) -> None:
        self.todo += [(x, visible, item) for x in reversed(node.children)]

    def run(self, root: Node) -> str:
        self.children(root, True, False)
        while self.todo:
            x, *more = self.todo.pop()
            if isinstance(x, int):
                self.step(x, *more)
            elif isinstance(x, str):
                if more[0]:
                    if self.raw is None:
                        self.page.inline(x)
                    else:
                        self.raw.append(x)
            else:
                visible = seen(x, more[0])
                if visible is not None:
                    self.node(x, visible, more[1])
        self.page.end_line()
        return "\n".join(self.page.lines).strip("\n")

    def step(self, kind: int, *more) -> None:
        if kind == END:
            self.page.end_line(more[0])
        elif kind == LEAVE:
            self.page.leave(more[0])
        elif kind == PRE:
            text, self.raw = "".join(self.raw).strip("\n"), None
            if text.strip():
                self.page.put(text.split("\n"))
            self.page.end_line(1)
        elif kind == ROW:
            more[0].new_row()
        elif kind == SECTION:
            more[0].end_section()
        elif kind == ITEM:
            li, mark, visible = more
            self.page.end_line()
            self.todo.append((LEAVE, self.page.enter(mark)))
            self.children(li, visible, True)
        elif kind == CELL:
            cell, grid, visible = more
            self.page.end_line()
            if grid:
                self.todo.append((CELL_END, grid, self.page, number(cell.attrs.get("colspan"), 1, 1, COLUMNS), number(cell.attrs.get("rowspan"), 1, 0, ROWS)))
                self.page = Page()
            else:
                self.todo.append((END, 0))
            self.children(cell, visible, False)
        elif kind == CELL_END:
            grid, outer, colspan, rowspan = more
            self.page.end_line()
            grid.place([s for s in self.page.lines if s], colspan, rowspan)
            self.page = outer
        elif kind == GRID:
            self.tables -= 1
            out = more[0].text()
            if out:
                self.page.put(out)
            self.page.end_line(1)

    def node(self, x: Node, visible: bool, item: bool) -> None:
        page, tag = self.page, x.tag
        if self.raw is not None:  # pre keeps its text as written, whatever elements it holds
            if tag == "br":
                self.raw.append("\n")
            self.children(x, visible, item)
        elif tag == "br":
            if page.now:
                page.end_line()
            elif not page.fresh:
                page.put([""])
        elif tag not in BLOCK:
            self.children(x, visible, item)
        elif tag == "pre":
            page.end_line(1)
            self.raw = []
            self.todo.append((PRE,))
            self.children(x, visible, item)
        elif tag == "hr":
            page.end_line(1)
            page.put(["-" * 20])
            page.end_line(1)
        elif tag in ("blockquote", "dd"):
            gap = int(tag in SPACED)
            page.end_line(gap)
            self.todo += [(END, gap), (LEAVE, page.enter("  "))]
            self.children(x, visible, False)
        elif tag in ("ul", "ol"):
            self.listing(x, visible, item)
        elif tag == "table":
            self.table(x, visible, item)
        elif tag == "details" and "open" not in x.attrs:
            page.end_line()
            self.todo.append((END, 0))
            self.todo += [(c, visible, item) for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1]
        else:
            gap = int(tag in SPACED)
            page.end_line(gap)
            self.todo.append((END, gap))
            self.children(x, visible, item)

    def listing(self, x: Node, visible: bool, item: bool) -> None:
        gap = int(not item)  # inside a list item lists have no empty lines around them
        self.page.end_line(gap)
        at = number(x.attrs.get("start"), 1, -(10**9), 10**9)
        steps: list = []
        for c in x.children:
            if not isinstance(c, Node) or c.tag != "li":
                steps.append((c, visible, item))
                continue
            own = seen(c, visible)
            if own is None:
                continue
            at = number(c.attrs.get("value"), at, -(10**9), 10**9)
            steps.append((ITEM, c, f"{at}. " if x.tag == "ol" else "- ", own))
            at += 1
        self.todo.append((END, gap))
        self.todo += reversed(steps)

    def table(self, x: Node, visible: bool, item: bool) -> None:
        """Captions first, then the rows: into a grid, or, deep inside of other tables, as lines."""
        self.page.end_line(1)
        first, steps = [], []
        grid = Grid() if self.tables < TABLES else None
        for c in x.children:
            shown = seen(c, visible) if isinstance(c, Node) else visible
            if shown is None:
                continue
            if isinstance(c, str) or c.tag not in SECTIONS and c.tag != "tr" and c.tag not in CELLS:
                first.append((c, visible, item))
                continue
            for row, row_shown in self.rows(c, shown):
                steps.append((ROW, grid) if grid else (END, 0))
                for cell in row:
                    own = seen(cell, row_shown)
                    if own is None:
                        continue
                    steps.append((CELL, cell, grid, own))
            if grid and c.tag in SECTIONS:
                steps.append((SECTION, grid))
        self.tables += 1
        self.todo.append((GRID, grid or Grid()))
        self.todo.append((END, 0))
        self.todo += reversed(steps)
        self.todo.append((END, 0))
        self.todo += reversed(first)

    def rows(self, part: Node, visible: bool) -> Iterator[tuple[list[Node], bool]]:
        """The rows of a part of a table, with their visibility."""
        if part.tag in CELLS:
            yield [part], visible
        for row in [part] if part.tag == "tr" else part.children if part.tag in SECTIONS else []:
            shown = visible if row is part else seen(row, visible) if isinstance(row, Node) and row.tag == "tr" else None
            if shown is not None:
                yield [c for c in row.children if isinstance(c, Node) and c.tag in CELLS], shown


def render(html: str) -> str:
    return Renderer().run(tree(html))


def rendered(df: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the markup and ``out``) and the visible text as column ``out``."""
    keep = [c for c in df.columns if c not in (html, out)] if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else render(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(text, pa.string())], names=[*keep, out])

    return df.select(*keep, F.make_valid_utf8(F.col(html).cast("string")).alias("__html")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return rendered(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
