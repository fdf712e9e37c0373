"""4. HTML extraction by layout-aware rendering.

A page's tags build a tree, with the end tags that HTML lets authors leave out and the elements that cannot stand in
a paragraph. A walk over the tree lays it out: what is not displayed gives nothing, blocks stand on lines of their own
with the space that their kind has, list items get bullets or numbers by depth, preformatted text keeps its white
space, and table cells stand in columns, spanned ones as well.

Not displayed is what browsers don't display: scripts, styles, templates, closed dialogs, elements with the attribute
hidden, and those whose style attribute or a style sheet says so; invisible text is left out likewise, but a visible
element in it is not. Of a style sheet count the rules for a tag, classes and ids of one element (`div.a.b#c`), by
`!important`, specificity and order, at the top or in `@media screen` or `all` without a condition; those that
look at other elements or states, and other @-rules, don't.

Both passes go forward once and hold an explicit stack, so that time and output grow with the page and no depth is a
limit. Layout that could blow a page up is bounded, and no text is lost by it: indents stop at INDENTS characters,
cells over WIDEST characters don't widen their column, no line is padded beyond PADDED characters, a table inside NESTED
others is laid out in lines, and a cell spans at most ROWS rows and COLUMNS columns.

Defined results: null or empty html gives empty text and zero counts; broken markup never fails, unknown tags are
inline, a tag without its end is text, and quotes mean nothing from a value on that has no end; repeated rows get
equal results; an empty table gives an empty result. Other columns pass through extract_text(), whatever their names,
but one that has the name of a result is replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from mediaweave.llm.common import map_rows, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe noembed noframes canvas audio video rp".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
IN_PICTURES = frozenset("title desc defs metadata style script".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption center".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
INDENTED = frozenset("dd blockquote ul ol".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot".split())
#: A start tag closes open elements of these names that stand inside of the bounds.
ROW_PARTS = ("tr", "td", "th", "caption")
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "table", "td", "th", "blockquote", "section", "article")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "tr": (ROW_PARTS, ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", *ROW_PARTS), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", *ROW_PARTS), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", *ROW_PARTS), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SCOPES = ("table", "td", "th", "caption", "button")
INDENT, INDENTS, WIDEST, PADDED, NESTED, ROWS, COLUMNS = "  ", 80, 40, 160, 6, 200, 1000
BETWEEN = " | "
RESULTS = "text string, n_blocks long, n_tables long, n_items long"

# possessive, so that no tag is read twice
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++)))?+""")
STYLED = re.compile(r"hidden|style|class|id\b|open|span|start|value", re.I)
RULE = re.compile(r"(?<![\w-])(display|visibility)\s*+:\s*+([a-z-]++)(\s*+!\s*+important\b)?+", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"(\*|[a-z][a-z0-9]*+)?+((?:[.#][\w-]++)*+)", re.I)
SCREEN = re.compile(r"@media\s++(?:[^,]*+,)*?\s*+(?:only\s++)?+(?:screen|all)\s*+(?:,.*+)?+", re.I | re.S)
WHITE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = "") -> None:
        self.name, self.attributes, self.children = name, attributes, []

    def values(self) -> dict[str, str]:
        """Attributes by name; the first of a name counts."""
        found: dict[str, str] = {}
        if STYLED.search(self.attributes):
            for m in ATTRIBUTE.finditer(self.attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        return found


class Builder:
    """The tree, with the open elements on a stack and the places of each name on it."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def last(self, names) -> int:
        return max((x[-1] for n in names if (x := self.places.get(n))), default=0)

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().name].pop()

    def close(self, names, bounds) -> None:
        """Closes the outermost open element of the names that is inside of the last bound."""
        bound = self.last(bounds)
        inside = [x[i] for n in names if (x := self.places.get(n)) and (i := bisect_right(x, bound)) < len(x)]
        if inside:
            self.cut(min(inside))

    def text(self, part: str) -> None:
        if part:
            if len(self.open) == 2 and self.open[1].name == "head" and not part.isspace():
                self.cut(1)
            self.open[-1].children.append(part)

    def end(self, name: str) -> None:
        found = self.places.get(name)
        if not found:
            if name == "br":
                self.open[-1].children.append(Node("br"))
        elif name in TABLE_PARTS or found[-1] > self.last(("table", "td", "th")):
            self.cut(found[-1])

    def start(self, name: str, attributes: str) -> Node:
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        elif len(self.open) > 1 and self.open[1].name == "head" and name not in IN_HEAD:
            self.cut(1)
        if name in ENDS_P and self.places.get("p"):
            self.close(("p",), SCOPES)
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        closed = attributes.endswith("/") and (self.places.get("svg") or self.places.get("math") or name in ("svg", "math"))
        if name not in VOID and name not in RAW and not closed:
            self.places.setdefault(name, []).append(len(self.open))
            self.open.append(node)
        return node


def tree(source: str) -> tuple[Node, list[str]]:
    """The tree of a page and its style sheets."""
    to, at, n, last, sheets, strict = Builder(), 0, len(source), source.rfind(">"), [], TAG.match
    while at < n:
        lt = source.find("<", at)
        if lt < 0 or lt > last and not source.startswith("<!--", lt):  # no tag ends any more
            to.text(html.unescape(source[at:]))
            break
        then = source[lt + 1 : lt + 2]
        if then.isascii() and then.isalpha() or then == "/" and source[lt + 2 : lt + 3].isascii() and source[lt + 2 : lt + 3].isalpha():
            to.text(html.unescape(source[at:lt]))
            m = strict(source, lt)
            if m is None:
                strict = LOOSE.match
                m = strict(source, lt)
            at, name = m.end(), m[2].lower()
            if m[1]:
                to.end(name)
            elif name != "html" and not (name == "body" and to.places.get("body")):
                node = to.start(name, m[3])
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
                    raw, at = (source[at : end.start()], end.end()) if end else (source[at:], n)
                    node.children.append(html.unescape(raw) if name == "textarea" else raw)
                    if name == "style":
                        sheets.append(raw)
        elif then and then in "!?/":
            to.text(html.unescape(source[at:lt]))
            end = source.find("-->", lt + 2) if source.startswith("<!--", lt) else source.find(">", lt)
            at = n if end < 0 else end + (3 if source.startswith("<!--", lt) else 1)
        else:
            to.text(html.unescape(source[at : lt + 1]))
            at = lt + 1
    return to.root, sheets


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """What declarations say of display and visibility, and whether it is important; the last counts, of important ones if
    there are any."""
    found: dict[str, tuple[bool, str]] = {}
    for m in RULE.finditer(style):
        name, important = m[1].lower(), bool(m[3])
        if important or not found.get(name, (False,))[0]:
            found[name] = important, m[2].lower()
    return found


class Rules:
    """Style sheets' rules, each kept under that of its tag, classes and ids that the fewest others are kept under."""

    def __init__(self, sheets: list[str]) -> None:
        self.kept: dict[str, list] = {}
        self.known: dict[tuple, dict] = {}
        self.n = 0
        for sheet in sheets:
            heads: list[str] = []
            parts = re.split(r"([{}])", COMMENT.sub(" ", sheet) + "}}")  # what is open ends with the sheet
            for i in range(0, len(parts) - 1, 2):
                if parts[i + 1] == "{":
                    heads.append(parts[i].rsplit(";", 1)[-1].strip())
                elif heads:
                    head = heads.pop()
                    if not head.startswith("@") and len(heads) < 2 and all(map(SCREEN.fullmatch, heads)) and (said := declared(parts[i])):
                        self.add(head, said)

    def __len__(self) -> int:
        return self.n

    def add(self, selectors: str, said: dict) -> None:
        for m in filter(None, map(SELECTOR.fullmatch, map(str.strip, selectors.split(",")))):
            tag, marks = (m[1] or "").lower().strip("*"), re.findall(r"[.#][\w-]+", m[2])
            if not m[0]:
                continue
            self.n += 1
            ids = sum(x[0] == "#" for x in marks)
            needs = frozenset([*([tag] if tag else []), *marks])
            key = min(sorted(needs), key=lambda x: len(self.kept.get(x, ())), default="*")
            self.kept.setdefault(key, []).append((needs, (ids, len(marks) - ids, bool(tag), self.n), said))

    def of(self, name: str, classes: str, id_: str | None) -> dict[str, tuple]:
        """By property: (important, specificity and order), and the value."""
        asked = (name, classes, id_)
        if asked not in self.known:
            has = {name, *("." + x for x in classes.split()), *(["#" + id_] if id_ else [])}
            found: dict[str, tuple] = {}
            for key in ("*", *has):
                for needs, weight, said in self.kept.get(key, ()):
                    if needs <= has:
                        for what, (important, value) in said.items():
                            found[what] = max(found.get(what, ((False, ()), "")), ((important, weight), value))
            self.known[asked] = found
        return self.known[asked]


class Lines:
    """Text that is being laid out: words flow, blocks break lines, spaced blocks leave one empty line. Inner blocks are
    levels, with what stands before their first line and before the others."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.levels: list[list] = []  # mark, whether a line of it is done, what stands before the others
        self.gap = self.blank = False

    def word(self, part: str, pre: bool = False) -> None:
        if pre:
            *full, rest = part.split("\n")
            for x in full:
                self.line.append(x)
                self.break_(keep=True)
            self.line.append(rest)
            return
        words = WHITE.split(part)
        if not words[0]:
            self.gap = True
        for i, w in enumerate(words):
            if w:
                if (i or self.gap) and self.line and self.line[-1][-1:] != " ":
                    self.line.append(" ")
                self.line.append(w)
                self.gap = False
        self.gap = self.gap or not words[-1]

    def put(self, line: str) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        new = len(self.levels)
        while new and not self.levels[new - 1][1]:
            new -= 1
            self.levels[new][1] = True
        before = self.levels[new - 1][2] if new else ""
        self.done.append(f"{before}{''.join(x[0] for x in self.levels[new:])}{line}".rstrip())

    def break_(self, keep: bool = False) -> None:
        whole = "".join(self.line)
        if keep or whole.strip():
            self.put(whole)
        self.line, self.gap = [], False

    def space(self) -> None:
        self.break_()
        if not self.levels or self.levels[-1][1]:  # none before a level's first line
            self.blank = True

    def enter(self, mark: str = "") -> None:
        before = self.levels[-1][2] if self.levels else ""
        self.levels.append([mark, False, before + " " * len(mark) if len(before) < INDENTS else before])

    def leave(self, keep: bool = False) -> None:
        self.break_()
        if keep and not self.levels[-1][1]:
            self.put("")
        if self.levels.pop()[1]:
            self.blank = False


def number(text: str | None, least: int, most: int, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(max(int(m[1]), least), most) if m else default


class Grid:
    """A table's cells by row and column."""

    def __init__(self) -> None:
        self.titles: list[str] = []
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # first column, columns, lines
        self.spanned: list[tuple[int, int, int]] = []  # columns that cells above still use: first, end, last row
        self.below: list[tuple[int, int, int]] = []  # those that this row's cells use further down

    def cell(self, lines: list[str], values: dict[str, str]) -> None:
        if not self.rows:
            self.rows.append([])
        row, at = self.rows[-1], 0
        if row:
            at = row[-1][0] + row[-1][1]
        else:
            self.spanned = sorted(x for x in self.spanned if x[2] >= len(self.rows))
        width = number(values.get("colspan"), 1, COLUMNS, 1)
        for first, end, _ in self.spanned[max(bisect_left(self.spanned, (at, 0, 0)) - 1, 0) :]:
            if first > at:
                break
            at = max(at, end)
        row.append((at, width, lines))
        if (rows := number(values.get("rowspan"), 1, ROWS, 1)) > 1:
            self.below.append((at, at + width, len(self.rows) + rows - 1))

    def row(self) -> None:
        self.rows.append([])
        self.spanned += self.below
        self.below = []

    def lines(self) -> list[str]:
        starts = sorted({c for row in self.rows for c, _, _ in row})
        widths = [0] * len(starts)
        for row in self.rows:
            for c, n, lines in row:
                if n == 1:
                    widths[bisect_left(starts, c)] = max(widths[bisect_left(starts, c)], max((len(x) for x in lines if len(x) <= WIDEST), default=0))
        begin = [0]
        for w in widths:
            begin.append(min(begin[-1] + w + len(BETWEEN), PADDED))
        out = list(self.titles)
        for row in self.rows:
            below: dict[int, list[tuple[int, str]]] = {}
            line, columns = [], 0
            size = 0
            for c, n, lines in row:
                k = bisect_left(starts, c)
                while columns < k and size < begin[k]:  # columns that cells above span
                    line.append(" " * max(begin[columns + 1] - len(BETWEEN) - size, 0) + BETWEEN)
                    size, columns = size + len(line[-1]), columns + 1
                columns = bisect_left(starts, c + n)
                first = lines[0] if lines else ""
                line.append((first.ljust(begin[columns] - len(BETWEEN) - size) if begin[columns] < PADDED else first) + BETWEEN)
                size += len(line[-1])
                for i, x in enumerate(lines[1:], 1):
                    below.setdefault(i, []).append((begin[k], x))
            if row:
                out.append("".join(line)[: -len(BETWEEN)].rstrip())
            for i in sorted(below):
                text = ""
                for at, x in below[i]:
                    text = text.ljust(at) + x if len(text) <= at else f"{text} {x}"
                out.append(text)
        return out


class Frame:
    __slots__ = ("node", "children", "pre", "shown", "number", "grid", "lines", "leave")

    def __init__(self, node, pre, shown, grid, lines, leave=None) -> None:
        self.node, self.children, self.pre, self.shown, self.grid, self.lines, self.leave = node, iter(node.children), pre, shown, grid, lines, leave
        self.number = 1


class Page:
    def __init__(self, source: str) -> None:
        self.blocks = self.tables = self.items = self.nested = 0
        self.pictures = 0
        root, sheets = tree(source)
        self.rules = Rules(sheets)
        self.out = Lines()
        self.todo = [Frame(root, False, True, None, self.out)]
        while self.todo:
            frame = self.todo[-1]
            for child in frame.children:
                if not isinstance(child, str):
                    if self.enter(child, frame):
                        break
                elif frame.grid is not None:
                    if frame.shown and (words := WHITE.sub(" ", child).strip()):
                        frame.grid.titles.append(words)
                elif frame.shown:
                    frame.lines.word(child, frame.pre)
            else:
                self.todo.pop()
                if frame.leave:
                    frame.leave()
        self.out.break_()

    def said(self, node: Node, values: dict[str, str]) -> dict[str, str]:
        """What styles say of display and visibility: a style attribute before all rules but important ones."""
        found = self.rules.of(node.name, values.get("class", ""), values.get("id")) if self.rules else {}
        said = {what: value for what, (_, value) in found.items()}
        for what, (important, value) in declared(values.get("style", "")).items():
            if important or not found.get(what, ((False,),))[0][0]:
                said[what] = value
        return said

    def enter(self, node: Node, above: Frame) -> bool:
        """Starts a child; whether its own children come next."""
        name, values = node.name, node.values() if node.attributes else {}
        if name in HIDDEN or self.pictures and name in IN_PICTURES or "hidden" in values or name == "dialog" and "open" not in values:
            return False
        said = self.said(node, values) if self.rules or values else {}
        if said.get("display") == "none":
            return False
        shown = said["visibility"] not in ("hidden", "collapse") if said.get("visibility", "inherit") != "inherit" else above.shown
        lines, grid, pre = above.lines, above.grid, above.pre
        go = lambda leave=None, **other: self.todo.append(Frame(node, pre, shown, other.get("grid"), other.get("lines", lines), leave)) or True
        if grid is not None:
            if name == "tr":
                grid.row()
                return go(grid=grid)
            if name in SECTIONS:
                return go(grid=grid)
            if name == "colgroup":
                return False
            inner = Lines()

            def done() -> None:
                inner.break_()
                grid.cell(inner.done, values) if name in CELLS else grid.titles.extend(inner.done)

            if name in CELLS or name == "caption":
                return go(done, lines=inner)
            self.todo.append(Frame(Node("", ""), pre, shown, None, inner, done))  # what has no place in a table stands before it
            self.todo[-1].children = iter([node])
            return True
        if name == "br":
            if shown:
                lines.break_(keep=True)
            return False
        if name == "table":
            self.tables += 1
            lines.space()
            if self.nested < NESTED:
                made, self.nested = Grid(), self.nested + 1

                def laid() -> None:
                    self.nested -= 1
                    lines.enter()
                    for x in made.lines():
                        lines.put(x)
                    lines.leave()
                    lines.space()

                return go(laid, grid=made)
            return go(lines.space)
        if name == "li":
            self.items += 1
            lines.break_()
            mark = "- "
            if above.node.name == "ol":
                above.number = number(values.get("value"), -(10**9), 10**9, above.number)
                mark, above.number = f"{above.number}. ", above.number + 1
            lines.enter(mark)
            return go(lambda: lines.leave(keep=shown))
        if name in INDENTED:
            self.blocks += 1
            tight = above.node.name == "li" or name == "dd"
            lines.break_() if tight else lines.space()
            lines.enter(INDENT if name in ("dd", "blockquote") else "")
            go(lambda: (lines.leave(), None if tight else lines.space()))
            self.todo[-1].number = number(values.get("start"), -(10**9), 10**9, 1)
            return True
        if name in BLOCKS:
            self.blocks += 1
            apart = lines.space if name in SPACED else lines.break_
            if name in CELLS and lines.line:  # of a table that is laid out in lines
                lines.word(BETWEEN)
                apart = lambda: None
            elif name in CELLS:
                apart = lambda: None
            apart()
            pre = pre or name == "pre"
            return go(apart)
        if name in ("option", "optgroup"):
            lines.gap = True
        if name in ("svg", "math"):
            self.pictures += 1

            def left() -> None:
                self.pictures -= 1

            return go(left)
        return go()


def render(source: str | None) -> tuple[str, int, int, int]:
    page = Page(source or "")
    return "\n".join(page.out.done).strip("\n"), page.blocks, page.tables, page.items


def _render(batches, names: list[str], out: list[str]):
    for batch in batches:
        cols = list(zip(*map(render, batch.column("html").to_pylist()), strict=True)) or [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(cols, [pa.string()] + [pa.int64()] * 3, strict=True)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), *arrays], names=out)


def extract_text(pages: DataFrame) -> DataFrame:
    """pages: html. Adds text, n_blocks, n_tables, n_items."""
    return map_rows(pages, "html", _render, RESULTS)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).drop("html")
