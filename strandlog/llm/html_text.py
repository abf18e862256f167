"""All visible text of a web page, laid out as a browser would show it.

A tree builder reads tags as HTML does (void and raw-text elements, implied end tags, stray end tags),
decides visibility (elements that never show, `hidden`, closed `details` and `dialog`, and what inline styles and the page's
own sheets say of `display` and `visibility`), and a renderer walks the tree: blank lines around
paragraphs and headings, one line for other blocks, markers and indents for lists, kept
white space in `pre`, and table cells padded to common column widths.

Of sheets, rules whose selector is one compound of a tag, classes and an id count, by importance, specificity and
order; blocks for other media than a screen `SCREEN_PX` wide don't.  Numbers in attributes have bounds.

Null html gives null text, empty html an empty text.  Broken markup never fails: what can't be read as a
tag is text.  Nesting depth isn't bounded by Python's stack.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from strandlog.llm.common import add_columns

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
NEVER_SHOWN = frozenset(
    "head script style title template noscript iframe noembed noframes datalist object audio video canvas".split()
)
HEAD_ONLY = frozenset("base link meta noscript script style template title basefont bgsound".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table hr".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form "
    "header hgroup html legend li listing main menu nav optgroup option search section summary".split()
)
CELLS = frozenset(("td", "th"))
ROWS = frozenset(("tr",))
GROUPS = frozenset("thead tbody tfoot".split())

#: A start tag -> the open elements it ends, and the elements that an open one is not sought beyond.
_LIST_EDGE = frozenset("ul ol menu dir table td th html body".split())
_TABLE_EDGE = frozenset(("table", "html"))
IMPLIED_END = {
    "li": (frozenset(("li",)), _LIST_EDGE),
    "dt": (frozenset(("dt", "dd")), frozenset("dl table td th html body".split())),
    "dd": (frozenset(("dt", "dd")), frozenset("dl table td th html body".split())),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "html"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "html"))),
    "td": (CELLS, _TABLE_EDGE | ROWS),
    "th": (CELLS, _TABLE_EDGE | ROWS),
    "tr": (ROWS | CELLS | frozenset(("caption",)), _TABLE_EDGE),
    **{g: (GROUPS | ROWS | CELLS | frozenset(("caption", "colgroup")), _TABLE_EDGE) for g in GROUPS},
}
_PARAGRAPH_EDGE = frozenset("table td th caption button html object template".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_CSS_MARK = re.compile(r"""\"[^"]*+\"|'[^']*+'|[{};]""")
_COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)")
_PART = re.compile(r"[.#][\w-]+")
_DECLARED = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?")
_WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9]{1,6}(?:\.[0-9]*)?)px\s*\)")
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
_WHITE = re.compile(r"[ \t\n\r\f]+")


#: Width of the screen that media queries are asked about.
SCREEN_PX = 1280


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        value = value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else value
        out.setdefault(name.lower(), unescape(value))
    return out


class TreeBuilder:
    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # open elements by tag: most searches of the stack end here
        self.css: list[str] = []

    def _pop_to(self, targets: frozenset[str], edge: frozenset[str]) -> None:
        """End the outermost open element of `targets` that no element of `edge` shields."""
        if not any(self.count[t] for t in targets):
            return
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in targets:
                found = i
            elif tag in edge:
                break
        if found is not None:
            self._close(found)

    def _close(self, at: int, to: int | None = None) -> None:
        at %= len(self.open)
        self.count.subtract(n.tag for n in self.open[at:to])
        del self.open[at:to]

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open[:4]):
            return
        if len(self.open) > 1 and self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._close(-1)
        if tag in IMPLIED_END:
            self._pop_to(*IMPLIED_END[tag])
        elif tag in BLOCK:
            self._pop_to(frozenset(("p",)), _PARAGRAPH_EDGE)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID and not (closed and tag in ("svg", "path", "use", "circle", "rect", "g")):
            self.open.append(node)
            self.count[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
            return
        if tag in ("html", "body") or tag in VOID:
            return
        for i in range(len(self.open) - 1 if self.count[tag] else 0, 0, -1):
            at = self.open[i].tag
            if at == tag:
                if tag in BLOCK or tag in IMPLIED_END or tag == "table" or not any(n.tag in BLOCK for n in self.open[i + 1 :]):
                    self._close(i)
                else:  # an inline element ended across a block: the block stays open
                    self._close(i, i + 1)
                return
            if at in CELLS and tag not in CELLS | ROWS | GROUPS | {"table"}:
                return
        if tag == "p":
            self.start("p", {}, False)
            self._close(-1)

    def text(self, data: str) -> None:
        if not data:
            return
        if self.open[-1].tag == "head" and not data.isspace():
            self._close(-1)
        self.open[-1].children.append(data)


def build(source: str) -> TreeBuilder:
    tree = TreeBuilder()
    at, n, loose, lower = 0, len(source), False, None
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            tree.text(unescape(source[at:]))
            break
        if lt > at:
            tree.text(unescape(source[at:lt]))
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        if source[lt + 1 : lt + 2] in ("!", "?"):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(source, lt + 1)
        if not name:
            tree.text("<")
            at = lt + 1
            continue
        whole = None if loose else _INSIDE.match(source, name.end())
        if whole:
            end = whole.end()
        else:  # a quote that never closes: from here on tags end at the next >
            loose = True
            end = source.find(">", name.end()) + 1
            if not end:
                break
        tag = name[2].lower()
        at = end
        if name[1]:
            tree.end(tag)
            continue
        inside = source[name.end() : end - 1]
        tree.start(tag, _attributes(inside) if inside.strip("/ \n\t") else {}, inside.endswith("/"))
        if tag in RAW or tag in ESCAPABLE:
            lower = lower if lower is not None else source.lower()
            if len(lower) != n:  # a few characters grow in lower case
                lower = "".join(c.lower() if c.isascii() else c for c in source)
            close = lower.find(f"</{tag}", end)
            body = source[end : n if close < 0 else close]
            if tag == "style" and _on_screen(tree.open[-1].attrs.get("media", "")):
                tree.css.append(body)
            tree.text(unescape(body) if tag in ESCAPABLE else body)
            if tree.open[-1].tag == tag:
                tree._close(-1)
            gt = -1 if close < 0 else source.find(">", close)
            at = n if gt < 0 else gt + 1
    return tree


def _on_screen(query: str) -> bool:
    """Whether one of the media queries of a list holds for a screen; features other than the width don't hold."""
    query = query.strip().lower()
    if not query:
        return True
    for each in query.split(","):
        parts = [p.strip() for p in each.split(" and ")]
        kind = parts[0].removeprefix("only ").strip()
        features = parts[1:] if not kind.startswith("(") else parts
        fits = kind in ("all", "screen") or kind.startswith("(") or (kind.startswith("not ") and kind not in ("not all", "not screen"))
        for feature in features:
            width = _WIDTH.fullmatch(feature)
            fits = fits and bool(width) and ((SCREEN_PX >= float(width[2])) if width[1] == "min" else (SCREEN_PX <= float(width[2])))
        if fits:
            return True
    return False


def _rules(sheet: str):
    """(selectors, body) of the style rules that apply to a screen."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet.lower(), flags=re.S)
    applies, start, at = [True], 0, 0
    while found := _CSS_MARK.search(sheet, at):
        mark, at = found[0], found.end()
        if mark == "{":
            head = sheet[start : found.start()].strip()
            if head.startswith("@"):
                name, _, query = head.partition(" ")
                inside = _on_screen(query) if name == "@media" else name.startswith(("@supports", "@layer", "@container"))
                applies.append(applies[-1] and inside)
            else:
                end = sheet.find("}", at)
                end = len(sheet) if end < 0 else end
                if applies[-1]:
                    yield head, sheet[at:end]
                at = end + 1
        elif mark == "}":
            if len(applies) > 1:
                applies.pop()
        elif mark != ";":
            continue  # a string
        start = at


class Style:
    """What the page's sheets say of `display` and `visibility`."""

    def __init__(self, sheets: list[str]) -> None:
        #: id, class or tag -> (tag, what the element must have, rank, property, value)
        self.rules: dict[str, list[tuple]] = {}
        order = 0
        for sheet in sheets:
            for selectors, body in _rules(sheet):
                said = _DECLARED.findall(body)
                if not said:
                    continue
                for selector in selectors.split(","):
                    compound = _COMPOUND.fullmatch(selector.strip())
                    if not compound or not selector.strip():
                        continue
                    tag = compound[1] if compound[1] and compound[1] != "*" else ""
                    parts = frozenset(_PART.findall(compound[2]))
                    ids = sum(p[0] == "#" for p in parts)
                    index = next(iter(sorted(parts)), tag or "*")
                    for name, value, important in said:
                        order += 1
                        rank = (bool(important), 0, ids, len(parts) - ids, bool(tag), order)
                        self.rules.setdefault(index, []).append((tag, parts, rank, name, value))

    def of(self, node: Node) -> tuple[str, str]:
        """The winning `display` and `visibility`, or empty strings."""
        best: dict[str, tuple] = {}
        attrs = node.attrs
        if self.rules:
            have = {f".{c}" for c in attrs.get("class", "").lower().split()} if "class" in attrs else set()
            if "id" in attrs:
                have.add(f"#{attrs['id'].lower()}")
            for key in (node.tag, "*", *have):
                for tag, parts, rank, name, value in self.rules.get(key, ()):
                    if (not tag or tag == node.tag) and parts <= have and (name not in best or best[name][0] < rank):
                        best[name] = (rank, value)
        if "style" in attrs:
            for k, (name, value, important) in enumerate(_DECLARED.findall(attrs["style"].lower())):
                rank = (bool(important), 1, 0, 0, False, k)
                if name not in best or best[name][0] < rank:
                    best[name] = (rank, value)
        return best.get("display", ("", ""))[1], best.get("visibility", ("", ""))[1]


def _gone(node: Node, display: str) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in NEVER_SHOWN or display == "none":
        return True
    return not display and ("hidden" in attrs or (tag == "dialog" and "open" not in attrs))


class Writer:
    """Collapses white space and turns the breaks that blocks ask for into newlines."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0
        self.space = False
        self.indent = ""
        self.marker = ""

    def want(self, breaks: int) -> None:
        self.breaks = max(self.breaks, breaks)
        self.space = False

    def _lead(self) -> None:
        if self.parts:
            if self.breaks:
                self.parts.append("\n" * self.breaks + self.indent + self.marker)
                self.marker = ""
            elif self.space:
                self.parts.append(" ")
        elif self.indent or self.marker:
            self.parts.append(self.indent + self.marker)
            self.marker = ""
        self.breaks, self.space = 0, False

    def flow(self, data: str) -> None:
        words = _WHITE.sub(" ", data)
        core = words.strip(" ")
        if not core:
            self.space = self.space or bool(words)
            return
        self.space = self.space or words[0] == " "
        self._lead()
        self.parts.append(core)
        self.space = words[-1] == " "

    def keep(self, data: str) -> None:
        for i, line in enumerate(data.split("\n")):
            if i:
                self.line()
            if line:
                self._lead()
                self.parts.append(line)

    def line(self) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        elif self.parts and self.parts[-1].endswith("\n") and not self.parts[-1].strip("\n"):
            self.parts.append("\n")
        self.breaks, self.space = 1, False

    def text(self) -> str:
        return "".join(self.parts).strip("\n")


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.covers: list[tuple[int, int, int]] = []  # columns from, to, and rows that a cell from above still covers
        self.coming: list[tuple[int, int, int]] = []
        self.next = 0
        self.column = 0
        self.caption = ""

    def row(self) -> None:
        if self.rows:
            self.covers = sorted((a, b, k - 1) for a, b, k in self.covers + self.coming if k > 1)
            self.coming = []
        self.rows.append([])
        self.column = self.next = 0

    def cell(self, text: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.next < len(self.covers) and self.covers[self.next][0] <= self.column:
            self.column = max(self.column, self.covers[self.next][1])
            self.next += 1
        self.rows[-1].append((self.column, columns, text.split("\n")))
        if rows > 1:
            self.coming.append((self.column, self.column + columns, rows))
        self.column += columns

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, columns, lines in row:
                widths[column] = max(widths.get(column, 0), max(map(len, lines)) if columns == 1 else 0)
                if columns > 1 and any(lines) and not widths[column]:
                    widths[column] = 1
        order = sorted(c for c, w in widths.items() if w)
        out = [self.caption] if self.caption else []
        for row in self.rows:
            cells = {column: lines for column, _, lines in row}
            for k in range(max((len(x) for x in cells.values()), default=0)):
                line = "  ".join(
                    (cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(widths[c]) for c in order
                ).rstrip()
                out += [line] if line or k else []
        return out


def _number(value: str | None, default: int) -> int:
    """An integer attribute; what isn't one, or has more than nine digits, counts as missing."""
    found = _NUMBER.match(value) if value else None
    return int(found[1]) if found else default


def _count(value: str | None) -> int:
    return min(max(_number(value, 1), 1), 1000)


def render(source: str) -> str:
    """The visible text of one page."""
    tree = build(source)
    style = Style(tree.css)
    out = Writer()
    writers, tables, lists = [out], [], []
    pre = 0
    seen = [True]  # whether visibility shows text here
    todo: list[tuple] = [(tree.root, False)]
    while todo:
        node, leaving = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if seen[-1]:
                (w.keep if pre else w.flow)(node)
            continue
        tag = node.tag
        if not leaving:
            display, visibility = style.of(node) if style.rules or "style" in node.attrs else ("", "")
            if _gone(node, display):
                continue
            seen.append(visibility == "visible" if visibility in ("visible", "hidden", "collapse") else seen[-1])
            if tag == "br":
                w.line()
            elif tag == "wbr":
                pass
            elif tag == "table":
                w.want(2)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif (tag in CELLS or tag == "caption") and tables:
                writers.append(Writer())
            elif tag in SPACED:
                w.want(1 if tag in ("ul", "ol", "dl") and lists else 2)
            elif tag in BLOCK:
                w.want(1)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(_number(node.attrs.get("start"), 1) if tag == "ol" else None)
            elif tag == "li":
                depth = max(len(lists) - 1, 0)
                w.indent = "  " * depth
                number = lists[-1] if lists else None
                if number is not None:
                    number = _number(node.attrs.get("value"), number)
                w.marker = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1] = number + 1
            elif tag == "dd":
                w.indent += "  "
            elif tag in ("pre", "textarea", "listing", "xmp"):
                pre += 1
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.append((node, True))
            todo += [(c, False) for c in reversed(children)]
            continue
        seen.pop()
        if tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
            w.indent = "  " * max(len(lists) - 1, 0) if lists else ""
        elif tag == "li":
            w.marker = ""
            w.indent = "  " * max(len(lists) - 1, 0) if len(lists) > 1 else ""
        elif tag == "dd":
            w.indent = w.indent[:-2]
        elif tag in ("pre", "textarea", "listing", "xmp"):
            pre -= 1
        if (tag in CELLS or tag == "caption") and tables and len(writers) > 1:
            text = writers.pop().text()
            if tag == "caption":
                tables[-1].caption = text
            else:
                tables[-1].cell(text, _count(node.attrs.get("colspan")), _count(node.attrs.get("rowspan")))
        elif tag == "table" and tables:
            for line in tables.pop().lines():
                w.want(1)
                if line:
                    w._lead()
                    w.parts.append(line)
            w.want(2)
        elif tag in SPACED:
            w.want(1 if tag in ("ul", "ol", "dl") and lists else 2)
        elif tag in BLOCK:
            w.want(1)
    return out.text()


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Append `visible_text`; a column of that name in the input is replaced."""

    def make():
        def work(pages: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([None if p is None else render(p) for p in pages.to_pylist()], pa.string())]

        return work

    return add_columns(df, html_col, make, "visible_text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id", "visible_text")
