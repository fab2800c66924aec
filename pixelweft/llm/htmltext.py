"""Layout-aware rendering of HTML: all visible text, as blocks, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by the way they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link datalist noframes iframe object audio video canvas param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
LINED = frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav option optgroup search section summary tr caption thead tbody tfoot".split())
CLOSES_P = SPACED | frozenset("address article aside center details dialog div dir dl fieldset figcaption footer form header hgroup main menu nav search section summary".split())
#: A start tag ends open elements of these names, up to one of the limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "colgroup": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
CELL_LIMITS = frozenset("td th caption table button object template".split())
SECTIONS = frozenset("thead tbody tfoot".split())
TABLE_PARTS = SECTIONS | frozenset("table tr".split())
TABLE_TAGS = SECTIONS | frozenset("tr td th caption colgroup col".split())
#: Largest spans that count. Cells wider than CELL_WIDTH don't widen their column, and no text is padded by more than GAP:
#: what comes after it in its line is aligned again. So a line is the same whatever number of lines its table has.
COLSPAN, ROWSPAN, CELL_WIDTH, GAP = 1000, 65534, 60, 124
SPACE = re.compile(r"[ \t\n\r\f\x0b]+")
_HIDING = re.compile(r"(?:^|[;{\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_PLAIN = re.compile(r"^(?:[a-z][\w-]*)?(?:[.#][\w-]+)?$", re.I)


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


class TreeBuilder(HTMLParser):
    """Builds the tree: implied ends, void elements, stray end tags, a paragraph ended by the block that follows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.hidden: set[str] = set()
        self.css: list[str] = []

    def _end(self, names: set[str], limits: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in limits:
                return
            if self.open[k].name in names:
                del self.open[k:]
                names = names - {"p"} if names == {"p"} else names
                return self._end(names, limits)

    def _add(self, child: Node | str) -> None:
        """Appends to what is open. Content that has no place in a table goes before it, as browsers have it."""
        here = self.open[-1]
        if here.name in TABLE_PARTS and (child.strip() if isinstance(child, str) else child.name not in TABLE_TAGS | UNSEEN):
            at = next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k].name == "table" or k == 0)
            around = self.open[at - 1].children if at else here.children
            table = self.open[at]
            place = next((k for k in range(len(around) - 1, -1, -1) if around[k] is table), len(around))
            around.insert(place, child)
        else:
            here.children.append(child)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._end({"p"}, CELL_LIMITS)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if self.open[-1].name == "head" and tag not in UNSEEN | {"base", "head"}:
            self.open.pop()
        if tag == "table" and self.open[-1].name in TABLE_PARTS:
            del self.open[max(k for k, n in enumerate(self.open) if n.name == "table" or k == 1) :]
        if tag in TABLE_TAGS:
            at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].name in TABLE_PARTS | {"td", "th", "caption"}), 0)
            if self.open[at].name in TABLE_PARTS:
                del self.open[at + 1 :]
                if tag in ("td", "th") and self.open[-1].name != "tr":
                    row = Node("tr")
                    self.open[-1].children.append(row)
                    self.open.append(row)
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag == "form" and self.open[-1].name in TABLE_PARTS:
            return
        self._add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return
            if self.open[k].name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].name == "style":
            self.css.append(data)
        else:
            if self.open[-1].name == "head" and data.strip():
                self.open.pop()
            self._add(data)

    def finish(self) -> Node:
        for name, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", "".join(self.css), flags=re.S)):
            if _HIDING.search(body):
                self.hidden.update(s.strip().lower() for s in name.split(",") if s.strip() and _PLAIN.match(s.strip()))
        return self.root


def width_of(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Canvas:
    """Lines of text with the space between blocks: at most one empty line, none at the ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.space = False
        self.lead = ""
        self.mark = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.feed()
                if part:
                    self._put(" " + part if self.space and self.now and not k else part)
            return
        if not s:
            return
        body = SPACE.sub(" ", s)
        if body[0] == " " and self.now:
            self.space = True
        core = body.strip(" ")
        if core:
            self._put((" " if self.space else "") + core)
            self.space = body[-1] == " "

    def _put(self, s: str) -> None:
        if not self.now:
            s = s.lstrip(" ") if self.space else s
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.now.append(self.lead + self.mark)
            self.mark = " " * len(self.mark)
        self.space = False
        self.now.append(s)

    def feed(self) -> None:
        """Ends the line, even an empty one."""
        if self.now:
            self.line()
        else:
            self.gap = 0 if not self.lines else max(self.gap, 2)

    def line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.gap = max(self.gap, 1)

    def block(self) -> None:
        self.line()
        self.gap = 2

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines)


def _seen(node: Node, hidden: set[str]) -> bool:
    a = node.attrs
    if node.name in UNSEEN or "hidden" in a or (node.name == "input" and a.get("type", "").lower() == "hidden"):
        return False
    if "style" in a and _HIDING.search(a["style"]):
        return False
    if hidden:
        marks = [f".{c.lower()}" for c in a.get("class", "").split()] + ([f"#{a['id'].lower()}"] if a.get("id") else [])
        if node.name in hidden or any(m in hidden or f"{node.name}{m}" in hidden for m in marks):
            return False
    return True


def _rows(table: Node, hidden: set[str]) -> tuple[list[Node], list[list[Node]]]:
    """Captions, and the cells of each row of a table, its own only."""
    parts = [c for c in table.children if isinstance(c, Node) and _seen(c, hidden)]
    rows = [r for c in parts for r in (c.children if c.name in SECTIONS else [c]) if isinstance(r, Node) and r.name == "tr" and _seen(r, hidden)]
    return [c for c in parts if c.name == "caption"], [[c for c in r.children if isinstance(c, Node) and c.name in ("td", "th") and _seen(c, hidden)] for r in rows]


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(most, int(value)) if value.isdecimal() and len(value) < 10 else 1


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> Iterator[str]:
    """Lines of a table whose cells are (lines, columns, rows that they span); 0 rows: to the end.

    A cell begins at the first column that is free. Columns in which no cell begins take no room.
    """
    taken: dict[int, int] = {}
    placed: list[list[tuple[int, list[str]]]] = []
    for r, row in enumerate(rows):
        at, own = 0, []
        for lines, across, down in row:
            while taken.get(at, 0) > r:
                at += 1
            own.append((at, lines))
            if down != 1:
                taken.update(dict.fromkeys(range(at, at + max(1, across)), r + down if down else len(rows)))
            at += max(1, across)
        placed.append(own)
    widths: dict[int, int] = {}
    for own in placed:
        for at, lines in own:
            widths[at] = max([widths.get(at, 0), *(w for x in lines if (w := width_of(x)) <= CELL_WIDTH)])
    start, offsets = 0, {}
    for at in sorted(widths):
        offsets[at] = start
        start += widths[at] + 2 if widths[at] else 0
    table: list[list[tuple[int, str]]] = []
    for own in placed:
        by_line: list[list[tuple[int, str]]] = [[] for _ in range(max((len(lines) for _, lines in own), default=0))]
        for at, lines in own:
            for j, x in enumerate(lines):
                if x:
                    by_line[j].append((offsets[at], x))
        table += [line for line in by_line if line]
    for line in table:
        text, width = [], 0
        for offset, x in line:
            gap = max(2 if text else 0, min(offset - width, GAP))
            text += [" " * gap, x]
            width += gap + width_of(x)
        yield "".join(text).rstrip()


def render(node: Node, hidden: set[str], depth: int = 0) -> str:
    """Text of a node. Walks with a stack of its own, so deep trees do no harm. Tables nested more than eight deep are written as lines."""
    out = Canvas()
    # Entries: a node or text to begin, or a function to run when its children are done.
    stack: list = [(c, False, 0) for c in reversed(node.children)]
    numbers: list[list] = []
    while stack:
        top = stack.pop()
        if callable(top):
            top()
            continue
        n, pre, level = top
        if isinstance(n, str):
            out.text(n, pre)
            continue
        if not _seen(n, hidden):
            continue
        name = n.name
        if name == "br":
            out.line() if out.now else out.feed()
            continue
        if name == "table" and depth < 8:
            captions, rows = _rows(n, hidden)
            out.block()
            for c in captions:
                for line in render(c, hidden, depth + 1).split("\n"):
                    if line:
                        out.text(line, True)
                        out.line()
            for line in lay_out([[(render(c, hidden, depth + 1).split("\n"), _span(c, "colspan", COLSPAN), _span(c, "rowspan", ROWSPAN)) for c in r] for r in rows]):
                out.text(line, True)
                out.line()
            out.block()
            continue
        if name == "select":
            shown, several = _options(n, hidden)
            for k, c in enumerate(reversed(shown)):
                stack.extend([out.line] * several + [(x, False, level + 1) for x in reversed(c.children)] + [out.line] * (several and k == len(shown) - 1))
            continue
        if name == "hr":
            out.block()
            continue
        inner = pre or name in ("pre", "listing", "xmp", "textarea")
        if name in ("ul", "ol", "menu", "dir"):
            (out.line if numbers else out.block)()
            start = n.attrs.get("start", "1").strip()
            numbers.append([name, int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1])

            def end_list() -> None:
                numbers.pop()
                (out.line if numbers else out.block)()

            stack.append(end_list)
        elif name == "li":
            out.line()
            kept = (out.lead, out.mark)
            kind = numbers[-1] if numbers else ["ul", 1]
            out.lead, out.mark = out.lead + (" " * len(out.mark)), "- " if kind[0] != "ol" else f"{kind[1]}. "
            kind[1] += 1

            def end_item(kept: tuple[str, str] = kept) -> None:
                out.line()
                out.lead, out.mark = kept[0], " " * len(kept[1])

            stack.append(end_item)
        elif name in ("blockquote", "dd"):
            (out.block if name == "blockquote" else out.line)()
            kept = (out.lead, out.mark)
            out.lead, out.mark = out.lead + " " * len(out.mark) + "  ", ""

            def end_quote(kept: tuple[str, str] = kept, block: bool = name == "blockquote") -> None:
                (out.block if block else out.line)()
                out.lead, out.mark = kept[0], " " * len(kept[1])

            stack.append(end_quote)
        elif name in SPACED:
            out.block()
            stack.append(out.block)
        elif name in LINED:
            out.line()
            stack.append(out.line)
        elif name in ("td", "th"):
            out.text(" ", False)
            stack.append(lambda: out.text(" ", False))
        stack.extend((c, inner, level + 1) for c in reversed(n.children))
    return out.done()


def _options(select: Node, hidden: set[str]) -> tuple[list[Node], bool]:
    """The options that a list shows: all of a list of several lines, else the last that is selected, or the first."""
    options, stack = [], [select]
    while stack:
        n = stack.pop()
        if n.name == "option":
            options.append(n)
            continue
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and _seen(c, hidden))
    several = "multiple" in select.attrs or _span(select, "size", 1000) > 1
    if not several:
        chosen = [c for c in options if "selected" in c.attrs]
        options = chosen[-1:] or options[:1]
    return options, several


def html_to_text(html: str | None) -> str:
    """Visible text of a page; null and empty pages have none."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.finish(), builder.hidden)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) for every row of pages; malformed markup is read as browsers read it, as far as the rules above go.

    Null and empty pages have the text "". Repeated rows and null keys come back as often as they stand; other columns
    are left out; an empty table gives no rows. A page is worked on whole, whatever its length.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.record_batch([batch.column(0), pa.array([html_to_text(x) for x in batch.column(1).to_pylist()], pa.string())], ["__key", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("__key"), F.col(html)).mapInArrow(run, f"__key {kind}, text string").withColumnRenamed("__key", key)


def extract_report(pages: DataFrame) -> DataFrame:
    out = extract(pages)
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
