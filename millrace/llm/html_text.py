"""HTML extraction: a tree builder with implied tags and visibility rules, then a layout-aware rendering."""

from __future__ import annotations

import re
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript title meta link iframe object embed audio video canvas svg math datalist noembed noframes base param source track colgroup".split())
#: Blank lines above and below (2) or a line of their own (1).
BLOCKS = dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu table figure hr".split(), 2) | dict.fromkeys(
    "html body div article section nav aside main header footer address form fieldset details summary dialog hgroup figcaption li dt dd center caption legend search optgroup option tr thead tbody tfoot".split(), 1
)
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What an opening tag closes, as far as an open element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "rp": ({"rt", "rp"}, {"ruby"}), "rt": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
HEAD_ONLY = frozenset("meta link base title style script template noscript".split())
SCOPES = frozenset("table td th caption button html".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
#: Inputs that show their value as a label.
BUTTONS = frozenset("submit button reset".split())
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Open(list):
    """The open elements; how many there are of each tag tells at once that there is none to close."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.counts = {root.tag: 1}

    def push(self, node: Node) -> None:
        self.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def cut(self, k: int) -> None:
        for x in self[k:]:
            self.counts[x.tag] -= 1
        del self[k:]


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str) -> Node:
    """The tree.  Tags left out are implied: p, li, dt, dd, tr, td, option, ... close where the next begins."""
    root = Node("html")
    stack = Open(root)
    at, end = 0, len(html)
    lower = None
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            first = m[0][0]
            if first != "<" or m[0] == "<":
                text = unescape(m[0]) if "&" in m[0] else m[0]
                if stack[-1].tag == "head" and not text.isspace():
                    stack.cut(len(stack) - 1)
                stack[-1].children.append(text)
            elif m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag)
            continue
        attrs = _attributes(m[3]) if m[3] else None
        if tag == "html":
            if attrs:
                root.attrs = attrs | root.attrs
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.cut(len(stack) - 1)
        if tag in CLOSES_P:
            _close(stack, "p", implied=True)
        if tag in IMPLIED and any(stack.counts.get(x) for x in IMPLIED[tag][0]):
            closing, bound = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closing:
                    stack.cut(k)
                    if tag not in ("tr", "thead", "tbody", "tfoot", "optgroup"):
                        break
                elif stack[k].tag in bound:
                    break
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else html.lower()
            stop = lower.find("</" + tag, at)
            stop = end if stop < 0 else stop
            node.children.append(unescape(html[at:stop]) if tag in ("textarea", "title") else html[at:stop])
            close = html.find(">", stop)
            at = end if close < 0 else close + 1
        elif tag not in VOID:
            stack.push(node)
    return root


def _close(stack: Open, tag: str, implied: bool = False) -> None:
    if tag in ("html", "body"):
        return
    for k in range(len(stack) - 1, 0, -1) if stack.counts.get(tag) else ():
        own = stack[k].tag
        if own == tag:
            stack.cut(k)
            return
        if own in SCOPES and not (tag in ("table", "tr", "tbody", "thead", "tfoot") and own in ("td", "th", "caption", "table") and tag != own and (tag == "table" or own != "table")):
            return
    if tag == "p" and not implied:
        stack[-1].children.append(Node("p"))
    elif tag == "br":
        stack[-1].children.append(Node("br"))


def visible(node: Node) -> bool:
    """False for elements that browsers leave out with all that is in them: those of INVISIBLE and hidden ones."""
    a = node.attrs
    if node.tag in INVISIBLE or node.tag == "dialog" and "open" not in a:
        return False
    return not a or not ("hidden" in a or "style" in a and HIDDEN.search(a["style"]))


def shown(node: Node, inherited: bool) -> bool:
    """Whether an element's own text is seen: hidden visibility is inherited until one inside is visible again."""
    m = VISIBILITY.search(node.attrs["style"]) if "style" in node.attrs else None
    word = m[1].lower() if m else ""
    return False if word in ("hidden", "collapse") else True if word in ("visible", "initial") else inherited


def width(s: str) -> int:
    """Columns that a line takes: East Asian wide characters two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Output of one flow: a page or a table cell."""

    def __init__(self):
        self.done: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.prefix: list[str] = []
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._add(first)
            for x in rest:
                self.line(1, True)
                self._add(x)
            return
        if not s.strip(" \t\n\r\f"):
            self.space = self.space or bool(self.parts) and bool(s)
            return
        s = SPACE.sub(" ", s)
        if s[0] == " ":
            self.space = bool(self.parts)
        body = s.strip(" ")
        self._add((" " if self.space and self.parts else "") + body)
        self.space = s[-1] == " "

    def _add(self, s: str) -> None:
        if not s:
            return
        if not self.parts:
            if self.gap > 1 and self.done:
                self.done.append("")
            self.gap = 0
            indent = "".join(self.prefix)
            if self.marker:
                indent = indent[: len(indent) - len(self.marker)] + self.marker
                self.marker = ""
            self.parts.append(indent)
        self.parts.append(s)

    def line(self, gap: int = 1, keep: bool = False) -> None:
        """Ends the line; keep: an empty one stays."""
        if self.parts:
            self.done.append("".join(self.parts).rstrip())
            self.parts = []
        elif keep and self.done:
            self.done.append("")
        self.space = False
        self.gap = max(self.gap, gap)

    def rows(self) -> list[str]:
        self.line()
        out = self.done
        while out and not out[-1]:
            out.pop()
        return out


def _number(s: str, default: int) -> int:
    return int(s) if re.fullmatch(r"-?\d{1,9}", s.strip()) else default


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns spanned, rows spanned) as aligned columns, two spaces apart.

    A cell of several rows is written in the first and keeps its columns free below.
    """
    taken: dict[int, int] = {}  # by column: the row up to which a cell from above has it
    placed: list[list[tuple[int, list[str], int]]] = []
    for i, row in enumerate(rows):
        k, own = 0, []
        for lines, span, down in row:
            while taken.get(k, 0) > i:
                k += 1
            own.append((k, lines, span))
            if down > 1:
                taken |= dict.fromkeys(range(k, k + span), i + down)
            k += span
        placed.append(own)
    widths = [0] * max([0, *(k + span for row in placed for k, _, span in row)])
    for row in placed:
        for k, lines, span in row:
            if span == 1:
                widths[k] = max([widths[k], *map(width, lines)])
    for row in placed:
        for k, lines, span in row:
            if span > 1:
                lack = max([0, *map(width, lines)]) - sum(widths[k : k + span]) - 2 * (span - 1)
                widths[k + span - 1] += max(0, lack)
    lefts = [0]
    for w in widths:
        lefts.append(lefts[-1] + w + 2)
    out = []
    for row in placed:
        for i in range(max([0, *(len(lines) for _, lines, _ in row)])):
            line, at = [], 0
            for k, lines, _ in row:
                if i < len(lines) and lines[i]:
                    line += [" " * (lefts[k] - at), lines[i]]
                    at = lefts[k] + width(lines[i])
            out.append("".join(line).rstrip())
    return out


def render(root: Node) -> str:
    """All visible text.  Walks the tree without recursion, so nesting of any depth is fine."""
    flows, out = [], Lines()
    tables: list[list[list]] = []
    lists: list[list] = []
    pre = 0
    walk = [(root, iter(root.children), True)]
    while walk:
        node, children, seen = walk[-1]
        closed = node.tag == "details" and "open" not in node.attrs
        for child in children:
            if isinstance(child, str):
                if seen and not closed and (node.tag not in ("table", "tr", "tbody", "thead", "tfoot") or child.strip()):
                    out.text(child, pre > 0)
                continue
            if not visible(child) or closed and child.tag != "summary":
                continue
            tag = child.tag
            if tag == "input":
                if shown(child, seen) and child.attrs.get("type", "").lower() in BUTTONS and child.attrs.get("value"):
                    out.text(child.attrs["value"], pre > 0)
                continue
            if tag == "br":
                out.line(0, True)
                continue
            if tag == "wbr":
                continue
            if tag == "hr":
                out.line(2)
                out.text("---" if shown(child, seen) else "", False)
                out.line(2)
                continue
            if tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append((out, lists, pre))
                out, lists, pre = Lines(), [], 0
            elif tag in BLOCKS:
                out.line(1 if tag in ("ul", "ol", "menu") and lists else BLOCKS[tag])
                if tag == "table":
                    tables.append([])
                elif tag == "tr" and tables:
                    tables[-1].append([])
                elif tag in ("ul", "ol", "menu"):
                    lists.append(["ol" if tag == "ol" else "ul", _number(child.attrs.get("start", ""), 1)])
                elif tag == "li":
                    if lists and lists[-1][0] == "ol":
                        n = _number(child.attrs.get("value", ""), lists[-1][1])
                        lists[-1][1] = n + 1
                        mark = f"{n}. "
                    else:
                        mark = "- "
                    out.prefix.append(" " * len(mark))
                    out.marker = mark
                elif tag in ("blockquote", "dd"):
                    out.prefix.append("  ")
                elif tag == "pre":
                    pre += 1
            elif tag == "q":
                out.text('"' if shown(child, seen) else "", pre > 0)
            walk.append((child, iter(child.children), shown(child, seen)))
            break
        else:
            walk.pop()
            tag = node.tag
            if not walk:
                break
            if tag in ("td", "th") and flows:
                lines = out.rows()
                out, lists, pre = flows.pop()
                across, down = (_number(node.attrs.get(x, ""), 1) for x in ("colspan", "rowspan"))
                tables[-1][-1].append((lines, min(1000, max(1, across)), 65_534 if down == 0 else min(65_534, max(1, down))))
            elif tag in BLOCKS:
                if tag == "table":
                    for x in _table(tables.pop()):
                        out.line(1)
                        if x:
                            out._add(x)
                elif tag in ("ul", "ol", "menu"):
                    lists.pop()
                elif tag == "li":
                    if out.parts or not out.marker:
                        out.line(1)
                    out.marker = ""
                    out.prefix.pop()
                elif tag in ("blockquote", "dd"):
                    out.line(1)
                    out.prefix.pop()
                elif tag == "pre":
                    pre -= 1
                out.line(1 if tag in ("ul", "ol", "menu") and lists else BLOCKS[tag])
            elif tag == "q":
                out.text('"' if seen else "", pre > 0)
    return "\n".join(out.rows())


def extract(html: str | None) -> str:
    return render(parse(html)) if html else ""


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, text, n_chars.

    Null and empty pages give empty text; broken markup is read as far as it goes (an unclosed comment, tag or
    script takes the rest); repeated rows are rendered each; an empty table gives no rows; other columns are
    ignored.  No shuffle: each page is rendered where it is read.
    """

    def run(it):
        schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())])
        for b in C.batches(it):
            out = [extract(x) for x in b.column(1).to_pylist()]
            yield C.table(schema, b.column(0), out, [len(x) for x in out])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, "page_id long, text string, n_chars long")
