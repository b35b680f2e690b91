"""HTML extraction: a tree with implied tags, visibility rules, then a layout that emits all visible text.

parse() builds a flat list of nodes (parent index, tag, attributes or text) without recursion: void elements take no children,
an opening tag closes what it implies (p, li, dd, dt, tr, td, th, thead, tbody, option), an end tag closes up to its match
within its scope or is ignored, and what is left open ends with the page. layout() walks the tree: hidden elements (by tag, hidden,
aria-hidden, input type, or an inline style) are left out; white space collapses except in pre; blocks stand on lines of their
own, with a blank line around paragraphs and headings; list items get "- " or numbers, indented by depth; table rows give one
line, with cells padded to the width of their column.

Defined results: null gives null; empty gives an empty string; text without tags is kept; unknown tags are inline; comments,
doctypes and processing instructions are dropped; an unclosed script, style or comment runs to the end. Work is linear in the page. All visible text is emitted; only layout has bounds:
elements deeper than MAX_DEPTH have their text at that depth, a colspan counts MAX_SPAN columns at most (as the HTML standard has it),
and columns are padded to MAX_PAD characters at most. Rows are independent: repeated rows and null ids are kept; other columns, whatever
their names, are ignored; no pages give no rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready

# Elements by behaviour, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas svg math select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption dd dt li legend summary".split()) | frozenset("dd dt li summary".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
BARRIER = frozenset("table td th caption html body template button".split())

NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
ATTRIBUTE = re.compile(r"""\s*+/*+\s*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']*+)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$|!)|font-size\s*:\s*0(?:px|em|pt)?\s*(?:;|$|!))", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
MAX_DEPTH, MAX_SPAN, MAX_PAD = 2000, 1000, 200


class Node:
    __slots__ = ("tag", "attributes", "text", "children")

    def __init__(self, tag: str, attributes: dict | None = None, text: str = ""):
        self.tag, self.attributes, self.text, self.children = tag, attributes or {}, text, []


def _tag_end(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from at on, and the place after the tag's >."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m or m.end() == at:
            end = page.find(">", at)
            return found, len(page) if end < 0 else end + 1
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
        at = m.end()


def parse(page: str) -> Node:
    root = Node("#root")
    stack, depth, at, n, gone = [root], {}, 0, len(page), set()

    def close_to(k: int) -> None:
        for x in stack[k:]:
            depth[x.tag] -= 1
        del stack[k:]

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(Node("#text", text=entities.unescape(s) if "&" in s else s))

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            text(page[at:])
            break
        c = page[lt + 1]
        if not (c.isascii() and c.isalpha()) and c not in "/!?":
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        if c in "!?":
            end = "-->" if page.startswith("<!--", lt) else ">"
            k = page.find(end, lt + (4 if len(end) == 3 else 2))
            at = n if k < 0 else k + len(end)
        elif c == "/":
            m = NAME.match(page, lt + 2)
            k = page.find(">", lt)
            at = n if k < 0 else k + 1
            tag = m[0].lower() if m else ""
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif depth.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close_to(k)
                        break
                    if stack[k].tag in BARRIER and tag not in BLOCK:
                        break
            elif tag == "p":
                stack[-1].children.append(Node("p"))
        else:
            m = NAME.match(page, lt + 1)
            tag = m[0].lower()
            attributes, at = _tag_end(page, m.end())
            if tag in CLOSES_P and depth.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close_to(k)
                        break
                    if stack[k].tag in BARRIER:
                        break
            if tag == "table":  # a table inside a table needs a cell around it
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ("table", "td", "th", "caption")), 0) if depth.get("table") else 0
                if k and stack[k].tag == "table":
                    close_to(k)
            if tag in IMPLIED:
                ends, scope = IMPLIED[tag]
                if any(depth.get(x) for x in ends):
                    k = len(stack) - 1
                    last = None
                    while k > 0 and stack[k].tag not in scope:
                        last = k if stack[k].tag in ends else last
                        k -= 1
                    if last:
                        close_to(last)
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                k = n if tag in gone else _raw_end(page, tag, at)
                if k == n:
                    gone.add(tag)
                if tag not in ("script", "style"):
                    node.children.append(Node("#text", text=entities.unescape(page[at:k])))
                k = page.find(">", k)
                at = n if k < 0 else k + 1
            elif tag not in VOID and len(stack) < MAX_DEPTH:
                stack.append(node)
                depth[tag] = depth.get(tag, 0) + 1
    return root


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the raw element's end tag begins, or the end of the page."""
    m = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
    return m.start() if m else len(page)


def hidden(node: Node) -> bool:
    a = node.attributes
    return node.tag in HIDDEN or bool(a) and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a) or bool("style" in a and UNSEEN.search(a["style"])))


class Lines:
    """Text with the blocks' line breaks: asked-for breaks are kept until text follows."""

    def __init__(self):
        self.out, self.line, self.breaks, self.space, self.indent, self.mark = [], [], 0, False, 0, ""

    def block(self, spaced: bool) -> None:
        self.end()
        self.breaks = max(self.breaks, 2 if spaced else 1)

    def end(self) -> None:
        if self.line:
            self.out.append((self.breaks, "".join(self.line)))
            self.line, self.breaks = [], 1
        self.space = False

    def say(self, s: str, pre: bool = False) -> None:
        if pre:
            for k, x in enumerate(s.split("\n")):
                if k:
                    self.put("")
                    self.end()
                if x:
                    self.put(x)
            return
        body = SPACES.sub(" ", s)
        if body.startswith(" ") and self.line:
            self.space = True
        if word := body.strip(" "):
            self.put((" " if self.space and self.line else "") + word)
            self.space = body.endswith(" ")

    def put(self, s: str) -> None:
        if not self.line:
            self.line.append("  " * self.indent + self.mark if self.indent or self.mark else "")
            self.mark = ""
        self.line.append(s)

    def result(self) -> str:
        self.end()
        return "".join(("\n" * b if k else "") + s.rstrip() for k, (b, s) in enumerate(self.out))


def layout(root: Node) -> str:
    """The visible text. A table is laid out when its rows have been gathered; its cells are laid out first, innermost first."""
    done: dict[int, str] = {}  # nested layouts: cells and captions, by node
    order, work = [], [root]
    while work:
        node = work.pop()
        if node.tag.startswith("#text") or hidden(node):
            continue
        if node.tag in ("td", "th", "caption") or node is root:
            order.append(node)
        work += node.children
    for cell in reversed(order):
        done[id(cell)] = _flow(cell, done)
    return done[id(root)]


def _flow(top: Node, done: dict[int, str]) -> str:
    lines, lists = Lines(), []
    work: list[tuple[Node, bool]] = [(x, True) for x in reversed(top.children)]
    pre = 0
    while work:
        node, opens = work.pop()
        tag = node.tag
        if not opens:
            if tag == "pre":
                pre -= 1
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                lines.indent = max(0, len(lists) - 1)
            elif tag == "li":
                lines.mark = ""
            lines.block(tag in SPACED and not (lists and tag in ("ul", "ol")))
            continue
        if tag == "#text":
            lines.say(node.text, bool(pre))
            continue
        if hidden(node):
            continue
        if tag == "br":
            if lines.line:
                lines.end()
            else:
                lines.breaks = min(2, lines.breaks + 1)
            continue
        if tag == "img":
            lines.say(node.attributes.get("alt", ""))
            continue
        if tag == "input":
            if node.attributes.get("type", "text").lower() in ("submit", "button", "reset"):
                lines.say(node.attributes.get("value", ""))
            continue
        if tag == "table":
            lines.block(True)
            for row in _table(node, done):
                lines.put(row)
                lines.end()
            lines.block(True)
            continue
        if tag in ("td", "th"):  # a cell outside a table
            lines.say(done[id(node)] + " ")
            continue
        if tag in BLOCK:
            lines.block(tag in SPACED and not (lists and tag in ("ul", "ol")))
            if tag == "pre":
                pre += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                first = node.attributes.get("start", "1")
                lists.append([tag, int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1])
                lines.indent = len(lists) - 1
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                lines.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
            work.append((node, False))
        work += [(x, True) for x in reversed(node.children)]
    return lines.result()


def _table(table: Node, done: dict[int, str]) -> list[str]:
    """The lines of a table: caption, then rows; other visible content among the rows keeps its place. Cells with lines of their own are joined by spaces."""
    rows: list[list[str] | str] = []
    work, implied = list(reversed(table.children)), False
    while work:
        node = work.pop()
        before, implied = implied, node.tag in ("td", "th") or (implied and node.tag == "#text" and not node.text.strip())
        if node.tag == "#text":
            if s := SPACES.sub(" ", node.text).strip():
                rows.append(s)
        elif hidden(node):
            continue
        elif node.tag == "caption":
            rows += [x for x in done[id(node)].split("\n") if x.strip()]
        elif node.tag in ("tbody", "thead", "tfoot", "colgroup", "form"):
            work += reversed(node.children)
        elif node.tag in ("tr", "td", "th"):
            cells: list[str] = []
            for x in [node] if node.tag != "tr" else node.children:
                if x.tag in ("td", "th"):
                    if not hidden(x):
                        span = x.attributes.get("colspan", "1")
                        cells += [" ".join(done[id(x)].split()), *[""] * (max(1, min(int(span), MAX_SPAN)) - 1 if re.fullmatch("[0-9]{1,9}", span) else 0)]
                else:
                    holder = Node("#root")
                    holder.children = [x]
                    if s := " ".join(_flow(holder, done).split()):
                        cells.append(s)
            if before and node.tag != "tr" and rows:  # cells without a row share one
                rows[-1] += cells
            else:
                rows.append(cells)
        else:
            holder = Node("#root")
            holder.children = [node]
            rows += [x for x in _flow(holder, done).split("\n") if x.strip()]
    widths: list[int] = []
    for row in rows:
        if isinstance(row, list):
            widths += [0] * (len(row) - len(widths))
            for k, cell in enumerate(row):
                widths[k] = max(widths[k], min(len(cell), MAX_PAD))
    out = [row if isinstance(row, str) else " | ".join(cell.ljust(widths[k]) for k, cell in enumerate(row)).rstrip() for row in rows]
    return [x for x in out if x.strip(" |")]


def extract(page: str | None) -> str | None:
    return None if page is None else layout(parse(page))


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url and the visible text of every page."""
    ready(pages.sparkSession)

    def of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([extract(x) for x in batch.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.selectExpr("CAST(page_id AS long) AS page_id", "url", "html").mapInArrow(of, "page_id long, url string, text string")
